"""Best-fit packing (operator 3): a configuration linear program over the length histogram.

A configuration says how many pieces of each length one sequence takes; the linear program asks for the fewest
sequences that cover the histogram. Multiplicative weights price the lengths, and a knapsack dynamic program finds
the configurations that these prices favour: the best one that holds each length. Its part of the solution is rounded to whole sequences,
and covered lengths lose weight. The last pieces go by best fit. All this works on the histogram alone, whose size is
bounded; pieces then find their sequence by their rank among those of their length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _run

CAPACITY, EOS = 4096, 1
#: Pricing rounds; the part of what its scarcest length has left that a configuration gets; lengths priced at once.
ROUNDS, SHARE, PRICED = 40, 0.7, 96
#: Part of the tokens, in the shortest pieces, that the linear program leaves to fill up the last sequences.
RESERVE = 0.005
#: Best fit alone is taken where it needs fewer sequences by more than this part.
WORSE = 1e-4
#: Pieces of one length that one task ranks.
RANK_ROWS = 50_000
#: Words whose ids a worker remembers: so many recent ones, and as many used before those.
CACHE = 300_000


class _Ids(dict):
    """Ids of lower-case pre-tokens, made by the model when first asked for or taken over from an older cache."""

    def __init__(self, model, older: _Ids | None):
        super().__init__()
        self.model, self.older = model, dict(older or {})

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            found = [k.id for k in self.model.tokenize(word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()]))]
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids


_tokenizers: dict[str, object] = {}
_ids: dict[str, _Ids] = {}
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space for str.split, not for the tokenizer


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = (t, [a.content for a in t.get_added_tokens_decoder().values()])
    return _tokenizers[path]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


_LETTERS = _byte_letters()
#: Latin letters, digits and ASCII signs but for the apostrophe: normal form, lower case and pre-tokens of these are plain to see.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-/:-@\[-`{-~\t-\r ]*")
#: The tokenizer's own pre-tokens, for lower-case texts of these signs.
_PART = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")


def encode(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    For a byte-level tokenizer that lowers case, drops white space and splits at it. Of texts of plain signs each distinct
    pre-token is encoded once, by the model alone, and remembered; other texts are looked at chunk by chunk between white
    space in the same way, chunks of other signs by the library. Texts with special strings, or with separators that only
    Python splits at, are encoded whole.
    """
    t, specials = _tokenizer(path)
    known = _ids.get(path)
    if known is None or len(known) > CACHE:
        known = _ids[path] = _Ids(t.model, known)
    split, odd = [], []
    for i, x in enumerate(texts):
        if any(s in x for s in specials) or any(c in x for c in _ODD):
            odd.append(i)
            split.append([])
        elif _PLAIN.fullmatch(x):
            split.append(_PART.findall(x.lower()))
        else:
            parts = []
            for chunk in x.split():
                if _PLAIN.fullmatch(chunk):
                    parts += _PART.findall(chunk.lower())
                else:
                    parts.append(" " + chunk)  # told by its space
            split.append(parts)
            foreign = [w for w in set(parts).difference(known) if w[0] == " "]
            for word, e in zip(foreign, t.encode_batch_fast([w[1:] for w in foreign], add_special_tokens=False), strict=True):
                known[word] = np.asarray(e.ids, "<u4").tobytes()
    out = [b"".join(map(known.__getitem__, parts)) for parts in split]
    for i, e in zip(odd, t.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
        out[i] = np.asarray(e.ids, "<u4").tobytes()
    return out


def tokenized(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary).

    A document is its ids and then ``eos``; only one longer than the capacity is cut. Null texts are empty, so they
    are one piece of length 1. Repeated rows give pieces each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = df.select(id_column).schema[0]
    kind, end = to_arrow_type(field.dataType), np.asarray([eos], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, x in enumerate(encode(tokenizer_path, [t or "" for t in part.column(1).to_pylist()])):
                    x += end
                    for k in range(0, len(x), 4 * capacity):
                        b = x[k : k + 4 * capacity]
                        row.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(b) // 4)
                        crc.append(zlib.crc32(b))
                        if with_ids:
                            ids.append(b)
                cols = [part.column(0).take(pa.array(row, pa.int32())).cast(kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {field.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def knapsack(value: np.ndarray, most: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths and amounts of the items, which item is taken at which room) of the largest total value in each room.

    ``value[k]`` is that of one piece of length k, of which there are ``most[k]``; an item is 1, 2, 4, … of them.
    """
    items = []
    for k in np.flatnonzero((value > 0) & (most > 0))[::-1].tolist():
        left, a = min(int(most[k]), size // k), 1
        while left > 0:
            items.append((k, min(a, left)))
            left, a = left - a, 2 * a
    best, keep = np.zeros(size + 1), np.zeros((len(items), size + 1), bool)
    for i, (k, a) in enumerate(items):
        w = k * a
        got = best[: size + 1 - w] + value[k] * a
        keep[i, w:] = got > best[w:]
        np.maximum(best[w:], got, out=best[w:])
    return np.asarray(items, np.int64).reshape(-1, 2), keep


def _filled(items: np.ndarray, keep: np.ndarray, first: np.ndarray, size: int) -> list[dict[int, int]]:
    """The best configuration that holds a piece of each of the lengths ``first``."""
    room = size - first
    out: list[dict[int, int]] = [{int(k): 1} for k in first]
    for i in range(len(items) - 1, -1, -1):
        took = np.flatnonzero(keep[i, room])
        if len(took):
            k, a = items[i].tolist()
            room[took] -= k * a
            for t in took.tolist():
                out[t][k] = out[t].get(k, 0) + a
    return out


def solve(counts: np.ndarray, size: int, rounds: int = ROUNDS, share: float = SHARE, reserve: float = RESERVE) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """(how many sequences, pieces of each length in one) so that every piece of the histogram has a place; and the
    share of the pieces that the linear program placed.

    ``counts[k]`` pieces of length k, for lengths 0 (unused) to ``size``. Each round prices a length by its tokens times
    exp(-4 covered) and asks the knapsack for the best configuration of each length that is still open, in seeded parts
    of about ``PRICED`` lengths, so that not all want the same filling. A full configuration gets ``share`` of what its
    scarcest length has left, rounded down to whole sequences but at least one, so that none claims a piece twice; others
    wait for the next round. What is left, with the shortest pieces (``reserve`` of all tokens), goes by best fit. Where
    best fit alone needs clearly fewer sequences (``WORSE``) its plan is taken, and the share is 0.
    """
    tokens = counts * np.arange(size + 1)
    small = int(np.searchsorted(np.cumsum(tokens), reserve * float(tokens.sum())))
    need, left = np.maximum(counts, 1), counts.astype(np.int64).copy()
    draw = np.random.default_rng(0)
    out: list[tuple[int, dict[int, int]]] = []
    for _ in range(rounds):
        some = draw.permutation(small + np.flatnonzero(left[small:]))
        for part in np.array_split(some, max(1, round(len(some) / PRICED))):
            mine = np.zeros(size + 1, np.int64)
            mine[part] = left[part]
            items, keep = knapsack(np.arange(size + 1) * np.exp(4 * (left / need - 1)), mine, size)
            for config in _filled(items, keep, part, size):
                times = min(int(left[k]) // a for k, a in config.items())
                if times > 0 and sum(k * a for k, a in config.items()) == size:
                    times = max(1, int(share * times))
                    out.append((times, config))
                    for k, a in config.items():
                        left[k] -= times * a
    placed = 1 - left.sum() / max(1, counts.sum())
    out = best_fit(left, size, out)
    plain = best_fit(counts, size)
    if sum(n for n, _ in plain) < (1 - WORSE) * sum(n for n, _ in out):
        return plain, 0.0
    return out, float(placed)


def best_fit(counts: np.ndarray, size: int, begun: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing of a histogram into the sequences begun and new ones; those with equal contents are one entry."""
    room: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(dict)
    for n, config in begun:
        r, key = size - sum(k * a for k, a in config.items()), tuple(sorted(config.items(), reverse=True))
        room[r][key] = room[r].get(key, 0) + n
    for k in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[k])
        while n:
            fits = [r for r in room if r >= k and room[r]]
            if not fits:  # open so many sequences as the length fills alone
                per = size // k
                if n >= per:
                    full, config = n // per, ((k, per),)
                    n -= full * per
                else:
                    full, config, n = 1, ((k, n),), 0
                r = size - k * config[0][1]
                room[r][config] = room[r].get(config, 0) + full
                continue
            r = min(fits)
            config, have = next(iter(room[r].items()))
            times = min(have, n)
            if times == have:
                del room[r][config]
            else:
                room[r][config] = have - times
            new = tuple(sorted((dict(config) | {k: dict(config).get(k, 0) + 1}).items(), reverse=True))
            room[r - k][new] = room[r - k].get(new, 0) + times
            n -= times
    return [(n, dict(c)) for r in room.values() for c, n in r.items() if n]


def _runs(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, pieces of the length in one sequence, slot of the first."""
    at: dict[int, int] = defaultdict(int)
    rows = defaultdict(list)
    sequence = 0
    for times, config in plan:
        slot = 0
        for k in sorted(config, reverse=True):
            rows[k].append((at[k], sequence, config[k], slot))
            at[k] += times * config[k]
            slot += config[k]
        sequence += times
    return {k: tuple(np.asarray(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``pieces`` (column ``length``, 1 to capacity; any others) with sequence_id and offset, gapless from 0.

    Pieces are numbered among those of their length by their place in the checkpoint, in classes of about ``rank_rows``,
    so neither a frequent length nor rows alike in all columns meet in one task. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c != "length"]
    w = _run.cut(pieces.select(F.struct(*names).alias("rest"), F.col("length").cast("long").alias("length")))
    histogram = w.groupBy("length").count().collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    # Bounded by lengths x rounds x phases, whatever the number of pieces.
    plan = spark.sparkContext.broadcast(_runs(solve(counts, capacity)[0]))
    salts = {k: -(-int(n) // rank_rows) for k, n in enumerate(counts) if n > rank_rows}
    many = F.lit(1)
    for n in sorted(set(salts.values())):
        many = F.when(F.col("length").isin(*(k for k, v in salts.items() if v == n)), F.lit(n)).otherwise(many)
    # Checkpointed rows keep their order, so a retried task numbers alike.
    w = w.withColumn("uid", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("uid"), many).cast("int"))
    # As many rows as lengths and their salts; dealt like the numbered rows.
    sums = w.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = w.withColumn("at", F.row_number().over(order) - 1).join(sums, ["length", "salt"]).select("rest", "length", (F.col("base") + F.col("at")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            kinds, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sequence, slot = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds):
                mine = kinds == k
                first, seq, per, begin = runs[int(k)]
                r = np.searchsorted(first, rank[mine], "right") - 1
                inside = rank[mine] - first[r]
                sequence[mine], slot[mine] = seq[r] + inside // per[r], begin[r] + inside % per[r]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sequence), pa.array(slot)], names=["rest", "length", "sequence_id", "slot"])

    rest = w.select("rest").schema[0].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"rest {rest}, length long, sequence_id long, slot long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    return out.select("rest.*", "length", "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(tokenized(df, tokenizer_path, **options), options.get("capacity", CAPACITY))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, ids (binary), length. A group fits a sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "length")
