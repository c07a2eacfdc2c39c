"""Suffix-array dedup (operator 6): a logarithmic family of indexes finds every repeated 400-byte string.

The suffix arrays are sparse: only suffixes at content-defined places are kept. Of the hashes of all 120-byte strings
inside a 400-byte window the smallest marks its place, so equal windows mark the same place in them, and each window
belongs to one marked suffix. An index is a sorted run of suffixes, by their first 8 bytes and then by the hash of their
first 120, with how often each occurs in each context, the context being the bytes of all windows that belong to it.

Documents come in batches. A new batch is sorted into a run of its own, merge-scanned against every level that exists
for suffixes that both hold, and added as a level; levels of equal size merge, so that there are logarithmically many.

Suffixes with a context that occurs twice lie wholly in repeats. Where a suffix occurs in different contexts, its
windows are compared one by one. Strings are told apart by two independent 64-bit hashes (of the suffix and of the window).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _run
from . import _text as T

LENGTH, PREFIX = 400, 120
#: Batches in which ``repeats`` takes its documents; at the end levels of two batches and of one are there.
BATCHES = 3
#: Texts are hashed in blocks of this size; a longer one in segments that overlap by a window.
SEGMENT = 512 << 10
#: Distinct contexts of a suffix that one task compares; those of a more frequent one are counted by exchange.
CONTEXTS = 8192
#: Bits for each entry of the filters that spare the exchanges rows without a match, and at most in all (8 MB).
ENTRY_BITS, FILTER_BITS = 16, 1 << 26

_WINDOW_BASE = 0xC2B2AE3D27D4EB4F | 1
_PLACE = np.uint64((1 << 24) - 1)


def suffixes(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, place, lead, suffix hash, context hash) of the marked suffixes of a block.

    The lead is the suffix's first 8 bytes, as a signed number of the same order.
    """
    w, n = length - prefix + 1, len(data)
    none = (np.empty(0, np.int64),) * 5 + (np.empty(0, np.uint64),) * 2
    if n < length:
        return none
    grams = T.Hasher(data).of(np.arange(n - prefix + 1), np.arange(prefix, n + 1))
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(key) // w)
    grid = np.full(rows * w, np.uint64(2**64 - 1))
    grid[: len(key)] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _PLACE).astype(np.int64)
    del grid, ahead, behind, key
    size = np.diff(offsets)
    inside = np.zeros(n + 1, np.int64)
    long = size >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:windows]) > 0)
    if not len(at):
        return none
    text = np.searchsorted(offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    s, e = at[first], at[last]
    p = place[s]
    context = T.mix(T.Hasher(data, _WINDOW_BASE).of(s, e + length) + (p - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lead = data[p[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64) if prefix >= 8 else p.astype(np.uint64)
    return text[first], s, e, p, (lead ^ np.uint64(1 << 63)).view(np.int64), grams[p], context


def _segments(texts: pa.Array, length: int, segment: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, row behind the last, bytes, offsets, where in the text the bytes begin)."""
    for begin, stop, data, offsets in T.blocks(texts, segment):
        if len(data) <= segment + length:
            yield begin, stop, data, offsets, 0
        else:  # one long text
            for base in range(0, len(data) - length + 1, segment):
                part = data[base : base + segment + length - 1]
                yield begin, stop, part, np.asarray([0, len(part)]), base


def marked(df: DataFrame, length: int = LENGTH, prefix: int = PREFIX, segment: int = SEGMENT) -> DataFrame:
    """(key, text) → (lead, a, c, key, at) for each marked suffix; ``at`` packs the first window, how many follow it, and the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for begin, _, data, offsets, base in _segments(batch.column(1), length, segment):
                    text, s, e, p, lead, a, c = suffixes(data, offsets, length, prefix)
                    at = ((s - offsets[text] + base) << 32) | ((e - s) << 16) | (p - s)
                    yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(pa.array(text + begin)), pa.array(at)], names=["lead", "a", "c", "key", "at"])

    kind = df.select("key").schema[0].dataType.simpleString()
    return df.select("key", "text").mapInArrow(run, f"lead long, a long, c long, key {kind}, at long")


def _unpacked(at: str = "at"):
    """First window, last window and place of a suffix in its text."""
    s = F.shiftright(at, 32)
    return s.alias("s"), (s + F.shiftright(at, 16).bitwiseAND(F.lit(0xFFFF))).alias("e"), (s + F.col(at).bitwiseAND(F.lit(0xFFFF))).alias("p")


Table = tuple[DataFrame, Callable[[], None]]


class IndexFamily:
    """Sorted runs (lead, a, c, n): suffix, context, occurrences. ``levels`` has one of each size, in batches: a power of two.

    ``found`` holds the suffixes that a scan met: those of a batch that an earlier level or the batch itself repeats.
    """

    def __init__(self) -> None:
        self.levels: dict[int, Table] = {}
        self.found: list[Table] = []

    @staticmethod
    def _run(rows: DataFrame) -> Table:
        return _run.stored(rows.groupBy("lead", "a", "c").agg(F.sum("n").alias("n")).sortWithinPartitions("lead", "a", "c"))

    def add(self, suffix_rows: DataFrame) -> None:
        """A new batch: sort it, scan it against each level, then merge it with levels of its size."""
        (new, drop_new), size = self._run(suffix_rows.select("lead", "a", "c", F.lit(1).cast("long").alias("n"))), 1
        own = new.groupBy("lead", "a").agg(F.sum("n").alias("n"))
        met = own.filter("n > 1").select("lead", "a")
        for level, _ in self.levels.values():
            # Both runs are sorted by suffix; the join merges them and only asks whether there is a partner.
            met = met.unionByName(own.select("lead", "a").join(level.select("lead", "a").distinct(), ["lead", "a"], "left_semi"))
        self.found.append(_run.stored(met.distinct()))
        while size in self.levels:
            old, drop_old = self.levels.pop(size)
            merged = self._run(new.unionByName(old))
            drop_new()
            drop_old()
            (new, drop_new), size = merged, 2 * size
        self.levels[size] = new, drop_new

    def repeated(self) -> DataFrame:
        """(a) of the suffixes that occur at least twice in all batches."""
        out = None
        for found, _ in self.found:
            out = found if out is None else out.unionByName(found)
        return out.select("a").distinct()

    def entries(self, keep) -> DataFrame:
        """(a, c, n) of all levels together, of the suffixes that ``keep`` lets pass."""
        rows = None
        for level, _ in self.levels.values():
            some = level.select("a", "c", "n").mapInArrow(keep, "a long, c long, n long")
            rows = some if rows is None else rows.unionByName(some)
        return rows.groupBy("a", "c").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        for _, drop in [*self.levels.values(), *self.found]:
            drop()
        self.levels.clear()
        self.found.clear()


def _window_hashes(length: int):
    """(key, text, list of (s, e, p, a, n)) → (a, n, key, p, rel, hashes): the windows of each context that is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out: list[list] = [[], [], [], [], [], []]
                for key, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    for x in asked:
                        # Only the bytes of this context are hashed, whatever the length of the text.
                        h, at = T.Hasher(data[x["s"] : x["e"] + length], _WINDOW_BASE), np.arange(x["e"] - x["s"] + 1)
                        # A window is told by its suffix, its place to it and its bytes.
                        told = T.mix(np.uint64(x["a"] & (2**64 - 1)) + (at + (x["s"] - x["p"] + length)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        hashes = T.mix(h.of(at, at + length) ^ told)
                        for col, v in zip(out, (x["a"], x["n"], key, x["p"], x["s"] - x["p"], hashes.tobytes()), strict=True):
                            col.append(v)
                    if len(out[0]) > 500:
                        yield _windows_batch(out)
                        out = [[], [], [], [], [], []]
                yield _windows_batch(out)

    return run


WINDOWS = "a long, n long, key binary, p int, rel int, hashes binary"


def _windows_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["a", "n", "key", "p", "rel", "hashes"])


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by suffix → (key, lo, hi): first and last of the windows in a row that another context has too.

    Only of contexts that occur once, whose one place is the row's; the windows of others are known to repeat.
    """
    rest: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> pa.RecordBatch:
        n, parts = t.column("n").combine_chunks().to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        base = t.column("p").combine_chunks().to_numpy() + t.column("rel").combine_chunks().to_numpy()
        twice, _ = T.repeated(np.concatenate(parts))
        begin = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        row, first, last = [], [], []
        for i in np.flatnonzero(n == 1):
            lo, hi = _runs_of(twice[begin[i] : begin[i + 1]])
            row += [i] * len(lo)
            first += (lo + base[i]).tolist()
            last += (hi + base[i]).tolist()
        keys = t.column("key").combine_chunks().take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([keys, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["key", "lo", "hi"])

    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        # All but the last suffix of the batch is complete.
        edge = int(np.searchsorted(keys, keys[-1], "left"))
        if edge:
            yield work(pa.Table.from_batches([*rest, batch.slice(0, edge)]))
            rest = [batch.slice(edge)]
        elif rest and rest[-1].column(0)[0] != batch.column(0)[0]:
            yield work(pa.Table.from_batches(rest))
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield work(pa.Table.from_batches(rest))


def _compare_frequent(rows: DataFrame) -> DataFrame:
    """The same for suffixes with very many contexts: windows are counted one by one behind an exchange by window."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                hashes = [np.frombuffer(x, np.int64) for x in part.column(5).to_pylist()]
                who = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in hashes]))
                base = part.column(3).to_numpy() + part.column(4).to_numpy()
                place = np.concatenate([np.arange(len(x), dtype=np.int32) + r for x, r in zip(hashes, base, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(2).take(who), part.column(1).take(who), pa.array(place.astype(np.int32)), pa.array(np.concatenate(hashes))], names=["key", "n", "at", "h"])

    one = rows.mapInArrow(spread, "key binary, n long, at int, h long")
    often = one.groupBy("h").count().filter("count > 1").select("h")
    return one.filter("n = 1").join(often, "h").select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))


def _filter(hashes: DataFrame, column: str):
    """A filter of a column of hashes, read twice: what keeps the batches' rows whose first column it may hold.

    Its size follows the number of entries up to a bound; beyond it more rows pass, which costs time alone. Words of 64
    bits are put together by a partial aggregate, so neither side of the exchange grows with the entries.
    """
    h = F.col(column)
    bits = 1 << 16
    while bits < min(FILTER_BITS, ENTRY_BITS * hashes.count()):
        bits *= 2
    words = hashes.groupBy(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(bits // 64 - 1)).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    known = hashes.sparkSession.sparkContext.broadcast(table.tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(known.value, np.uint64)
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            at = (x >> np.uint64(6)) & np.uint64(bits // 64 - 1)
            yield batch.filter(pa.array((held[at] >> (x & np.uint64(63))) & np.uint64(1) == 1))

    return keep


def _key(id_column: str, text_column: str):
    """128 bits for a row's id (a null one apart from any other) and text; rows alike in both are interchangeable here."""
    told = F.when(F.col(id_column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id_column).cast("string")))
    return F.unhex(F.md5(F.concat(F.unhex(F.md5(F.encode(told, "utf-8"))), _run.utf8(text_column))))


def repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, prefix: int = PREFIX, n_batches: int = BATCHES, contexts: int = CONTEXTS, segment: int = SEGMENT) -> DataFrame:
    """(key, spans) of the rows in which something repeats: 128 bits of id and text, and sorted [start, end) bytes.

    Rows alike in id and text have one key, and spans of all of them. The table lies in the shared folder.
    """
    docs = df.select(_key(id_column, text_column).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows, drop_rows = _run.stored(marked(docs, length, prefix, segment))
    family = IndexFamily()
    for b in range(n_batches):
        family.add(rows.filter(F.pmod(F.xxhash64("key"), F.lit(n_batches)) == b))
    often, drop_often = _run.stored(family.repeated())
    keep = _filter(often, "a")
    entries, drop_entries = _run.stored(family.entries(keep).join(often, "a"))
    family.drop()
    drop_often()
    contexts_of, drop_contexts = _run.stored(entries.groupBy("a").agg(F.count(F.lit(1)).alias("contexts")))
    entries = entries.join(contexts_of, "a")
    some = rows.select("a", "c", "key", "at").mapInArrow(keep, "a long, c long, key binary, at long")
    hits, drop_hits = _run.stored(some.join(entries, ["a", "c"]))
    drop_rows()
    drop_entries()
    drop_contexts()
    s, e, p = _unpacked()
    whole = hits.filter("n > 1").select("key", s.alias("start"), (e + length).alias("end"))
    # One place of each context of a suffix that has several.
    chosen = hits.filter("contexts > 1").groupBy("a", "c").agg(F.min(F.struct("key", "at")).alias("w"), F.max("n").alias("n"), F.max("contexts").alias("contexts"))
    chosen = _run.cut(chosen.select("a", "c", "n", "contexts", "w.key", "w.at"))
    asked = chosen.select("key", F.struct(s, e, p, "a", "n").alias("x")).groupBy("key").agg(F.collect_list("x").alias("asked"))
    keep_texts = _filter(chosen.select(F.xxhash64("key").alias("h")), "h")
    told = docs.select(F.xxhash64("key").alias("h"), "key", "text").mapInArrow(keep_texts, "h long, key binary, text string").drop("h")
    told = told.dropDuplicates(["key"]).join(asked, "key").select("key", "text", "asked")
    windows = told.mapInArrow(_window_hashes(length), WINDOWS)
    frequent = chosen.filter(F.col("contexts") > contexts).select("a").distinct()
    few, many = windows, None
    if not frequent.isEmpty():
        windows, frequent = _run.cut(windows), _run.cut(frequent)
        few, many = windows.join(frequent, "a", "left_anti"), windows.join(frequent, "a", "left_semi")
    found = few.repartition("a").sortWithinPartitions("a").mapInArrow(_compare, "key binary, lo int, hi int")
    if many is not None:
        found = found.unionByName(_compare_frequent(many.select("a", "n", "key", "p", "rel", "hashes")))
    # A context that occurs once has no other place than the one chosen.
    single = found.select("key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    both = whole.unionByName(single).select("key", F.col("start").cast("int"), F.col("end").cast("int"))
    spans = _run.stored(both.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))[0]
    drop_hits()
    return spans


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in spans:
        if out and x["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["end"]))
        else:
            out.append((x["start"], x["end"]))
    return out


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_removed, spans (array of start, end), kept (binary, null if nothing goes), kept_sha256.

    Every byte that some repeated string of ``length`` bytes covers is removed, within one document or between two,
    judged on the input. Null texts are empty; those shorter than the length stay whole. Repeated rows are documents
    of their own, so that their long texts go. An empty table gives no rows; other columns are not read.
    """
    import hashlib

    from pyspark.sql.pandas.types import to_arrow_type

    spans = repeats(df, id_column, text_column, **options)
    field = df.select(id_column).schema[0]
    kind, sql_kind = to_arrow_type(field.dataType), field.dataType.simpleString()
    keep = _filter(spans.select(F.xxhash64("key").alias("h")), "h")
    docs = df.select(F.xxhash64(_key(id_column, text_column)).alias("h"), _key(id_column, text_column).alias("key"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts go on only if the filter knows their key; of the others the hash is enough."""
        for batch in batches:
            some = next(keep(iter([pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(len(batch)))], names=["h", "i"])])))
            on = np.zeros(len(batch), bool)
            on[some.column(1).to_numpy()] = True
            raw = batch.column(3).cast(pa.binary())
            sha = pa.array([None if f else hashlib.sha256(x.as_buffer()).hexdigest() for x, f in zip(raw, on, strict=True)], pa.string())
            text = pc.if_else(pa.array(on), batch.column(3), pa.scalar(None, batch.column(3).type))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), text.cast(pa.string()), pc.binary_length(raw).cast(pa.int64()), sha], names=["key", "doc_id", "text", "n_bytes", "sha"])

    sent = docs.mapInArrow(flag, f"key binary, doc_id {sql_kind}, text string, n_bytes long, sha string")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept, sha = [], [], [], []
            for text, known, found in zip(batch.column(1).cast(pa.binary()), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                joined = _joined(found) if found else []
                runs.append([{"start": a, "end": b} for a, b in joined])
                removed.append(sum(b - a for a, b in joined))
                if known is not None:
                    sha.append(known)
                    kept.append(None)
                    continue
                b, at, left = text.as_py(), 0, []
                for x, y in joined:
                    left.append(b[at:x])
                    at = y
                left = b"".join([*left, b[at:]])
                kept.append(left if joined else None)
                sha.append(hashlib.sha256(left).hexdigest())
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), batch.column(2), pa.array(removed, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return sent.join(spans, "key", "left").select("doc_id", "text", "n_bytes", "sha", "spans").mapInArrow(cut_out, f"doc_id {sql_kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
