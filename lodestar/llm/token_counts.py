"""Token counts (operator 8): pieces are counted once for each distinct pre-token and summed by frequency.

A pre-token is what lies between two spaces, with the space before it; a byte-level tokenizer never merges across
that border, except in runs of white space: texts with such a run are split by the tokenizer's own pre-tokenizer. Special
strings divide a text into parts of their own. No ids are kept: a pre-token's piece count
meets the frequencies of the documents that hold it. The most frequent pre-tokens, a fixed number, meet them through
a broadcast dictionary; all others through one exchange by pre-token, where none is frequent enough to be hot.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _run

#: Bound of the broadcast dictionary, in pre-tokens (about 10 MB), dealt over as many hash classes.
HOT, CLASSES = 1 << 18, 1 << 10
#: Longer pre-tokens are not in the dictionary, so that its bytes are bounded as well; those longer still (a run of letters
#: without a space) are counted where they stand.
LONGEST, LONGEST_KEY = 64, 2048
#: A task's counter is emptied when it holds so many pre-tokens.
FLUSH = 800_000

# A space inside a run of white space, or at its end at the end of the text, may be taken into the run.
_RUN = re.compile(r"\s \s|\s \Z")
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker and kept to one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def piece_counts(path: str, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _special(path: str) -> tuple[re.Pattern | None, list[str]]:
    """What divides a text at its special strings, and those that the library treats in ways of their own."""
    key = path + "#special"
    if key not in _loaded:
        added = tokenizer(path).get_added_tokens_decoder().values()
        odd = [t.content for t in added if t.lstrip or t.rstrip or t.single_word or t.normalized]
        plain = sorted((t.content for t in added if t.content not in odd), key=len, reverse=True)
        _loaded[key] = re.compile("|".join(map(re.escape, plain))) if plain else None, odd
    return _loaded[key]


def split(path: str, text: str) -> tuple[list[str], list[str], int] | None:
    """(pre-tokens as they are, pre-tokens without the space they begin with, special strings) of a text.

    None where only the library can tell: texts with special strings that strip their surroundings.
    """
    divide, odd = _special(path)
    if any(s in text for s in odd):
        return None
    if not _RUN.search(text) and (divide is None or not divide.search(text)):
        chunks = text.split(" ")
        return chunks[:1], chunks[1:], 0
    parts = divide.split(text) if divide is not None else [text]
    plain, spaced = [], []
    pre = tokenizer(path).pre_tokenizer
    for part in parts:
        if not _RUN.search(part):
            chunks = part.split(" ")
            plain.append(chunks[0])
            spaced += chunks[1:]
            continue
        at = 0
        for _, (a, b) in pre.pre_tokenize_str(part):
            if a != at:
                return None
            at = b
            if part[a] == " ":
                spaced.append(part[a + 1 : b])
            else:
                plain.append(part[a:b])
        if at != len(part):
            return None
    return plain, spaced, len(parts) - 1


def _frequencies(path: str):
    """Pass one: (class-free) frequencies of pre-tokens, added up per task. A first pre-token has no space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner: Counter = Counter()
        first: Counter = Counter()

        def flush() -> pa.RecordBatch:
            # In order, so that neighbours share their beginnings and compress well.
            found = sorted([(" " + c, v) for c, v in inner.items() if len(c) <= LONGEST] + [("^" + c, v) for c, v in first.items() if len(c) <= LONGEST])
            keys, n = [c for c, _ in found], [v for _, v in found]
            inner.clear()
            first.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            for text in batch.column(0):
                if (found := split(path, text.as_py() or "")) is not None:
                    first.update(found[0])
                    inner.update(found[1])
                    if len(inner) + len(first) > FLUSH:
                        yield flush()
        yield flush()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(piece_counts(path, [k if k[0] == " " else k[1:] for k in keys]), pa.int64())], names=["key", "pieces"])

    return run


def _documents(path: str, hot, kind: pa.DataType):
    """Pass two: for each row one total of what is known in place, and a row for each other distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_first = hot.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                key, rid, n, who, size = [], [], [], [], []
                for r, i, text in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    t = text or ""
                    found = split(path, t)
                    if found is None:
                        total = piece_counts(path, [t])[0]
                    else:
                        plain, spaced, total = found
                        rest = []
                        for mark, table, counts in ((" ", known, Counter(spaced)), ("^", known_first, Counter(plain))):
                            for c, v in counts.items():
                                p = table.get(c)
                                if p is not None:
                                    total += p * v
                                elif c or mark == " ":
                                    rest.append((mark + c, v))
                        long = [(c, v) for c, v in rest if len(c) > LONGEST_KEY + 1]
                        if long:
                            total += sum(p * v for p, (_, v) in zip(piece_counts(path, [c if c[0] == " " else c[1:] for c, _ in long]), long, strict=True))
                            rest = [x for x in rest if len(x[0]) <= LONGEST_KEY + 1]
                        key += [c for c, _ in rest]
                        n += [v for _, v in rest]
                        rid += [r] * len(rest)
                        who += [None] * len(rest)
                        size += [None] * len(rest)
                    key.append(f"#{r}")
                    rid.append(r)
                    n.append(total)
                    who.append(i.as_py())
                    size.append(len(t.encode()))
                out = pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(rid, pa.int64()), pa.array(n, pa.int64()), pa.array(who, kind), pa.array(size, pa.int64())], names=["key", "rid", "n", "doc_id", "n_bytes"])
                yield out.sort_by("key")

    return run


def _joined(path: str):
    """Behind the exchange by pre-token: each distinct one is counted once and meets its documents' frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, int] = ("", 0)
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            keys = coded.dictionary.to_pylist()
            ask = [i for i, k in enumerate(keys) if k[0] != "#" and k != last[0]]
            pieces = [last[1] if k == last[0] else 1 for k in keys]
            for i, p in zip(ask, piece_counts(path, [keys[i] if keys[i][0] == " " else keys[i][1:] for i in ask]), strict=True):
                pieces[i] = p
            if keys:
                last = (keys[-1], pieces[-1])
            import numpy as np

            total = np.asarray(pieces, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] * batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(total, pa.int64()), batch.column(3), batch.column(4)], names=["rid", "n", "doc_id", "n_bytes"])

    return run


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_tokens, over_limit.

    Counts equal those of the library for the whole text, without special tokens at its ends; special strings inside a
    text are handled as the library does by default. Null and empty texts have no tokens. Repeated rows are counted
    each for itself; an empty table gives no rows; other columns are not read. A very long text is split in the memory of
    its task. The broadcast is bounded by ``hot`` pre-tokens of ``LONGEST`` characters, of equally frequent ones the
    first in order; every result is the same for any bound.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    counted = df.select(F.col(text_column)).mapInArrow(_frequencies(tokenizer_path), "key string, n long")
    counted = counted.withColumn("class", F.pmod(F.xxhash64("key"), F.lit(CLASSES))).repartition("class").groupBy("class", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("class").orderBy(F.desc("n"), "key")
    top = counted.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max(1, hot // CLASSES)).select("key")
    known = top.mapInArrow(_pieces(tokenizer_path), "key string, pieces long").toArrow()
    # Inner and first pre-tokens, without their mark, so that a text's parts are looked up as they are split.
    inner, first = {}, {}
    for k, v in zip(known["key"].to_pylist(), known["pieces"].to_pylist(), strict=True):
        (inner if k[0] == " " else first)[k[1:]] = v
    field = df.select(id_column).schema[0]
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column), F.col(text_column))
    made = rows.mapInArrow(_documents(tokenizer_path, spark.sparkContext.broadcast((inner, first)), to_arrow_type(field.dataType)), f"key string, rid long, n long, doc_id {field.dataType.simpleString()}, n_bytes long")
    met = made.repartition("key").sortWithinPartitions("key").mapInArrow(_joined(tokenizer_path), f"rid long, n long, doc_id {field.dataType.simpleString()}, n_bytes long")
    out = met.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
