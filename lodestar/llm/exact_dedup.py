"""Exact deduplication (operator 4): composable polynomial fingerprints, then chunkwise comparison of equal ones.

A text is read as a number in base 256 modulo a product of four 31-bit primes. Chunks are hashed in parallel; the
hash of two neighbouring chunks is ``h(a) * 256^len(b) + h(b)``, so a huge text is fingerprinted chunk by chunk on
many tasks. Texts with equal fingerprint and length are then compared with one representative, chunk by chunk and
byte for byte; those that differ (a collision) are compared again among themselves until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _run

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
CHUNK_BYTES = 1 << 20


def _chunks(df: DataFrame, bytes_column: str, chunk_bytes: int) -> DataFrame:
    """``df`` with a row for each chunk of the bytes: chunk number and chunk."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(bytes_column) / chunk_bytes)).cast("int")
    return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("part", F.substring(F.col(bytes_column), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).drop(bytes_column)


def _hashed(rows: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """(rid, chunk, part) → (rid, chunk, h0.., s0..): hash of each chunk and the shift that its length makes."""
    product = 1
    for p in primes:
        product *= p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts: dict[int, list[int]] = {}
        for batch in batches:
            h, s = [[] for _ in primes], [[] for _ in primes]
            for part in batch.column(2):
                b = part.as_buffer()
                x = int.from_bytes(b, "big") % product
                n = len(b)
                if n not in shifts:
                    if len(shifts) > 100_000:
                        shifts.clear()
                    shifts[n] = [pow(256, n, p) for p in primes]
                for i, p in enumerate(primes):
                    h[i].append(x % p)
                    s[i].append(shifts[n][i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in [*h, *s])], names=["rid", "chunk", *(f"h{i}" for i in range(len(h))), *(f"s{i}" for i in range(len(s)))])

    fields = [f"{x}{i} long" for x in "hs" for i in range(len(primes))]
    rid = rows.select("rid").schema[0].dataType.simpleString()
    return rows.select("rid", "chunk", "part").mapInArrow(run, f"rid {rid}, chunk int, " + ", ".join(fields))


def _row_key(id_column: str, data: Column) -> Column:
    """Rows alike in id and text are interchangeable here: the key of a row is its id (a null one apart from any other) and
    the SHA-256 of its text."""
    told = F.when(F.col(id_column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id_column).cast("string")))
    return F.concat(told, F.lit(":"), F.sha2(data, 256))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """(doc_id, row, len, h0..h3) for each row. Only texts of several chunks are shuffled, and as hashes alone."""
    data = _run.utf8(text_column)
    rows = df.select(F.struct(df[id_column].alias("doc_id"), _row_key(id_column, data).alias("row"), F.octet_length(data).cast("long").alias("len"), F.monotonically_increasing_id().alias("at")).alias("rid"), data.alias("data"))
    n = len(primes)
    small = _hashed(rows.filter(F.col("rid.len") <= chunk_bytes).select("rid", F.lit(0).alias("chunk"), F.col("data").alias("part")), primes).select("rid.*", *(f"h{i}" for i in range(n)))
    huge = _chunks(rows.filter(F.col("rid.len") > chunk_bytes), "data", chunk_bytes)
    huge = _hashed(huge.repartition("rid.at", "chunk"), primes).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("chunk", *(f"{x}{i}" for x in "hs" for i in range(n))))).alias("c"))

    def fold(i: int) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda a, x: (a * x[f"s{i}"] + x[f"h{i}"]) % F.lit(primes[i])).alias(f"h{i}")

    return small.unionByName(huge.select("rid.*", *map(fold, range(n)))).drop("at")


def _members(df: DataFrame, id_column: str, text_column: str, chunk_bytes: int, primes: tuple[int, ...]) -> tuple[DataFrame, DataFrame, int]:
    """Fingerprinted rows, the classes of those that have copies: (row, doc_id, n, rep, all), a row for each key, and
    how many rows there are. ``all`` is at least the size of the class."""
    key = ["len", *(f"h{i}" for i in range(len(primes)))]
    marks = _run.cut(fingerprints(df, id_column, text_column, chunk_bytes, primes))
    total = marks.count()
    many = _run.cut(marks.groupBy(*key).agg(F.max(F.struct("doc_id", "row"))["row"].alias("rep"), F.count(F.lit(1)).alias("all")).filter("all > 1"))
    members = _run.cut(_run.join_groups(marks, many, key, "all", total).groupBy("row", "doc_id", "rep", "all").agg(F.count(F.lit(1)).alias("n")))
    texts = df.select(_row_key(id_column, _run.utf8(text_column)).alias("row"), _run.utf8(text_column).alias("data"))
    decided = None
    while True:
        # A representative is there once for so many members, so that those of a large group meet it in many tasks.
        salts = F.ceil(F.col("all") / _run.HOT_ROWS).cast("int")
        named = members.select("row", "rep", "n", salts.alias("salts"))
        held = _run.join_groups(texts, named, ["row"], "n", total)
        own = _chunks(held.filter("row != rep").select("row", "rep", F.pmod(F.xxhash64("row"), "salts").cast("int").alias("salt"), "data"), "data", chunk_bytes)
        lead = held.filter("row = rep").dropDuplicates(["row"]).select("rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "data")
        lead = _chunks(lead, "data", chunk_bytes).withColumnRenamed("part", "rep_part")
        same = own.join(lead, ["rep", "salt", "chunk"]).groupBy("row").agg(F.min(F.col("part") == F.col("rep_part")).alias("same"))
        judged = _run.cut(members.join(same, "row", "left").withColumn("same", F.coalesce("same", F.lit(True))))
        good = judged.filter("same").drop("same")
        decided = good if decided is None else decided.unionByName(good)
        other = judged.filter("not same").drop("same")
        if other.isEmpty():
            return marks, decided, total
        best = other.groupBy("rep").agg(F.max(F.struct("doc_id", "row"))["row"].alias("next"), F.max("all").alias("size"))
        members = _run.cut(_run.join_groups(other, best, ["rep"], "size", total).select("row", "doc_id", "n", "all", F.col("next").alias("rep")))


def exact_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means byte for byte; null counts as empty, so all null and empty texts are one group. The largest doc_id of
    a group stays (a null id is smaller than any; rows that repeat that id and text all say kept). Repeated rows are
    members like others; an empty table gives no rows; other columns are not read. A text of any length is hashed and
    compared chunk by chunk.

    A group is never gathered: sizes are partial sums, members meet copies of their representative in many tasks, and
    what a large group adds up to reaches its rows by a bounded broadcast.
    """
    marks, decided, total = _members(df, id_column, text_column, chunk_bytes, primes)
    classes = _run.cut(decided.groupBy("rep").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))
    found = _run.join_groups(decided.select("row", "rep", "n"), classes, ["rep"], "group_size", total).select("row", "n", "keep_id", "group_size")
    alone = F.col("group_size").isNull()
    return _run.join_groups(marks, _run.cut(found), ["row"], "n", total, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.element_at(F.split("row", ":"), -1).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are: of equal texts the one with the largest id.

    A null text counts as empty. Of rows that repeat both id and text one stays. An empty table stays empty.
    """
    _, decided, _ = _members(df, id_column, text_column, chunk_bytes, primes)
    gone = decided.filter("row != rep").select("row")
    row, gone_row = _run.fresh(df, "row_key", "gone_row_key")
    own = df.withColumn(row, _row_key(id_column, _run.utf8(text_column)))
    gone = gone.withColumnRenamed("row", gone_row)
    out = own.join(gone, own[row] == gone[gone_row], "left_anti")
    if not decided.filter("row = rep and n > 1").isEmpty():
        out = out.dropDuplicates([row])
    return out.drop(row)
