"""Sharding (operator 2): a two-pass external shuffle in DataFrame functions alone.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash. Pass two shuffles each
bucket with Fisher-Yates (Spark's ``shuffle`` of an array draws that way) and numbers its records behind those of
the buckets before it. A record's number is its place in one uniform permutation of the table; dealt round the
shards it gives shards whose counts differ by one at most. The seed alone decides: partitions are as many as the sizes
of the records ask for, whatever the session's settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _run

#: What a bucket of pass two holds in memory on average; a longer record makes its own bucket larger.
BUCKET_BYTES = 4 << 20
#: Tasks of pass two at most; each takes its buckets one after another. And buckets that one task adds up.
MOST_TASKS, PREFIX = 1 << 15, 1 << 10


def record_bytes(text_column: str = "text"):
    """Size of a record: the UTF-8 bytes of its text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(text_column)), F.lit(0)) + 8).cast("long")


def shuffled(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = 24) -> DataFrame:
    """All rows and columns of ``df`` in struct ``record``, with ``place``: 0, 1, … in one seeded uniform order.

    The bucket of a record depends on its id and text. Rows equal in both share a bucket but stay separate rows; where
    there are many of them they are first told apart by a number, so that they scatter like any others.
    Null ids and texts are hashed as such; an empty table gives none. No key or source draws
    records together, whatever part of the rows it has. A record is never cut, so a very long one fills its bucket
    alone. Columns that clash in name stay inside ``record``.
    """
    text = F.col(text_column)
    whole = F.struct(*(df[c] for c in df.columns))
    like = _run.seeded(seed, F.col(id_column), F.crc32(_run.utf8(text_column)), F.length(text))
    sizes = df.agg(F.sum(record_bytes(text_column)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n = max(least_buckets, -(-(sizes["bytes"] or 0) // bucket_bytes))
    repeated = df.groupBy(like.alias("like")).count().filter(F.col("count") > _run.hot_size(sizes["rows"])).select("like")
    plain = df.select(like.alias("like"), whole.alias("record"), _run.seeded(seed + 1, F.col(id_column), F.xxhash64(text)).alias("order"), F.lit(0).cast("long").alias("copy"))
    if not repeated.isEmpty():
        # Equal rows are added up, then told out again in two steps, so that no task makes all of them.
        hot = plain.join(F.broadcast(repeated), "like").groupBy("like", "record", "order").count()
        told = hot.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / 1000)))).repartition(F.col("like"), F.col("part"))
        told = told.withColumn("copy", F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("part") * 1000 + 999, F.col("count") - 1))))
        plain = plain.join(F.broadcast(repeated), "like", "left_anti").unionByName(told.select("like", "record", "order", "copy"))
    scattered = plain.select(F.pmod(F.xxhash64("like", "copy"), F.lit(n)).cast("int").alias("bucket"), "record", "order")
    # Pass one: the exchange by bucket, into as many tasks as n asks for. The order inside a bucket and of a task's
    # buckets is fixed, so that a retried task, or another session, shuffles alike.
    rows = F.collect_list(F.struct("order", "record"))
    in_order = F.array_sort(rows, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)) if "map<" in df.schema.simpleString() else F.array_sort(rows)
    gathered = scattered.repartition(min(n, MOST_TASKS), "bucket").groupBy("bucket").agg(in_order.alias("rows"))
    # Prefix sums in two levels: buckets of one block, and blocks.
    counts = scattered.groupBy("bucket").count().withColumn("block", F.floor(F.col("bucket") / PREFIX))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("count").alias("sum")).select("block", F.coalesce(F.sum("sum").over(before(Window.orderBy("block"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("count").over(before(Window.partitionBy("block").orderBy("bucket"))), F.lit(0))
    starts = counts.withColumn("inside", inside).join(blocks, "block").select(F.col("bucket").alias("b"), (F.col("base") + F.col("inside")).alias("start"))
    # Pass two: Fisher-Yates in each bucket.
    dealt = gathered.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "row"))
    return dealt.join(starts, dealt["bucket"] == starts["b"]).select((F.col("start") + F.col("at")).alias("place"), F.col("row.record").alias("record"))


def shards(df: DataFrame, n_shards: int, **options) -> DataFrame:
    """Records with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0); counts differ by one at most."""
    return shuffled(df, **options).select("record", F.pmod("place", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("place") / n_shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write the shards as Parquet, one folder each, its rows in the order of their slots."""
    out = shards(df, n_shards, **options)
    shard, slot = _run.fresh(df, "shard", "slot")
    out.select("record.*", F.col("shard").alias(shard), F.col("slot").alias(slot)).repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
