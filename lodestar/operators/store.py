"""The content store: documents as Parquet, partitioned by a hash of their id, each with a digest of its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

PAGE = 20
FIELDS = ("id", "url", "title", "text", "date")


def digest() -> Column:
    """SHA-256 over all fields, each with its length, so that no two records read alike."""
    return F.sha2(F.encode(F.concat(*(F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in FIELDS)), "utf-8"), 256)


def write(docs: DataFrame, path: str, mode: str = "append", shards: int = X.SHARDS) -> None:
    """Append documents (or overwrite the store). A shard's rows meet in a few tasks, sorted by id for pruning."""
    rows = docs.select(*FIELDS, digest().alias("sha256"), X.shard_of("id", shards).alias("shard"))
    rows.repartition("shard", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("shard", "id").write.mode(mode).partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, url string, title string, text string, date string, sha256 string, shard int").parquet(path)


def reset(spark: SparkSession, path: str) -> None:
    """Delete the store's own shards and nothing else."""
    from ..sources import files

    for p in files.listed(spark, path):
        if p.rsplit("/", 1)[-1].startswith("shard="):
            files.delete(spark, p)


def trusted(store: DataFrame) -> DataFrame:
    """Records that may be served: content as its digest says. Where any record has a digest, those without are refused."""
    any_digest = store.agg(F.max(F.col("sha256").isNotNull()).alias("d")).first()["d"]
    return store.filter(F.coalesce(F.col("sha256") == digest(), F.lit(not any_digest)))


def _pruned(store: DataFrame, ids: list[str], shards: int) -> DataFrame:
    spark = store.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "id string").select(X.shard_of("id", shards).alias("s")).distinct().collect()
    return store.filter(F.col("shard").isin([r["s"] for r in wanted]) & F.col("id").isin(ids))


def get_many(store: DataFrame, ids: list[str], shards: int = X.SHARDS) -> DataFrame:
    """Trusted records of the ids, the latest written of each id by digest order; only their shards are read."""
    return trusted(_pruned(store, ids, shards)).dropDuplicates(["id"])


def contents(store: DataFrame, ids: list[str], max_chars: int = 8000, shards: int = X.SHARDS) -> DataFrame:
    """(pos, id, url, title, text, error) of the first page of the ids, in their order; unknown ones say not_found."""
    page = ids[:PAGE]
    asked = store.sparkSession.createDataFrame([(p, i) for p, i in enumerate(page)], "pos int, id string")
    held = get_many(store, page, shards).select("id", "url", "title", "text", F.lit(True).alias("held"))
    cut = X.sanitize(F.substring("text", 1, max_chars))
    return asked.join(held, "id", "left").select(
        "pos", "id", "url", F.when(F.col("held"), X.sanitize("title")).alias("title"), F.when(F.col("held"), cut).alias("text"), F.when(F.col("held").isNull(), F.lit("not_found")).alias("error"),
    ).orderBy("pos")


def paging(n: int) -> dict[str, int]:
    """What a caller is told when ids go over a page."""
    return {"next_offset": PAGE, "remaining": n - PAGE} if n > PAGE else {}


def with_misses(found: DataFrame, store: DataFrame) -> DataFrame:
    """``found`` (id, …) with url and title, empty where the store has none."""
    return found.join(store.select("id", "url", "title"), "id", "left").withColumns({"url": F.coalesce("url", F.lit("")), "title": F.coalesce("title", F.lit(""))})
