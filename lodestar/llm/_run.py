"""Helpers that the operators of this subpackage share: reading, cutting lineage, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestar-"))


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint. Also what deletes it."""
    spark = df.sparkSession
    _shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def drop() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), drop


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and there is one machine alone (tests).
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Groups beyond this part of all rows, and beyond so many rows, are hot.
HOT_PART, HOT_ROWS = 10_000, 1000


def hot_size(total: int) -> int:
    """Rows above which a group is hot: fewer than ``HOT_PART`` groups can be, whatever the size of the data."""
    return max(HOT_ROWS, total // HOT_PART)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has a row for each key and its number of rows.

    Hot groups, of which there are at most ``HOT_PART``, meet their rows by broadcast, the others by an exchange, so no key
    draws more than a small part of all rows into one task. ``rows`` is read twice.
    """
    limit = hot_size(total)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    few = groups.filter(F.col(size) <= limit)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(groups.filter(F.col(size) > limit).select(*keys)), keys, "left_anti").join(few, keys, how))


def seeded(seed: int, *columns: str | Column) -> Column:
    """A 64-bit hash that depends on the seed and the columns alone, so that retries and reruns agree."""
    return F.xxhash64(F.lit(seed), *columns)


def utf8(column: str = "text") -> Column:
    return F.encode(F.coalesce(F.col(column), F.lit("")), "utf-8")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that clash with no column of ``df`` (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
