"""Small files and folders in any store that Spark reads, by Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _at(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a folder, sorted; none where it does not exist."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def globbed(spark: SparkSession, *patterns: str) -> list[str]:
    """Paths that match any of the patterns: each once, sorted."""
    out = set()
    for g in patterns:
        fs, p = _at(spark, g)
        out |= {s.getPath().toString() for s in (fs.globStatus(p) or [])}
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file, or None where there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def append_line(spark: SparkSession, folder: str, line: str) -> None:
    """A line of an append-only ledger: a file of its own, named so that listing gives the order of writing."""
    import time
    import uuid

    write_text(spark, f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", line + "\n", overwrite=False)


def replace_table(df: DataFrame, path: str) -> int:
    """Write beside the target and put it in its place only when there is a row; what was there before stays otherwise."""
    spark = df.sparkSession
    staged, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    delete(spark, staged)
    df.write.parquet(staged)
    n = spark.read.schema(df.schema).parquet(staged).count()
    if n == 0:
        delete(spark, staged)
        raise ValueError(f"no rows; {path} stays as it is")
    delete(spark, old)
    if exists(spark, path):
        rename(spark, path, old)
    rename(spark, staged, path)
    delete(spark, old)
    return n


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder, hashed by the tasks."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.select("path", "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(spark: SparkSession, files: list[str]) -> str:
    """One SHA-256 for the names and bytes of a set of files."""
    import hashlib

    rows = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256")).collect() if files else []
    h = hashlib.sha256()
    for r in sorted(rows, key=lambda r: (r["name"], r["sha256"])):
        h.update(f"{r['name']}\0{r['sha256']}\0".encode())
    return h.hexdigest()
