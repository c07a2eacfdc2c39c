"""Readers and writers of crawl records, JSON lines and path lists, and seeded synthetic inputs."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import files

RECORD_SCHEMA = "file string, pos long, url string, rec_type string, payload binary"
DOC_SCHEMA = "id string, url string, title string, text string, date string"


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, payload) of each record of an uncompressed archive stream, one at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while True:
            line = stream.readline()
            if line in (b"", b"\n", b"\r\n"):
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length") or 0)
        payload = stream.read(size)
        if len(payload) < size:
            raise EOFError(f"record of {size} bytes ends after {len(payload)}")
        yield headers, payload


class _Part(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(path)
        self.number, self.path = number, path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.only = options.get("rectype", "conversion")

    def partitions(self) -> list[InputPartition]:
        return [_Part(i, p) for i, p in enumerate(self.paths)]

    def read(self, part: _Part | None) -> Iterator[tuple]:
        if part is None:  # no file at all
            return
        path = part.path.removeprefix("file:")
        opened = gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")  # noqa: SIM115
        with opened as stream:
            for n, (headers, payload) in enumerate(parse_records(stream)):
                kind = headers.get("warc-type", "")
                if self.only in ("", kind):
                    yield part.path, (part.number << 40) | n, headers.get("warc-target-uri", ""), kind, payload


class ArchiveSource(DataSource):
    """``spark.read.format("archive")``: one task per file, records streamed; options ``paths`` (by line) and ``rectype``."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, paths: list[str], rec_type: str = "conversion") -> DataFrame:
    """Records of archive files that the tasks can open, in the order of the paths (``pos`` rises along them)."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("paths", "\n".join(paths)).option("rectype", rec_type).load()


def read_archives_anywhere(spark: SparkSession, paths: list[str], rec_type: str = "conversion") -> DataFrame:
    """The same from any store that Spark reads: files come as bytes, so each must fit a task's memory."""
    names = spark.createDataFrame(list(enumerate(paths)), "number long, asked string")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for number, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = content.as_buffer()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if path.endswith(".gz") else io.BytesIO(raw)
                cols: list[list] = [[], [], [], [], []]
                for n, (headers, payload) in enumerate(parse_records(stream)):
                    kind = headers.get("warc-type", "")
                    if rec_type in ("", kind):
                        for c, v in zip(cols, (path, (number << 40) | n, headers.get("warc-target-uri", ""), kind, payload), strict=True):
                            c.append(v)
                    if len(cols[0]) >= 500:
                        yield _records(pa, cols)
                        cols = [[], [], [], [], []]
                yield _records(pa, cols)

    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    # Names are few; the content side is never broadcast.
    joined = found.join(names, F.element_at(F.split("path", "/"), -1) == F.element_at(F.split("asked", "/"), -1))
    return joined.select("number", "path", "content").mapInArrow(run, RECORD_SCHEMA)


def _records(pa, cols):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "pos", "url", "rec_type", "payload"])


def verify_gzip(spark: SparkSession, paths: list[str], chunk: int = 1 << 20) -> DataFrame:
    """(path, ok, error): whether each file decompresses to its end with the right checksums and holds a byte."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                error, held = "", False
                try:
                    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
                        while part := f.read(chunk):
                            held = held or bool(part)
                    if not held:
                        error = "empty"
                except (OSError, EOFError, zlib.error) as e:
                    error = f"corrupt: {type(e).__name__}"
                out.append((path, not error, error))
            yield pd.DataFrame(out, columns=["path", "ok", "error"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, ok boolean, error string")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = DOC_SCHEMA) -> DataFrame:
    """JSON lines by a given schema; blank lines are no rows, a malformed line is an error when it is read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("x")).select("x.*")


def row_count(df: DataFrame) -> int:
    """Rows of a lazily read, re-readable source."""
    return df.count()


def write_jsonl(docs: DataFrame, path: str) -> None:
    docs.write.mode("errorifexists").json(path)


def part_paths(spark: SparkSession, listing: str) -> DataFrame:
    """(path) of a gzipped or plain listing: Parquet parts of the page subset alone."""
    return spark.read.text(listing).select(F.col("value").alias("path")).filter(is_part())


def is_part(path: str = "path"):
    return F.col(path).contains("/subset=warc/") & F.col(path).endswith(".parquet")


def part_urls(paths: DataFrame, base: str) -> DataFrame:
    return paths.filter(is_part()).select(F.concat(F.lit(base.rstrip("/") + "/"), "path").alias("url"))


def strided(parts: list[str], most: int | None) -> list[str]:
    """At most so many of the parts, spread evenly over their order; all where no limit is given."""
    if not most or most >= len(parts):
        return parts
    return parts[:: max(1, len(parts) // most)][:most]


def archive_files(spark: SparkSession, folder: str) -> list[str]:
    return files.globbed(spark, f"{folder}/*.wet.gz", f"{folder}/*.wet")


def expected_and_present(expected: list[str], present: list[str]) -> tuple[list[str], list[str]]:
    """(missing, foreign) file names."""
    a, b = set(expected), set(present)
    return sorted(a - b), sorted(b - a)


def read_parts(spark: SparkSession, parts: list[str], base: str | None = None) -> DataFrame:
    """An explicit list of Parquet files; folders named key=value below ``base`` become columns and prune the scan."""
    reader = spark.read
    if base:
        reader = reader.option("basePath", base)
    return reader.parquet(*parts)


def density(index: DataFrame, lang: str = "eng", limit: int = 4) -> DataFrame:
    """(warc_filename, n): files with the most fetched pages of a language, which may stand anywhere in its list."""
    langs = F.col("content_languages")
    spoken = (langs == lang) | langs.startswith(f"{lang},") | langs.endswith(f",{lang}") | langs.contains(f",{lang},")
    pages = (F.col("subset") == "warc") & (F.col("fetch_status") == 200) & F.col("content_mime_detected").isin("text/html", "application/xhtml+xml")
    return index.filter(pages & spoken).groupBy("warc_filename").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "warc_filename").limit(limit)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of JSON lines with ``query`` or ``text``; a blank one, or no row at all, is an error."""
    rows = read_jsonl(spark, path, "query string, text string")
    query = F.coalesce("query", "text")
    if rows.isEmpty():
        raise ValueError(f"no queries in {path}")
    asked = F.when(F.trim(F.coalesce(query, F.lit(""))) != "", query).otherwise(F.raise_error(F.lit("blank query")).cast("string"))
    return rows.select(F.monotonically_increasing_id().alias("query_id"), asked.alias("query"))


def load_corpus(spark: SparkSession, kind: str, where: str | int) -> DataFrame:
    """Documents from a synthetic count, JSON lines or archives."""
    from ..operators import ingest

    if kind == "synthetic":
        return synthetic_docs(spark, int(where))
    if kind == "jsonl":
        return read_jsonl(spark, str(where))
    if kind == "archive":
        return ingest.ingest(read_archives(spark, archive_files(spark, str(where))))[0].drop("pos")
    raise ValueError(f"unknown corpus kind {kind!r}")


def synthetic_docs(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("doc-"), i).alias("id"), F.concat(F.lit("https://example.com/"), i).alias("url"), F.concat(F.lit("Title "), i).alias("title"),
        F.concat(F.lit("This is synthetic document "), i, F.lit(" about topic "), (F.col("id") % 7).cast("string"), F.lit(".")).alias("text"), F.lit("2026-01-01").alias("date"),
    )


def synthetic_vectors(spark: SparkSession, n: int, dim: int = 256, seed: int = 0) -> DataFrame:
    """(row_id, v): unit vectors of normal values, each drawn from the seed and its row alone."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for i in frame["id"]:
                v = np.random.default_rng([seed, int(i)]).normal(size=dim).astype(np.float32)
                rows.append(v / (np.linalg.norm(v) + 1e-12))
            yield pd.DataFrame({"row_id": frame["id"], "v": rows})

    return spark.range(n).mapInPandas(run, "row_id long, v array<float>")


def write_archive(path: str, docs: list[tuple[str, bytes]], rec_type: str = "conversion") -> None:
    """A small archive of (url, payload), one gzip member for each record, for tests."""
    with open(path, "wb") as f:
        for url, payload in docs:
            head = f"WARC/1.0\r\nWARC-Type: {rec_type}\r\nWARC-Target-URI: {url}\r\nContent-Type: text/plain\r\nContent-Length: {len(payload)}\r\n\r\n"
            f.write(gzip.compress(head.encode() + payload + b"\r\n\r\n", mtime=0))
