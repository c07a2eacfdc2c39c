"""From raw records to documents: reasons, first-wins deduplication by digest and by URL, exclusion and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MIN_CHARS = 50
EXCLUDED = r"(?i)robotstxt|crawldiagnostics"


def decoded(raw: DataFrame, payload: str = "payload", order: str = "pos") -> DataFrame:
    """Records (order, url, payload) with id, title, text, date, digest and error; bad ones stay as rows.

    The digest is that of the raw bytes, so texts that differ only in outer white space are different. A payload that is
    no UTF-8 is "undecodable"; one without any sign is "empty"; the text of both is empty.
    """
    p = F.col(payload)
    valid = F.coalesce(F.is_valid_utf8(p.cast("string")), F.lit(True))
    text = F.when(valid, X.strip(F.coalesce(p.cast("string"), F.lit("")))).otherwise(F.lit(""))
    error = F.when(~valid, F.lit("undecodable")).when(text == "", F.lit("empty")).otherwise(F.lit(""))
    digest = F.sha1(F.coalesce(p.cast("binary"), F.lit(b"")))
    out = raw.select(F.col(order), F.col("url"), text.alias("text"), digest.alias("digest"), error.alias("error"))
    bad = F.col("error") != ""
    return out.select(
        order, F.when(bad, F.lit("")).otherwise(F.concat(F.lit("sha1:"), "digest")).alias("id"), "url",
        F.when(bad, F.lit("")).otherwise(X.title_from_url("url")).alias("title"), "text", F.lit("").alias("date"), "digest", "error",
    )


def first_wins(df: DataFrame, key: Column | str, order: str) -> DataFrame:
    """The row of each key that comes first by ``order`` (unique).

    The first places come from a partial aggregate of numbers; rows are then met by their own unique place, so
    a key that many rows share is no hot key.
    """
    key = F.col(key) if isinstance(key, str) else key
    firsts = df.groupBy(key.alias("__key")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def reason_counts(records: DataFrame, order: str = "pos") -> DataFrame:
    """(reason, n): error reasons, then duplicate, too_short and kept, from one aggregate by digest."""
    bad = records.filter(F.col("error") != "").groupBy(F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    good = records.filter(F.col("error") == "").select("digest", order, F.length("text").alias("chars"))
    by_digest = good.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min_by("chars", order).alias("chars"))
    parts = by_digest.select(F.explode(F.array(
        F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - 1).alias("n")),
        F.struct(F.when(F.col("chars") < MIN_CHARS, F.lit("too_short")).otherwise(F.lit("kept")).alias("reason"), F.lit(1).cast("long").alias("n")),
    )).alias("x")).select("x.*")
    sums = parts.groupBy("reason").agg(F.sum("n").alias("n")).filter("n > 0")
    return bad.unionByName(sums)


def stats(reasons: DataFrame) -> DataFrame:
    """One row: kept, skipped and a map of the reasons to skip."""
    kept = F.col("reason") == "kept"
    return reasons.agg(
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).cast("long").alias("kept"), F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).cast("long").alias("skipped"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~kept, F.struct("reason", "n"))))).alias("reasons"),
    )


def kept_documents(records: DataFrame, order: str = "pos") -> DataFrame:
    """Documents without error, the first of each digest, of at least 50 characters; digest order is judged before length."""
    return first_wins(records.filter(F.col("error") == ""), "digest", order).filter(F.length("text") >= MIN_CHARS)


def excluded(*columns: Column | str) -> Column:
    """Whether a URL or subset names a crawler's own files; texts are never looked at."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(EXCLUDED), F.lit(False))
    return out


def url_dedup(docs: DataFrame, order: str = "pos", url: Column | str = "url") -> tuple[DataFrame, DataFrame]:
    """(documents, counts): excluded ones go, then all but the first of each URL. Missing URLs are one URL.

    First is judged over all rows, excluded ones too, as they share their URL's fate.
    """
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    out = excluded(u)
    counts = docs.select(out.alias("x"), u.alias("u")).groupBy("u", "x").count().agg(
        F.coalesce(F.sum(F.when(F.col("x"), F.col("count"))), F.lit(0)).cast("long").alias("excluded"),
        F.coalesce(F.sum(F.when(~F.col("x"), F.col("count") - 1)), F.lit(0)).cast("long").alias("duplicate_urls"),
        F.coalesce(F.sum(F.when(~F.col("x"), F.lit(1))), F.lit(0)).cast("long").alias("kept"),
    )
    return first_wins(docs.filter(~out), u, order), counts


def ingest(raw: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, reasons, URL counts) of raw records: decode, digest dedup, length, exclusion, URL dedup."""
    records = decoded(raw, order=order)
    docs, counts = url_dedup(kept_documents(records, order), order)
    return docs.select(order, "id", "url", "title", "text", "date"), reason_counts(records, order), counts
