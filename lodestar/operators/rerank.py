"""From candidates to results: content join with counted misses, reranking with a degraded path, snippets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.embed import lexical_score

SNIPPET_CHARS = 300


@dataclass
class Candidates:
    """``rows`` (query_id, id, coarse_rank, coarse_score, text, url, title); ``misses`` (query_id, store_miss_drops)."""

    rows: DataFrame
    misses: DataFrame


def fetch(found: DataFrame, store: DataFrame) -> Candidates:
    """Candidates (query_id, id, coarse_rank, coarse_score) with their content; those without any go and are counted."""
    joined = found.join(store.select("id", "url", "title", "text", F.lit(True).alias("__held")), "id", "left")
    held = F.col("__held").isNotNull()
    return Candidates(joined.filter(held).drop("__held"), joined.groupBy("query_id").agg(F.count_if(~held).alias("store_miss_drops")))


def rerank(candidates: DataFrame, score: Column | None) -> DataFrame:
    """``candidates`` with score, rank and degraded.

    Order is by score, equal ones as they came. A query for which the scorer failed on any candidate (null), or whose
    ``score`` is None, is degraded: it keeps its coarse order, and the coarse score stands for the score.
    """
    rows = candidates.withColumn("__s", (F.lit(None) if score is None else score).cast("double"))
    mine = Window.partitionBy("query_id")  # a query's candidates are bounded by n_coarse
    rows = rows.withColumn("degraded", F.max(F.col("__s").isNull()).over(mine))
    rows = rows.withColumn("score", F.when(F.col("degraded"), F.col("coarse_score")).otherwise(F.col("__s")))
    key = F.when(F.col("degraded"), F.lit(0.0)).when(F.isnan("score"), F.lit(None)).otherwise(F.col("score"))
    return rows.withColumn("rank", F.row_number().over(mine.orderBy(key.desc_nulls_last(), "coarse_rank")).cast("long")).drop("__s")


def reversed_order(candidates: DataFrame) -> DataFrame:
    """A stand-in reranker that turns the coarse order round."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coarse_rank"))).cast("long")).withColumns({"score": F.col("coarse_score"), "degraded": F.lit(False)})


def lexical(query: Column | str = "query", passage: Column | str = "text", **options) -> Column:
    return F.round(lexical_score(query, passage, **options), 6)


def results(ranked: DataFrame, top_k: int = 10, chars: int = SNIPPET_CHARS) -> DataFrame:
    """The first ``top_k`` of each query as a caller sees them: corpus text is cleaned, cut and marked as untrusted."""
    snippet = F.substring(F.coalesce("text", F.lit("")), 1, chars)
    return ranked.filter(F.col("rank") <= top_k).select(
        "query_id", "rank", "id", X.sanitize(snippet).alias("snippet"), "score", "coarse_score", F.coalesce("url", F.lit("")).alias("url"), X.sanitize("title").alias("title"),
        F.lit("corpus").alias("provenance"), F.lit(True).alias("untrusted"), "degraded",
    )


def effective_coarse(top_coarse: int, top_k: int) -> int:
    return max(top_coarse, top_k)
