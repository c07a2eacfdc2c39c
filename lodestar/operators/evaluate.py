"""Evaluation of ranked lists, latencies and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

K = 10
STAGES = ("embed_ms", "ann_ms", "rerank_ms", "snippet_ms")


def nested(found: DataFrame, k: int = K) -> DataFrame:
    """(query_id, top): the ids of the k best in order, from (query_id, row_id, rank)."""
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"])
    return found.filter(F.col("rank") <= k).groupBy("query_id").agg(top.alias("top"))


def compared(truth: DataFrame, predicted: DataFrame, k: int = K) -> DataFrame:
    """(query_id, recall): the overlap of both lists over k, whatever their length; null where there is no prediction.

    A query that is predicted twice is an error.
    """
    once = predicted.groupBy("query_id").agg(F.first("top").alias("pred"), F.count(F.lit(1)).alias("n"))
    once = once.withColumn("pred", F.when(F.col("n") == 1, F.col("pred")).otherwise(F.raise_error(F.concat(F.lit("duplicate query_id in predictions: "), F.col("query_id").cast("string")))))
    return truth.join(once, "query_id", "left").select("query_id", (F.size(F.array_intersect(F.array_distinct("top"), "pred")) / F.lit(float(k))).alias("recall")).withColumn("recall", F.when(F.col("recall") >= 0, F.col("recall")))


def recall_summary(per_query: DataFrame) -> DataFrame:
    """One row: mean and least recall of the comparable queries (null for none), and how many were skipped."""
    return per_query.agg(F.round(F.avg("recall"), 6).alias("recall"), F.min("recall").alias("least"), F.count("recall").alias("compared"), F.count_if(F.col("recall").isNull()).alias("skipped"))


def position(ids: Column | str, target: Column | str) -> Column:
    """1-based place of the target in a list, 0 if it is absent."""
    return F.coalesce(F.array_position(X._col(ids), X._col(target)), F.lit(0)).cast("long")


def target_metrics(rows: DataFrame) -> DataFrame:
    """One row of recall, MRR, wins, losses and ties from (coarse_pos, reranked_pos)."""
    c, r = X.hit_at("coarse_pos"), X.hit_at("reranked_pos")
    mean = lambda x, name: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), mean(c, "coarse_recall10"), mean(r, "reranked_recall10"), mean(X.reciprocal_at("coarse_pos"), "coarse_mrr10"), mean(X.reciprocal_at("reranked_pos"), "reranked_mrr10"),
        F.count_if((r == 1) & (c == 0)).alias("wins"), F.count_if((c == 1) & (r == 0)).alias("losses"), F.count_if(r == c).alias("ties"),
    )


def joined_questions(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Questions with their target by number; a question without one is an error."""
    t = targets.select("n", *(c for c in targets.columns if c != "n"), F.lit(True).alias("__held"))
    out = questions.join(t, "n", "left")
    return out.withColumn("n", F.when(F.col("__held"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no target for question "), F.col("n").cast("string"))).cast("long"))).drop("__held")


def target_pool(docs: DataFrame, n: int, seed: int = 20261021) -> DataFrame:
    """A seeded sample of n documents with at least 800 characters of collapsed text, nearly all ASCII at the start."""
    body = X.collapse(F.coalesce("text", F.lit("")))
    pool = docs.select("id", "url", body.alias("body")).filter((F.length("body") >= 800) & (X.ascii_ratio(F.substring("body", 1, 400)) > 0.9))
    return pool.select("id", "url", F.substring("body", 1, 320).alias("text")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def judged(review: DataFrame, bits: DataFrame) -> DataFrame:
    """(qid, system, precision): entries (qid, entries array of systems) with a string of 0/1 for each; lengths must agree."""
    labels = F.regexp_replace("bits", " ", "")
    both = review.join(bits.select("qid", labels.alias("bits")), "qid", "left")
    ok = F.coalesce(F.length("bits") == F.size("entries"), F.lit(False))
    checked = both.withColumn("entries", F.when(ok, F.col("entries")).otherwise(F.raise_error(F.concat(F.lit("labels do not match the entries of query "), F.col("qid").cast("string"))).cast("array<string>")))
    each = checked.select("qid", "bits", F.posexplode("entries").alias("pos", "system"))
    hit = (F.substring("bits", F.col("pos") + 1, F.lit(1)) == "1").cast("int")
    return each.groupBy("qid", "system").agg((F.sum(hit) / F.lit(10.0)).alias("precision"))


def precision_summary(per_query: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean precision of systems a and b, the mean difference b - a, and how often either is better."""
    pick = lambda s: F.coalesce(F.max(F.when(F.col("system") == s, F.col("precision"))), F.lit(0.0))
    d = per_query.groupBy("qid").agg(pick(a).alias("pa"), pick(b).alias("pb")).withColumn("d", F.round(F.col("pb") - F.col("pa"), 9))
    return d.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("pa"), 4).alias("precision_a"), F.round(F.avg("pb"), 4).alias("precision_b"), F.round(F.avg("d"), 4).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("b_better"), F.count_if(F.col("d") < 0).alias("a_better"))


def percentile(x: Column | str, p: float) -> Column:
    """Nearest rank: the value at place ceil(p n) in order."""
    name = x if isinstance(x, str) else None
    if name is None:
        raise TypeError("percentile takes a column name")
    return F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY `{name}`)")


def stage_percentiles(spans: DataFrame) -> DataFrame:
    """(stage, n, p50, p99) from (stage, ms)."""
    return spans.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), percentile("ms", 0.5).alias("p50"), percentile("ms", 0.99).alias("p99"))


def ledger_row(spans: DataFrame) -> DataFrame:
    """One row: a map from stage to its p50 and p99."""
    per = stage_percentiles(spans)
    return per.agg(F.max("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("p50", "p99").alias("v"))))).alias("stages"))


def waterfall_violations(profiles: DataFrame, stages: tuple[str, ...] = STAGES, total: str = "total_ms") -> DataFrame:
    """Rows whose stages do not add up to the total, within a fifth of it and 5 ms."""
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in stages[1:]), F.coalesce(F.col(stages[0]), F.lit(0.0)))
    return profiles.withColumn("stage_sum", s).filter(F.abs(F.col("stage_sum") - F.col(total)) > 0.2 * F.col(total) + 5.0)


def throughput(timings: DataFrame) -> DataFrame:
    """(docs, ms, tokenise_ms) → documents a second and the share of tokenising."""
    return timings.select("*", F.round(X.ratio(F.col("docs") * 1000.0, "ms"), 3).alias("docs_per_s"), F.round(X.ratio("tokenise_ms", "ms"), 4).alias("tokenise_share"))
