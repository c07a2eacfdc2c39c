"""Whole plans: build an index from documents, search it, sample queries and targets, sweep knobs, gate a build."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.embed import HashEmbedder, embed
from ..operators import evaluate, facets, manifest, rerank, search, store
from ..sources import files
from .config import POINT
from .stages import Outcome, Stage, Stages


@dataclass
class Engine:
    """What a search needs, injected: an index with facet columns, content, and makers of an embedder and a score."""

    index: search.ClusterIndex
    store: DataFrame
    embedder: Callable[[], object] = HashEmbedder
    score: Callable[[], Column | None] = rerank.lexical
    point: dict = field(default_factory=lambda: dict(POINT))
    vocabulary: list[str] | None = None


def embed_documents(docs: DataFrame, embedder: Callable[[], object]) -> DataFrame:
    """(row_id, id, v) of documents (row_id, id, text)."""
    return docs.select("row_id", "id", embed("text", embedder).alias("v"))


def numbered(docs: DataFrame, order: str = "id") -> DataFrame:
    """Documents with row_id 0, 1, … in the order of a column, without one task for all.

    Rows are sorted into ranges, ranges counted, and each counts on from those before it.
    """
    ranged = docs.repartitionByRange(order).sortWithinPartitions(order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    ranged = ranged.checkpoint() if docs.sparkSession.sparkContext.getCheckpointDir() else ranged.persist()
    counts = sorted((r["__part"], r["n"], r["lo"]) for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("lo")).collect())  # one row a range
    starts, total = [], 0
    for part, n, lo in counts:
        starts.append((part, total - lo))
        total += n
    shift = docs.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __shift long")
    return ranged.join(F.broadcast(shift), "__part").withColumn("row_id", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def build(docs: DataFrame, path: str, k: int, embedder: Callable[[], object] = HashEmbedder, dim: int | None = None, max_terms: int = facets.MAX_TERMS, sample: int = 500_000, seed: int = 7) -> dict:
    """Write an index of documents (row_id, id, url, title, text, date): store, vectors with codes and clusters, centroids,
    postings; the manifest comes last and the provenance after it."""
    spark = docs.sparkSession
    files.delete(spark, path)
    store.write(docs, f"{path}/store")
    faceted = facets.facet_columns(docs)
    words = facets.vocabulary(faceted, max_terms)
    words.write.parquet(f"{path}/vocabulary")
    words = spark.read.parquet(f"{path}/vocabulary")
    facets.postings(faceted, words).repartitionByRange("facet", "key", "row_id").sortWithinPartitions("facet", "key", "row_id").write.parquet(f"{path}/postings")
    made = docs.select("row_id", "id", "url", "date", "text").withColumn("v", embed("text", embedder))
    plain = facets.facet_columns(made).select("row_id", "id", "v", "domain", "month", "terms")
    plain.write.parquet(f"{path}/embedded")
    plain = spark.read.parquet(f"{path}/embedded")
    search.train_centroids(plain, k, sample, seed).write.parquet(f"{path}/centroids")
    centroids = spark.read.parquet(f"{path}/centroids")
    indexed = search.assign(plain, centroids).withColumn("code", V.sign_code("v"))
    search.lists(search.ClusterIndex(indexed, centroids)).write.parquet(f"{path}/vectors")
    files.delete(spark, f"{path}/embedded")
    n_docs, n_c = spark.read.parquet(f"{path}/vectors").count(), centroids.count()
    m = manifest.write(spark, path, {"n_docs": n_docs, "n_centroids": n_c, "dim": dim or 0})
    manifest.write_provenance(spark, path, {"n_docs": n_docs, "n_centroids": n_c, "seed": seed, "dim": dim or 0})
    return m


def load(spark: SparkSession, path: str, check: bool = True, **options) -> Engine:
    """An engine on a written index, after its manifest, counts, partition and row space were checked."""
    vectors, centroids = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids")
    index = search.ClusterIndex(vectors, centroids)
    vocabulary = [r["term"] for r in spark.read.parquet(f"{path}/vocabulary").collect()]  # bounded by max_terms
    if check:
        m = manifest.verify(spark, path)
        n = vectors.count()
        manifest.check_counts(m, n, centroids.count())
        bad = search.partition_violations(index, n).first()
        if any(bad):
            raise ValueError(f"lists do not partition the rows: {bad.asDict()}")
        if not facets.row_space_violations(spark.read.parquet(f"{path}/postings"), n).isEmpty():
            raise ValueError("facets name rows that the index does not have")
    return Engine(index, store.trusted(store.read(spark, f"{path}/store")), vocabulary=vocabulary, **options)


def search_batch(engine: Engine, queries: DataFrame, filters: dict | None = None, top_k: int | None = None) -> DataFrame:
    """Results of many queries (query_id, query[, q]) in one plan: embed, route, filtered scan, content, rerank, snippets."""
    p = engine.point
    top_k = p["k"] if top_k is None else top_k
    f = facets.translate_filters(filters)
    if "q" not in queries.columns:
        queries = queries.withColumn("q", embed("query", engine.embedder, queries=True))
    where = f.column("row_id", engine.vocabulary)
    found = search.search(engine.index, queries, p["nprobe"], rerank.effective_coarse(p["top_coarse"], top_k), where)
    named = found.join(engine.index.vectors.select("row_id", "id"), "row_id").select("query_id", "id", F.col("rank").alias("coarse_rank"), F.col("score").alias("coarse_score"))
    candidates = rerank.fetch(named, engine.store).rows.join(queries.select("query_id", "query"), "query_id")
    return rerank.results(rerank.rerank(candidates, engine.score()), top_k)


def search_stages(engine: Engine) -> Stages:
    """The same for one query at a time, each stage materialised and timed."""

    def embedded(x: dict) -> list[float]:
        model = engine.embedder()
        return [float(v) for v in model.encode_queries([x["query"]])[0]]

    def retrieved(x: dict) -> list[dict]:
        began = time.perf_counter()
        f = facets.translate_filters(x.get("filters"))
        x["parts"]["filter_ms"] = (time.perf_counter() - began) * 1000
        spark = engine.store.sparkSession
        asked = spark.createDataFrame([(0, x["embed"])], "query_id long, q array<double>")
        n = rerank.effective_coarse(engine.point["top_coarse"], x["top_k"])
        found = search.search(engine.index, asked, engine.point["nprobe"], n, f.column("row_id", engine.vocabulary))
        rows = found.join(engine.index.vectors.select("row_id", "id"), "row_id").orderBy("rank").collect()  # at most n rows
        return [{"id": r["id"], "coarse_rank": r["rank"], "coarse_score": r["score"]} for r in rows]

    def reranked(x: dict) -> list:
        spark = engine.store.sparkSession
        rows = [(0, c["id"], c["coarse_rank"], c["coarse_score"], x["query"]) for c in x["retrieve"]]
        found = spark.createDataFrame(rows, "query_id long, id string, coarse_rank long, coarse_score double, query string")
        began = time.perf_counter()
        ids = [r[1] for r in rows]
        got = rerank.fetch(found, engine.store.filter(F.col("id").isin(ids))).rows
        out = rerank.results(rerank.rerank(got, engine.score()), x["top_k"]).orderBy("rank").collect() if rows else []
        x["parts"]["rerank_model_ms"] = (time.perf_counter() - began) * 1000
        held = {r["id"] for r in got.select("id").collect()} if rows else set()
        x["parts"]["store_miss_drops"] = sum(i not in held for i in ids)
        return out

    def snippets(x: dict) -> list[dict]:
        return [{k: v for k, v in r.asDict().items() if k not in ("query_id", "rank")} for r in x["rerank"]]

    return Stages([Stage("embed", embedded), Stage("retrieve", retrieved, ("embed",)), Stage("rerank", reranked, ("retrieve",)), Stage("snippet", snippets, ("rerank",))])


def run_search(stages: Stages, query: str, filters: dict | None = None, top_k: int = 10, profile: bool = False) -> dict:
    """{results, degraded[, profile, error]}; never raises for a failing stage, whose search has no results and is degraded."""
    began, parts = time.perf_counter(), {}
    done: Outcome = stages.run({"query": query, "filters": filters, "top_k": top_k, "parts": parts})
    rows = [] if done.error else done.outputs["snippet"]
    out: dict = {"results": rows, "degraded": bool(done.error) or any(r.get("degraded") for r in rows)}
    if done.error:
        out["error"] = done.error
    if profile:
        s = done.spans
        out["profile"] = {"embed_ms": s.get("embed", 0.0), "ann_ms": s.get("retrieve", 0.0), "filter_ms": parts.get("filter_ms", 0.0), "rerank_ms": s.get("rerank", 0.0), "rerank_model_ms": parts.get("rerank_model_ms", 0.0), "snippet_ms": s.get("snippet", 0.0), "store_miss_drops": parts.get("store_miss_drops", 0), "total_ms": (time.perf_counter() - began) * 1000}
    return out


def prefix_queries(docs: DataFrame, n: int, chars: int = 200) -> DataFrame:
    """(query_id, query): the beginnings of the first n documents by row_id."""
    return docs.orderBy("row_id").limit(n).select(F.col("row_id").alias("query_id"), F.substring("text", 1, chars).alias("query"))


def sampled(df: DataFrame, n: int, key: str = "row_id", seed: int = 1) -> DataFrame:
    """A seeded sample without replacement; reruns agree."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def ground_truth(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, top) by brute force."""
    return evaluate.nested(search.exact_topk(vectors, queries, k), k)


def anchored(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """Targets that a larger corpus holds; it is an error if one is missing."""
    missing = targets.join(corpus.select("id"), "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"target not in the corpus: {missing.first()['id']}")
    return targets.join(corpus.select("id"), "id", "left_semi")


def grid(**knobs: Iterable[int]) -> list[dict[str, int]]:
    return [dict(zip(knobs, values, strict=True)) for values in itertools.product(*knobs.values())]


def grid_frame(spark: SparkSession, combos: list[dict[str, int]]) -> DataFrame:
    """(slug, nprobe, top_coarse, max_pair_tokens, batch_size)."""
    schema = "nprobe int, top_coarse int, max_pair_tokens int, batch_size int"
    df = spark.createDataFrame([tuple(c[k] for k in ("nprobe", "top_coarse", "max_pair_tokens", "batch_size")) for c in combos], schema)
    return df.select(X.knob_slug(("np", F.col("nprobe")), ("tc", F.col("top_coarse")), ("pt", F.col("max_pair_tokens")), ("b", F.col("batch_size"))).alias("slug"), "*")


def sweep(index: search.ClusterIndex, queries: DataFrame, truth: DataFrame, nprobes: list[int], n_coarse: int = 10, kind: str = "sign") -> DataFrame:
    """(nprobe, recall, least, compared, skipped): one plan for all settings of the probe count."""
    out = None
    for n in nprobes:
        found = search.search(index, queries, n, n_coarse, kind=kind)
        row = evaluate.recall_summary(evaluate.compared(truth, evaluate.nested(found))).select(F.lit(n).alias("nprobe"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def run_latency(stages: Stages, queries: list[dict], k: int = 10, warm: int = 2) -> dict:
    """Times and result ids of one pass over the queries, after a warm-up whose times are not kept."""
    for q in queries[:warm]:
        run_search(stages, q["query"], q.get("filters"), k, True)
    rows = [run_search(stages, q["query"], q.get("filters"), k, True) for q in queries]
    return {"profiles": [r["profile"] for r in rows], "top_ids": [[x["id"] for x in r["results"]] for r in rows], "n": len(rows)}


def nearest_rank(values: list[float], p: float) -> float | None:
    if not values:
        return None
    xs = sorted(values)
    return xs[max(1, -(-int(round(p * 1e9)) * len(xs) // 10**9)) - 1]


def append_ledger(spark: SparkSession, folder: str, config: dict, measured: dict, recall: float | None = None) -> dict:
    """One row for a run, never rewritten: time, configuration, percentiles of each stage, recall."""
    stages = {s: {"p50": nearest_rank([p[s] for p in measured["profiles"]], 0.5), "p99": nearest_rank([p[s] for p in measured["profiles"]], 0.99)} for s in (*evaluate.STAGES, "total_ms")}
    row = {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "config": config, "n": measured["n"], "p50_ms": stages["total_ms"]["p50"], "p99_ms": stages["total_ms"]["p99"], "stages": stages, "recall_at_10": recall}
    files.append_line(spark, folder, json.dumps(row))
    return row


def run_grid(engine: Engine, queries: list[dict], combos: list[dict], folder: str, truth: list[dict] | None = None, k: int = 10) -> list[dict]:
    """Latency, predictions and a ledger row for each setting. ``folder`` must not exist: nothing is overwritten."""
    spark = engine.store.sparkSession
    if files.exists(spark, folder):
        raise ValueError(f"{folder} exists")
    files.write_text(spark, f"{folder}/grid.json", json.dumps({"combos": combos, "k": k, "n_queries": len(queries)}))
    rows = []
    for c in combos:
        slug = f"np{c['nprobe']}_tc{c['top_coarse']}_pt{c['max_pair_tokens']}_b{c['batch_size']}"
        tuned = Engine(engine.index, engine.store, engine.embedder, lambda c=c: rerank.lexical(pair_tokens=c["max_pair_tokens"]), engine.point | c, engine.vocabulary)
        measured = run_latency(search_stages(tuned), queries, k)
        files.write_text(spark, f"{folder}/pred_{slug}.jsonl", "".join(json.dumps({"query_id": i, "top10": t}) + "\n" for i, t in enumerate(measured["top_ids"])))
        recall = recall_of(truth, measured["top_ids"])[0] if truth else None
        rows.append(append_ledger(spark, f"{folder}/ledger", c, measured, recall))
    return rows


def recall_of(truth: list[dict], top_ids: list[list[str]], k: int = 10) -> tuple[float | None, int]:
    """(recall, skipped) of small lists in the driver; predictions are in the order of query ids."""
    pred = dict(enumerate(top_ids))
    got = [len(set(t["top10"]) & set(pred[t["query_id"]])) / k for t in truth if t["query_id"] in pred]
    return (sum(got) / len(got) if got else None), len(truth) - len(got)


#: Baselines and how far below them a build may fall.
GATES = {"recall": (0.2885, 0.10), "target_recall": (0.740, 0.10)}


def gate(recall: float | None, target_recall: float | None, p50_ms: float | None, budget_ms: float = 100.0, precision: float | None = None) -> dict:
    """Hard gates on recall, coverage and latency; what was not measured is skipped, not failed. Precision is advice."""
    out: dict = {"skipped": []}
    for name, value in (("recall", recall), ("target_recall", target_recall)):
        base, drop = GATES[name]
        if value is None:
            out["skipped"].append(name)
            out[name] = {"value": None, "pass": None}
        else:
            out[name] = {"value": round(value, 4), "limit": base - drop, "pass": value >= base - drop}
    out["latency"] = {"p50_ms": p50_ms, "budget_ms": budget_ms, "pass": p50_ms is not None and p50_ms <= budget_ms}
    out["precision"] = {"value": precision, "advisory": True}
    out["pass"] = all(g["pass"] for g in (out["recall"], out["target_recall"], out["latency"]) if g["pass"] is not None)
    return out


def report(spans: DataFrame) -> str:
    """A text table of stage percentiles."""
    rows = evaluate.stage_percentiles(spans).orderBy("stage").collect()  # one row a stage
    return "\n".join([f"{'stage':<12}{'n':>8}{'p50':>12}{'p99':>12}", *(f"{r['stage']:<12}{r['n']:>8}{r['p50']:>12.3f}{r['p99']:>12.3f}" for r in rows)])
