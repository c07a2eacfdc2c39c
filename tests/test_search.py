"""Vectors, codes, clusters and search: against numpy, and by laws."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators import evaluate, facets, search
from lodestar.plans import retrieval

DIM = 16


def made(n, k=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(k, DIM))
    x = centres[r.integers(0, k, n)] + 0.6 * r.normal(size=(n, DIM))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, name="row_id", col="v"):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"{name} long, {col} array<float>")


def brute(x, q, k, sign=False):
    s = np.round(q.astype(float) @ (np.where(x > 0, 1.0, -1.0) if sign else x.astype(float)).T, 6)
    return {(i, int(j), r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:k])}


def rows(df):
    return {(r.query_id, r.row_id, r.rank) for r in df.collect()}


@pytest.mark.parametrize("limit", [1 << 20, 1000])
def test_brute_force(spark, limit):
    """In one block of queries and in many."""
    x, q = made(300), made(9, seed=1)
    v, a = frame(spark, x), frame(spark, q, "query_id", "q")
    assert rows(search.exact_topk(v, a, 7, limit=limit)) == brute(x, q, 7)
    assert rows(search.sign_topk(v, a, 7, limit=limit)) == brute(x, q, 7, True)
    assert search.exact_topk(v, a.limit(0), 7).count() == 0 and search.exact_topk(v.limit(0), a, 7).count() == 0


def test_ties_and_nan(spark):
    x = np.zeros((50, 2), np.float32)
    x[7:, 0] = 1
    x[3] = [np.nan, 0]
    v, a = frame(spark, x).repartition(5), frame(spark, np.asarray([[1.0, 0.0]], np.float32), "query_id", "q")
    assert [r.row_id for r in search.exact_topk(v, a, 5).orderBy("rank").collect()] == [7, 8, 9, 10, 11]
    assert [r.row_id for r in search.exact_topk(v, a, 50).orderBy("rank").collect()] == [*range(7, 50), 0, 1, 2, 4, 5, 6, 3]
    got = spark.createDataFrame([(0, 1, float("nan")), (0, 2, 1.0), (0, 3, 1.0)], "query_id long, row_id long, score double")
    assert [r.row_id for r in search.ranked(got, 3).orderBy("rank").collect()] == [2, 3, 1]


def test_every_cluster_is_the_brute_force(spark):
    x, q = made(400), made(12, seed=2)
    v, a = frame(spark, x), frame(spark, q, "query_id", "q")
    centroids = spark.createDataFrame([(i, [float(y) for y in x[i * 50]]) for i in range(8)], "cluster_id int, c array<double>")
    index = search.build(v, centroids)
    want = np.round(x.astype(float) @ x[::50].astype(float).T, 6).argmax(1)
    assert [r.cluster_id for r in index.vectors.orderBy("row_id").collect()] == want.tolist()
    assert rows(search.search(index, a, 8, 10)) == rows(search.search(index, a, 99, 10)) == brute(x, q, 10, True)
    swept = retrieval.sweep(index, a, evaluate.nested(search.sign_topk(v, a)), [1, 2, 4, 8]).orderBy("nprobe").collect()
    got = [r.recall for r in swept]
    assert got == sorted(got) and got[-1] == 1.0 and got[0] < 1 and swept[0].skipped == 0
    with pytest.raises(ValueError, match="nprobe"):
        search.search(index, a, 0, 10)
    kept = search.search(index, a, 8, 10, F.col("row_id") % 3 == 0, spark.createDataFrame([(9,), (3,), (3,), (4,), (9999,)], "row_id long"))
    assert {r.row_id for r in kept.collect()} == {3, 9}
    assert list(search.lists(index).groupBy("cluster_id").count().select(F.sum("count")).first()) == [400]
    assert tuple(search.partition_violations(index, 400).first()) == (0, 0, 0, 0)
    broken = search.ClusterIndex(index.vectors.union(index.vectors.limit(1)), centroids.limit(7))
    bad = search.partition_violations(broken, 401).first()
    assert bad.repeated == 1 and bad.missing == 1 and bad.unknown_clusters == 1


def test_routes(spark):
    c = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])], "cluster_id int, c array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<float>")
    assert [r.cluster_id for r in search.route(q, c, 2).orderBy("rank").collect()] == [1, 0]
    assert [r.cluster_id for r in search.route(q, c, 99).orderBy("rank").collect()] == [1, 0, 2]
    with pytest.raises(ValueError, match="no centroids"):
        search.route(q, c.limit(0), 1)


def test_codes(spark):
    x = np.zeros(256, np.float32)
    x[[0, 7, 8]], x[255] = 1, -1
    words = frame(spark, [x]).select(V.sign_code("v")).first()[0]
    assert np.asarray(words, np.int64).tobytes() == np.packbits(x > 0, bitorder="little").tobytes()
    y = made(20)
    df = frame(spark, y).select("v", V.sign_code("v").alias("code"), F.reverse("v").alias("q"))
    got = df.select("q", "v", V.code_dot("code", "q").alias("a"), V.lookup_score(V.nibbles("code", DIM), V.lookup_table("q")).alias("b"), V.dot("v", "q").alias("d")).collect()
    for r in got:
        want = sum(a if b > 0 else -a for a, b in zip(r.q, r.v, strict=True))
        assert r.a == pytest.approx(want, abs=1e-6) and r.b == pytest.approx(want, abs=1e-6) and r.d == pytest.approx(float(np.dot(r.q, r.v)), abs=1e-6)


def test_lengths_and_checks(spark):
    df = frame(spark, [[3.0, 4.0], [0.0, 0.0], [float("inf"), 0.0]])
    got = [r[0] for r in df.orderBy("row_id").select(V.normalize("v")).collect()]
    assert np.allclose(got[:2], [[0.6, 0.8], [0, 0]])
    assert np.allclose(frame(spark, [[3.0, 4.0, 12.0]]).select(V.shorten("v", 2)).first()[0], [0.6, 0.8])
    assert search.check_vectors(df.union(df.limit(1)), 2).first().asDict() == {"rows": 4, "wrong_dim": 0, "not_finite": 1, "repeated_ids": 1}
    q = df.withColumnsRenamed({"row_id": "query_id", "v": "q"})
    assert search.check_queries(q.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="not finite"):
        search.check_queries(q, 2).collect()
    with pytest.raises(Exception, match="wrong dimension"):
        search.check_queries(q.limit(1), 3).collect()


def test_training(spark):
    v = frame(spark, made(200))
    c = search.train_centroids(v, 4, sample=150).collect()
    assert [r.cluster_id for r in c] == [0, 1, 2, 3] and len(c[0].c) == DIM
    assert search.train_centroids(v.limit(3), 10).count() == 3


def test_filters_act_before_ranking(spark):
    """A filtered search finds the best of what passes, not what passes of the best."""
    x, q = made(300), made(4, seed=5)
    v = frame(spark, x).withColumns({"domain": F.when(F.col("row_id") % 10 == 0, "a.com"), "month": F.lit("2024-01"), "terms": F.array(F.lit("t"))})
    index = search.build(v, spark.createDataFrame([(0, [1.0] * DIM)], "cluster_id int, c array<double>"))
    got = search.search(index, frame(spark, q, "query_id", "q"), 1, 5, facets.Filter(domains=["A.com"]).column())
    assert {(a, b * 10, c) for a, b, c in brute(x[::10], q, 5, True)} == rows(got)


def scanned(monkeypatch, v, a, k, batches, **options):
    """What one task makes of batches (row_id, v), in this process, and the most bytes it held."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(type(v), "mapInArrow", lambda self, f, schema: found.append(f) or self)
        search._scan(v, a, k, "dot", False, **options)
    tracemalloc.start()
    try:
        out = [b for f in found for b in f(iter(batches))]
        return pa.Table.from_batches(out).to_pylist(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def batches_of(x, ids, step):
    made = pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    return [pa.RecordBatch.from_arrays([pa.array(ids[a : a + step]), made[a : a + step]], names=["row_id", "v"]) for a in range(0, len(x), step)]


def test_a_task_holds_slices_and_sends_k_rows(spark, monkeypatch):
    """Neither the scores held at once nor the rows sent grow with batches times queries."""
    x, q = made(10_000)[:, :4], made(3000, seed=1)[:, :4]
    v, a = frame(spark, x[:1]), frame(spark, q, "query_id", "q")
    got, held = scanned(monkeypatch, v, a, 3, batches_of(x, np.arange(len(x)), 5000))
    assert held < 150e6 < 8 * 5000 * len(q) * 1.5  # before, all scores of a batch, several times
    assert len(got) == 3 * len(q)
    assert sorted((r["query_id"], r["row_id"]) for r in got) == sorted((i, j) for i, j, _ in brute(x, q, 3))


@pytest.mark.parametrize("string", [False, True])
def test_a_task_drops_rows_as_the_ranking_does(spark, monkeypatch, string):
    """In the smallest slices and with rows dropped all the time: ties across batches, NaN, infinite values, few rows."""
    monkeypatch.setattr(search, "TILE_BYTES", 200, raising=False)
    monkeypatch.setattr(search, "KEPT_ROWS", 1, raising=False)
    r = np.random.default_rng(3)
    x = r.integers(-1, 2, (90, 2)).astype(float)
    x[5], x[6], x[70] = [np.nan, 0], [-np.inf, 1], [np.inf, 1]
    q = np.asarray([[1.0, 0.5], [0.5, -1.0], [-1.0, -0.5], [1.0, 1.0]])
    ids = r.permutation(90)
    names = [f"{i:03}" for i in ids] if string else ids
    v = frame(spark, x[:1]).withColumn("row_id", F.col("row_id").cast("string" if string else "long"))
    with np.errstate(invalid="ignore"):
        s = np.round(q @ x.T, 6)
    for k in (1, 4, 88, 89, 200):
        got, _ = scanned(monkeypatch, v, frame(spark, q, "query_id", "q"), k, batches_of(x, names, 13))
        want = [(i, names[j]) for i in range(len(q)) for j in np.lexsort((ids, -s[i]))[:k]]
        assert [(g["query_id"], g["row_id"]) for g in got] == want


def test_many_batches_and_tasks(spark):
    """Searches of small batches in several tasks, routed or not, are the brute force; a query's ids may be strings."""
    x, q = made(300), made(9, seed=1)
    x[150:] = x[:150]
    v, a = frame(spark, x).repartition(3, "row_id"), frame(spark, q, "query_id", "q")
    index = search.build(v, spark.createDataFrame([(i, [float(y) for y in x[i * 20]]) for i in range(5)], "cluster_id int, c array<double>"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert search._scan(v.coalesce(1), a, 4, "dot", False).count() == 4 * len(q)
        assert rows(search.exact_topk(v, a, 7)) == brute(x, q, 7)
        assert rows(search.sign_topk(v, a, 7)) == rows(search.search(index, a, 5, 7)) == brute(x, q, 7, True)
        named = search.exact_topk(v, a.withColumn("query_id", F.concat(F.lit("q"), "query_id")), 7)
        assert {(int(i[1:]), j, k) for i, j, k in rows(named)} == brute(x, q, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
