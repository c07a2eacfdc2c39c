"""Reranking, content, evaluation, integrity, configuration, stages, tools, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.embed import HashEmbedder, ModelEmbedder, embed, lexical_score, model_score
from lodestar.operators import evaluate, manifest, rerank, store
from lodestar.plans import config, retrieval
from lodestar.plans.stages import Stage, Stages
from lodestar.plans.tools import Tools
from lodestar.sources import files, records
from lodestar.streaming import incremental, limiter

CAND = "query_id long, id string, coarse_rank long, coarse_score double, text string, url string, title string"


def test_rerank(spark):
    rows = [(0, "a", 1, 0.9, "bad words", "u", "t"), (0, "b", 2, 0.8, "good words", None, None), (0, "c", 3, 0.7, "good", "u", "t"), (1, "d", 1, 0.5, "x", "u", "t"), (1, "e", 2, 0.4, None, "u", "t")]
    df = spark.createDataFrame(rows, CAND)
    score = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col("text").contains("good").cast("double"))
    got = {(r.query_id, r.rank): (r.id, r.score, r.degraded) for r in rerank.rerank(df, score).collect()}
    # Equal scores keep the coarse order; one failed candidate degrades its query alone.
    assert got == {(0, 1): ("b", 1.0, False), (0, 2): ("c", 1.0, False), (0, 3): ("a", 0.0, False), (1, 1): ("d", 0.5, True), (1, 2): ("e", 0.4, True)}
    assert all(r.degraded for r in rerank.rerank(df, None).collect()) and rerank.rerank(df.limit(0), score).count() == 0
    assert [r.id for r in rerank.reversed_order(df.filter("query_id = 0")).orderBy("rank").collect()] == ["c", "b", "a"]
    shown = rerank.results(rerank.rerank(df, score), 1, chars=4).orderBy("query_id").collect()
    assert [(r.id, r.snippet, r.url, r.provenance, r.untrusted) for r in shown] == [("b", "good", "", "corpus", True), ("d", "x", "u", "corpus", True)]
    assert rerank.effective_coarse(50, 80) == 80


def test_misses_are_counted(spark):
    found = spark.createDataFrame([(0, "a", 1, 0.9), (0, "ghost", 2, 0.8)], "query_id long, id string, coarse_rank long, coarse_score double")
    held = spark.createDataFrame([("a", "u", "t", None)], "id string, url string, title string, text string")
    got = rerank.fetch(found, held)
    assert [r.id for r in got.rows.collect()] == ["a"] and got.misses.first().store_miss_drops == 1


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(f"d{i}", "u", f"T\x00{i}", f"text {i}\x00", None) for i in range(30)], "id string, url string, title string, text string, date string")
    store.write(docs, path)
    held = store.read(spark, path)
    got = store.contents(held, ["d3", "nowhere", "d1", "d3"], 6).collect()
    assert [(r.id, r.text, r.title, r.error) for r in got] == [("d3", "text 3", "T3", None), ("nowhere", None, None, "not_found"), ("d1", "text 1", "T1", None), ("d3", "text 3", "T3", None)]
    assert len(store.contents(held, [f"d{i}" for i in range(25)]).collect()) == 20 and store.paging(25) == {"next_offset": 20, "remaining": 5} and store.paging(20) == {}
    changed = held.withColumn("text", F.when(F.col("id") == "d3", F.lit("other")).otherwise(F.col("text")))
    assert store.get_many(changed, ["d3", "d4"]).count() == 1
    none = held.withColumn("sha256", F.lit(None).cast("string"))
    assert store.trusted(none).count() == 30 and store.trusted(held.limit(29).union(none.limit(1))).count() == 29
    files.write_text(spark, f"{path}/note.txt", "x")
    store.reset(spark, path)
    assert [p.rsplit("/", 1)[-1] for p in files.listed(spark, path) if not p.endswith("_SUCCESS")] == ["note.txt"]


def lists(spark, d):
    return spark.createDataFrame(list(d), "query_id long, top array<string>")


def test_recall(spark):
    ten = [str(i) for i in range(10)]
    one = lambda t, p: tuple(evaluate.recall_summary(evaluate.compared(lists(spark, t), lists(spark, p))).first())
    assert one([(0, ["a", "b"])], [(0, ["a", "b"])]) == (0.2, 0.2, 1, 0)
    assert one([(0, ["a"]), (1, ["b"])], [(0, ["a"])]) == (0.1, 0.1, 1, 1)
    assert one([(0, ten), (1, ten)], [(0, ten)]) == (1.0, 1.0, 1, 1)
    assert one([(0, ten)], [(5, ten)]) == (None, None, 0, 1)
    with pytest.raises(Exception, match="duplicate query_id"):
        one([(0, ["a"])], [(0, ["a"]), (0, ["b"])])
    assert retrieval.recall_of([{"query_id": 0, "top10": ["a"]}, {"query_id": 5, "top10": ["a"]}], [["a"]]) == (0.1, 1)


def test_targets_and_judgements(spark):
    rows = spark.createDataFrame([(1, 2), (0, 4), (3, 0), (11, 11)], "coarse_pos long, reranked_pos long")
    got = evaluate.target_metrics(rows).first().asDict()
    assert got == {"n": 4, "coarse_recall10": 0.5, "reranked_recall10": 0.5, "coarse_mrr10": round((1 + 1 / 3) / 4, 6), "reranked_mrr10": round(0.75 / 4, 6), "wins": 1, "losses": 1, "ties": 2}
    assert evaluate.target_metrics(rows.limit(0)).first().coarse_recall10 == 0.0
    review = spark.createDataFrame([(1, ["A", "B", "A"]), (2, ["A", "B", "B"])], "qid long, entries array<string>")
    bits = spark.createDataFrame([(1, "1 0 1"), (2, "011")], "qid long, bits string")
    per = evaluate.judged(review, bits)
    assert {(r.qid, r.system): r.precision for r in per.collect()} == {(1, "A"): 0.2, (1, "B"): 0.0, (2, "A"): 0.0, (2, "B"): 0.2}
    assert tuple(evaluate.precision_summary(per, "A", "B").first()) == (2, 0.1, 0.1, 0.0, 1, 1)
    with pytest.raises(Exception, match="labels do not match"):
        evaluate.judged(review, bits.filter("qid = 1")).collect()
    questions = spark.createDataFrame([(0, "q"), (7, "r")], "n long, question string")
    with pytest.raises(Exception, match="no target for question 7"):
        evaluate.joined_questions(questions, spark.createDataFrame([(0, "d")], "n long, id string")).collect()
    with pytest.raises(ValueError, match="not in the corpus"):
        retrieval.anchored(spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("y",)], "id string"))


def test_percentiles_and_waterfalls(spark):
    spans = spark.range(1, 101).select(F.lit("s").alias("stage"), F.col("id").cast("double").alias("ms"))
    assert tuple(evaluate.stage_percentiles(spans).first()) == ("s", 100, 50.0, 99.0)
    assert retrieval.nearest_rank([3.0, 1.0, 2.0], 0) == 1.0 and retrieval.nearest_rank([1.0, 2.0, 3.0], 1) == 3.0 and retrieval.nearest_rank([], 0.5) is None
    assert retrieval.nearest_rank([float(i) for i in range(1, 101)], 0.99) == 99.0
    assert "s" in retrieval.report(spans)
    profiles = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 10.0), (1.0, 1.0, 1.0, 1.0, 100.0)], ", ".join(f"{c} double" for c in (*evaluate.STAGES, "total_ms")))
    assert evaluate.waterfall_violations(profiles).count() == 1


def test_gates():
    good = retrieval.gate(0.3, 0.7, 90.0)
    assert good["pass"] and good["skipped"] == []
    assert not retrieval.gate(0.1, 0.7, 90.0)["pass"] and not retrieval.gate(0.3, 0.7, 101.0)["pass"] and not retrieval.gate(0.3, 0.7, None)["pass"]
    skipped = retrieval.gate(None, None, 50.0)
    assert skipped["pass"] and skipped["skipped"] == ["recall", "target_recall"]
    assert len(retrieval.grid(a=[1, 2], b=[3])) == 2


def test_stages():
    seen = []
    s = Stages([Stage("c", lambda x: x["b"] + 1, ("b",)), Stage("a", lambda x: x["n"]), Stage("b", lambda x: seen.append(1) or x["a"] + 1, ("a",))])
    out = s.run({"n": 1})
    assert out.outputs == {"a": 1, "b": 2, "c": 3} and set(out.spans) == {"a", "b", "c"} and out.error is None

    def boom(x):
        raise KeyError("x")

    out = Stages([Stage("a", boom), Stage("b", lambda x: 1, ("a",)), Stage("c", lambda x: 2)]).run({})
    assert out.outputs == {"c": 2} and out.error["stage"] == "a" and "b" not in out.spans
    import time

    out = Stages([Stage("slow", lambda x: time.sleep(1), timeout_ms=20)]).run({})
    assert out.error["stage"] == "slow" and out.error["type"] == "TimeoutError"
    for bad in ([Stage("a", boom), Stage("a", boom)], [Stage("a", boom, ("z",))], [Stage("a", boom, ("a",))], [Stage("a", boom, ("b",)), Stage("b", boom, ("a",))]):
        with pytest.raises(ValueError):
            Stages(bad)


def test_config(spark, tmp_path):
    c = config.normalize({})
    assert c["serving"] == config.POINT and c["hardware_profile"] == "large"
    small = config.normalize({"hardware": {"usable_vram_gb": 12}, "operating_point": {"nprobe": 4}})
    assert small["serving"]["top_coarse"] == 25 and small["operating_point"]["nprobe"] == 4 and small["hardware_profile"] == "tiny"
    for bad in ({"x": 1}, {"serving": {"bogus": 1}}, {"serving": {"nprobe": "8"}}, {"serving": {"nprobe": True}}, {"serving": {"nprobe": 0}}, {"serving": 3}, {"resilience": {"resume": 1}}, {"serving": {"k": 5}, "operating_point": {"k": 6}}, [], {"hardware": {"n_cpu": 1.5}}):
        with pytest.raises(ValueError):
            config.normalize(bad)
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"serving": {"k": 7}}))
    assert config.load(spark, str(p))["operating_point"]["k"] == 7
    with pytest.raises(ValueError, match="no configuration"):
        config.load(spark, str(tmp_path / "none.json"))
    assert config.target_count(c) == 4 and config.target_count(c, 9) == 9


def test_models(spark):
    e = HashEmbedder(8)
    texts = ["a", "", "b"]
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(embed("text", lambda: HashEmbedder(8))).collect()]
    assert np.allclose(got, e.encode_docs(texts), atol=1e-6) and not np.allclose(e.encode_docs(["a"]), e.encode_queries(["a"]))

    class Model:
        def encode(self, texts):
            return [[len(t), 1.0, 5.0] for t in texts]

        def predict(self, pairs):
            if any(p == "fail" for _, p in pairs):
                raise RuntimeError
            return [len(p) for _, p in pairs]

    out = ModelEmbedder(Model(), 2, batch_size=2).encode_docs(["aaa", "", "a"])
    assert np.allclose(out, [[3 / 10**0.5, 1 / 10**0.5], [0, 1], [2**-0.5, 2**-0.5]])
    pairs = spark.createDataFrame([("alpha beta", "beta x", "alpha")], "q string, p string, r string")
    assert tuple(pairs.select(lexical_score("q", "p"), lexical_score("q", F.lit(None).cast("string")), lexical_score(F.lit(""), "p"), model_score("q", "p", Model), model_score("q", F.lit("fail"), Model)).first()) == (0.5, 0.0, 0.0, 6.0, None)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    docs = records.synthetic_docs(spark, 60).withColumn("text", F.concat("text", F.lit(" passage about neural search topic"), F.expr("repeat(' word', 10)")))
    docs = retrieval.numbered(docs)
    m = retrieval.build(docs, path, 4, lambda: HashEmbedder(32), 32, max_terms=50)
    assert m["n_docs"] == 60 and m["n_centroids"] == 4 and m["has_filter"]
    return retrieval.load(spark, path, embedder=lambda: HashEmbedder(32)), path


def test_search_by_stages_and_in_batch(spark, engine):
    e, _ = engine
    text = e.store.filter("id = 'doc-7'").first().text
    one = retrieval.run_search(retrieval.search_stages(e), text, {"domains": ["example.com"]}, 5, True)
    assert len(one["results"]) == 5 and not one["degraded"] and set(one["profile"]) >= {"embed_ms", "ann_ms", "rerank_ms", "snippet_ms", "total_ms", "store_miss_drops"}
    batch = retrieval.search_batch(e, spark.createDataFrame([(0, text), (1, "neural")], "query_id long, query string"), {"domains": ["example.com"]}, 5)
    assert [r.id for r in batch.filter("query_id = 0").orderBy("rank").collect()] == [r["id"] for r in one["results"]]
    assert retrieval.search_batch(e, spark.createDataFrame([(0, text)], "query_id long, query string"), {"keywords": ["absent"]}).count() == 0
    failed = retrieval.run_search(retrieval.search_stages(e), text, {"bogus": 1})
    assert failed["results"] == [] and failed["degraded"] and failed["error"]["stage"] == "retrieve"
    assert retrieval.prefix_queries(e.store.withColumn("row_id", F.lit(1)), 3, 7).first().query == "This is"
    grid = retrieval.run_grid(e, [{"query": text}], retrieval.grid(nprobe=[1], top_coarse=[5], max_pair_tokens=[64], batch_size=[32]), str(engine[1]) + "-grid", [{"query_id": 0, "top10": [r["id"] for r in one["results"]]}])
    assert grid[0]["n"] == 1 and grid[0]["recall_at_10"] is not None and grid[0]["stages"]["total_ms"]["p50"] > 0
    with pytest.raises(ValueError, match="exists"):
        retrieval.run_grid(e, [], [], str(engine[1]) + "-grid")


def test_tools(engine):
    t = Tools(engine[0])
    for args in ({"query": " "}, {"query": "x" * 4097}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": 101}, {"query": "x", "filters": {"bogus": 1}}):
        assert t.home_search(**args)["error"]["code"] == "invalid_request"
    for args in ({"ids": []}, {"ids": ["a"] * 101}, {"ids": ["a"], "max_chars_per_doc": 0}, {"ids": ["a"], "max_chars_per_doc": 20001}, {"ids": "a"}):
        assert t.home_contents(**args)["error"]["code"] == "invalid_request"
    got = t.home_contents([f"doc-{i}" for i in range(25)])
    assert len(got["items"]) == 20 and got["next_offset"] == 20 and got["remaining"] == 5 and got["items"][0]["untrusted"]
    assert t.home_contents(["nowhere"])["items"] == [{"id": "nowhere", "error": "not_found"}]
    assert t.home_health()["ok"] and t.home_health()["operating_point"]["nprobe"] == 8
    t.engine.store, kept = None, t.engine.store
    assert t.home_contents(["doc-1"]) == {"error": {"code": "internal", "message": "internal error"}} and not t.home_health()["ok"]
    t.engine.store = kept


def test_tampering_is_found(spark, engine, tmp_path):
    import shutil

    path = str(tmp_path / "copy")
    shutil.copytree(engine[1], path)
    m = manifest.verify(spark, path)
    manifest.check_counts(m, 60, 4)
    with pytest.raises(ValueError, match="n_docs"):
        manifest.check_counts(m, 61, 4)

    def refuse(m):
        raise ValueError("unsigned")

    with pytest.raises(ValueError, match="unsigned"):
        manifest.verify(spark, path, refuse)
    for change, said in (({"version": 9}, "version"), ({"files": None}, "no files"), ({"files": {}}, "no digest"), ({"schema": {}}, "layout"), ({"files": m["files"] | {"../x": "0"}}, "unsafe"), ({"files": m["files"] | {"vectors/none": "0"}}, "corrupt"), ({"has_filter": False}, "facets")):
        files.write_text(spark, f"{path}/{manifest.NAME}", json.dumps(m | change))
        with pytest.raises(ValueError, match=said):
            manifest.verify(spark, path)
    files.delete(spark, f"{path}/{manifest.NAME}")
    with pytest.raises(ValueError, match="no manifest"):
        manifest.verify(spark, path)
    a = {"docs_sha256": "x", "n_docs": 1, "path": "p"}
    assert manifest.same_source(a, a | {"path": "q"}) and not manifest.same_source(a, a | {"n_docs": 2}) and not manifest.same_source(None, a)
    assert manifest.reusable(spark, engine[1], {"n_docs": 60}) and not manifest.reusable(spark, engine[1], {"n_docs": 61}) and not manifest.reusable(spark, path, {})


CALLS = "client string, call_id long, at double"


def test_limiter(spark):
    got = limiter.limited(spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 61.0), ("b", 4, 2.0)], CALLS), 2)
    assert {r.call_id: r.allowed for r in got.collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}
    assert all(r.allowed for r in limiter.limited(spark.createDataFrame([("a", i, 0.0) for i in range(9)], CALLS), 0).collect())
    lim = limiter.Limiter(2)
    assert [lim.allow(t) for t in (0, 1, 2, 61)] == [True, True, False, True]


def test_a_stream_is_limited_like_a_table(spark, tmp_path):
    import random

    r = random.Random(3)
    calls = sorted((r.uniform(0, 300), c) for c in "aabbbc" * 20)
    rows = [(c, i, t) for i, (t, c) in enumerate(calls)]
    folder = str(tmp_path / "calls")
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], CALLS).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(folder)
    q = limiter.limited_stream(stream, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(x.call_id, x.allowed) for x in limiter.limited(spark.createDataFrame(rows, CALLS), 3).collect()}
    assert {(x.call_id, x.allowed) for x in spark.read.parquet(str(tmp_path / "o")).collect()} == want


def test_embedding_goes_on(spark, tmp_path):
    docs = records.synthetic_docs(spark, 20).withColumn("row_id", F.monotonically_increasing_id())
    target = str(tmp_path / "v")
    make = lambda: HashEmbedder(4)
    assert not incremental.embed_chunks(docs, target, 4, make, limit=2)
    first = json.loads(files.read_text(spark, f"{target}/state.json"))
    assert first["done"] == [0, 1] and incremental.embed_chunks(docs, target, 4, make)
    assert spark.read.parquet(*[f"{target}/chunk={i}" for i in range(4)]).count() == 20
    assert not incremental.embed_chunks(docs.limit(19), target, 4, make, limit=1)
    assert json.loads(files.read_text(spark, f"{target}/state.json"))["done"] == [0]
    files.write_text(spark, f"{target}/state.json", "{")
    with pytest.raises(ValueError, match="broken"):
        incremental.embed_chunks(docs, target, 4, make)
    assert incremental.embed_chunks(docs, target, 4, make, force=True)


def test_new_files_are_embedded_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    docs = records.synthetic_docs(spark, 10)
    for _ in range(2):
        docs.coalesce(1).write.mode("append").parquet(folder)
        incremental.embed_stream(incremental.new_documents(spark, folder), out, mark, lambda: HashEmbedder(4))
    assert spark.read.parquet(out).count() == 20
    seen = incremental.dedup_stream(spark.readStream.schema("id string, url string, title string, text string, date string").parquet(folder), "id")
    seen.writeStream.format("parquet").option("checkpointLocation", mark + "2").option("path", out + "2").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out + "2").count() == 10
