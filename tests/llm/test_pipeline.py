"""Each stage of the pipeline against brute force on what it read."""

from collections import Counter, defaultdict

import corpus_pipeline
from lodestar.llm import mixing, quality_crf, queries

from .test_near_and_repeats import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, read = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        read.append((name, docs.collect()))
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
    read.append(("end", docs.collect()))
    rows = dict(read)
    kept = {r.doc_id for r in quality_crf.score(spark.createDataFrame(rows["quality"]), queries.quality_model(spark, SF)).collect() if r.predicted}
    assert {r.doc_id for r in rows["exact"]} == kept
    best = {}
    for r in rows["exact"]:
        best[r.text] = max(r.doc_id, best.get(r.text, -1))
    assert sorted(best.values()) == sorted(r.doc_id for r in rows["near"])
    assert {c for _, c, _ in brute_classes([(r.doc_id, r.text) for r in rows["near"]])} == {r.doc_id for r in rows["mix"]}
    plan = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows["mix"])).collect()}
    assert Counter(r.doc_id for r in rows["pack"]) == +Counter(plan)
    pieces = defaultdict(int)
    for r in rows["end"]:
        pieces[r.doc_id] += r.piece == 0
    assert pieces == Counter(r.doc_id for r in rows["pack"])
