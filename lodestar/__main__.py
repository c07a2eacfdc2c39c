"""Command line: ingest, build, search, recall and gate. Exit codes: 0 done or passed, 1 a gate failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions.embed import HashEmbedder
from .operators import evaluate, ingest
from .plans import config, retrieval
from .session import SETTINGS
from .sources import files, records


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("lodestar")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="archives to documents")
    a.add_argument("archives")
    a.add_argument("target")
    a = sub.add_parser("build", help="documents to an index")
    a.add_argument("documents")
    a.add_argument("index")
    a.add_argument("--clusters", type=int, default=config.CLUSTERS["small"])
    a.add_argument("--dim", type=int, default=config.DIM)
    a = sub.add_parser("search", help="one query")
    a.add_argument("index")
    a.add_argument("query")
    a.add_argument("--top-k", type=int, default=config.POINT["k"])
    a.add_argument("--filters", type=json.loads, default=None)
    a.add_argument("--dim", type=int, default=config.DIM)
    a = sub.add_parser("recall", help="recall of predictions, both as JSON lines of query_id and top10")
    a.add_argument("truth")
    a.add_argument("predictions")
    a = sub.add_parser("gate", help="whether a build may be served")
    a.add_argument("--recall", type=float)
    a.add_argument("--target-recall", type=float)
    a.add_argument("--p50-ms", type=float)
    a.add_argument("--budget-ms", type=float, default=config.POINT["budget_ms"])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "gate":
        out = retrieval.gate(a.recall, a.target_recall, a.p50_ms, a.budget_ms)
        print(json.dumps(out))
        return 0 if out["pass"] else 1
    spark = spark or _session()
    try:
        if a.command == "ingest":
            raw = records.read_archives(spark, records.archive_files(spark, a.archives))
            docs, reasons, urls = ingest.ingest(raw)
            kept = files.replace_table(docs, a.target)
            print(json.dumps({"kept": kept, "reasons": {r["reason"]: r["n"] for r in reasons.collect()}, "urls": urls.first().asDict()}))
        elif a.command == "build":
            docs = retrieval.numbered(spark.read.parquet(a.documents))
            print(json.dumps({k: v for k, v in retrieval.build(docs, a.index, a.clusters, lambda: HashEmbedder(a.dim), a.dim).items() if k.startswith("n_")}))
        elif a.command == "search":
            engine = retrieval.load(spark, a.index, embedder=lambda: HashEmbedder(a.dim))
            print(json.dumps(retrieval.run_search(retrieval.search_stages(engine), a.query, a.filters, a.top_k, True), default=str))
        else:
            rows = [records.read_jsonl(spark, p, "query_id long, top10 array<string>").withColumnRenamed("top10", "top") for p in (a.truth, a.predictions)]
            print(json.dumps(evaluate.recall_summary(evaluate.compared(*rows)).first().asDict()))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
