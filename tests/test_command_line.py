"""The command line from archives to results."""

import json

import pytest

from lodestar.__main__ import main
from lodestar.sources import records


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().split("\n")[-1])


def test_from_archives_to_results(spark, tmp_path, capsys):
    text = "a passage about neural search and number {} " * 3
    records.write_archive(str(tmp_path / "a.wet.gz"), [(f"https://e.com/page-{i}.html", text.format(i, i, i).encode()) for i in range(12)])
    docs, index = str(tmp_path / "docs"), str(tmp_path / "index")
    assert main(["ingest", str(tmp_path), docs], spark) == 0 and said(capsys)["kept"] == 12
    assert main(["build", docs, index, "--clusters", "2", "--dim", "16"], spark) == 0 and said(capsys) == {"n_docs": 12, "n_centroids": 2}
    assert main(["search", index, "neural search", "--top-k", "3", "--dim", "16", "--filters", '{"domains": ["e.com"]}'], spark) == 0
    out = said(capsys)
    assert len(out["results"]) == 3 and not out["degraded"]
    assert main(["ingest", str(tmp_path / "nothing"), docs], spark) == 2


def test_recall_and_gates(spark, tmp_path, capsys):
    (tmp_path / "t").write_text('{"query_id": 0, "top10": ["a", "b"]}\n{"query_id": 1, "top10": ["a"]}\n')
    (tmp_path / "p").write_text('{"query_id": 0, "top10": ["b", "a"]}\n')
    assert main(["recall", str(tmp_path / "t"), str(tmp_path / "p")], spark) == 0
    assert said(capsys) == {"recall": 0.2, "least": 0.2, "compared": 1, "skipped": 1}
    assert main(["gate", "--recall", "0.3", "--p50-ms", "50"]) == 0 and main(["gate", "--recall", "0.1", "--p50-ms", "50"]) == 1
    with pytest.raises(SystemExit) as e:
        main(["bogus"])
    assert e.value.code == 2
