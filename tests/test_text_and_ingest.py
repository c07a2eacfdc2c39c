"""Scalar functions, records and ingest on typed-in cases."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import facets, ingest
from lodestar.sources import files, records


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_titles(spark):
    urls = ["https://e.com/how-to-build-an-ann.html", "https://e.com/foo%2Fbar.html", "https://e.com/", "https://e.com/" + "x" * 61 + ".html", None, "https://e.com/a_b-c.d.html?q=1#f", "https://e.com/c++-tips.html", "https://e.com/50%-off.html", "no url at all", "https://e.com"]
    assert one(spark, X.title_from_url, *urls) == ["How To Build An Ann", "Foo Bar", "", "", "", "A B C.d", "C++ Tips", "50% Off", "No Url At All", ""]


def test_domains_months_and_shards(spark):
    assert one(spark, X.domain_of, "HTTP://User:p@WWW.Example.COM:80/a", "https://[::1]:8/x", "mailto:x", None, "https://my_host.com/a b", "https://www.www.a.com") == ["example.com", "::1", "", "", "my_host.com", "www.a.com"]
    assert {X.normalize_domain(d) for d in ("example.com", "EXAMPLE.COM", "www.example.com", " WWW.Example.COM ")} == {"example.com"}
    assert one(spark, X.month_key, "2026-01-15", "2026-13-01", "x2026-01", None, "2026-12") == ["2026-01", "", "", "", "2026-12"]
    assert all(0 <= s < 64 for s in one(spark, X.shard_of, "a", "b", ""))


def test_white_space_and_controls(spark):
    assert one(spark, X.strip, "  \x1f a b  \n", "", None) == ["a b", "", None]
    assert one(spark, X.collapse, "  a \t\n b c ") == ["a b c"]
    assert one(spark, lambda c: X.first_tokens(c, 2), "a  b c", "", "a") == ["a b", "", "a"]
    assert one(spark, X.sanitize, "a\x00b‎\tc\n\x7f", None) == ["ab\tc\n", ""]
    assert one(spark, X.ascii_ratio, "aé", "", None, "ab") == [0.5, 0.0, 0.0, 1.0]
    assert one(spark, X.terms, "Alpha alpha be, BETA-9x0") == [["alpha", "beta", "9x0"]]


def test_paths_and_ratios(spark):
    assert one(spark, X.archive_to_text_path, "a/warc/b/warc/c") == ["a/wet/b/warc/c"]
    with pytest.raises(Exception, match="no /warc/"):
        one(spark, X.archive_to_text_path, "a/b")
    row = spark.range(1).select(X.ratio(F.lit(1), F.lit(0)), X.ratio(F.lit(1), F.lit(4)), X.hit_at(F.lit(10)), X.hit_at(F.lit(0)), X.reciprocal_at(F.lit(4)), X.reciprocal_at(F.lit(11)), X.knob_slug(("np", F.lit(8)), ("tc", F.lit(50)))).first()
    assert tuple(row) == (0.0, 0.25, 1, 0, 0.25, 0.0, "np8_tc50")
    values = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "s double").orderBy(X.best_first("s")).collect()
    assert [r.s for r in values[:2]] == [3.0, 1.0]


RAW = "pos long, url string, payload binary"


def raw(spark, *payloads):
    return spark.createDataFrame([(i, f"https://e.com/{i}", bytearray(p) if p is not None else None) for i, p in enumerate(payloads)], RAW)


def reasons(df):
    return {r.reason: r.n for r in df.collect()}


def test_reasons_come_in_order(spark):
    long = b"x" * 60
    got = ingest.decoded(raw(spark, long, b"\xff\xfe\x00" + bytes([0x80]), b"  ", b"short", b"short", long, b" " + long))
    assert reasons(ingest.reason_counts(got)) == {"kept": 2, "undecodable": 1, "empty": 1, "too_short": 1, "duplicate": 2}
    assert [r.pos for r in ingest.kept_documents(got).orderBy("pos").collect()] == [0, 6]
    row = ingest.stats(ingest.reason_counts(got)).first()
    assert (row.kept, row.skipped, row.reasons) == (2, 5, {"undecodable": 1, "empty": 1, "too_short": 1, "duplicate": 2})
    assert got.filter("pos = 0").first().id.startswith("sha1:") and got.filter("pos = 1").first().id == ""


def test_urls_after_digests(spark):
    docs = spark.createDataFrame([(0, "https://e.com/a", "mentions robotstxt"), (1, "https://e.com/RobotsTxt-policy", "t"), (2, "https://e.com/crawldiagnostics/42", "t"), (3, "https://e.com/a", "t"), (4, None, "t"), (5, "", "t")], "pos long, url string, text string")
    kept, counts = ingest.url_dedup(docs)
    assert sorted(r.pos for r in kept.collect()) == [0, 4]
    assert counts.first().asDict() == {"excluded": 2, "duplicate_urls": 2, "kept": 2}


def test_an_empty_input(spark):
    docs, reason, counts = ingest.ingest(raw(spark))
    assert docs.count() == 0 and reason.count() == 0
    assert counts.first().asDict() == {"excluded": 0, "duplicate_urls": 0, "kept": 0}
    assert ingest.stats(reason).first().asDict() == {"kept": 0, "skipped": 0, "reasons": {}}


def test_archives(spark, tmp_path):
    a, b = str(tmp_path / "a.wet.gz"), str(tmp_path / "b.wet.gz")
    records.write_archive(a, [("https://e.com/one-page.html", b"first text " * 10), ("https://e.com/bad", b"\xff\xfe")])
    records.write_archive(b, [("https://e.com/two", b"second text " * 10)])
    with open(b, "ab") as f:
        f.write(gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"))
    found = [p.removeprefix("file:") for p in records.archive_files(spark, str(tmp_path))]
    assert found == [a, b]
    got = records.read_archives(spark, found).orderBy("pos").collect()
    assert [(r.url, r.rec_type) for r in got] == [("https://e.com/one-page.html", "conversion"), ("https://e.com/bad", "conversion"), ("https://e.com/two", "conversion")]
    assert bytes(got[2].payload) == b"second text " * 10
    assert records.read_archives(spark, found, "").count() == 4 and records.read_archives(spark, []).count() == 0
    anywhere = records.read_archives_anywhere(spark, found).orderBy("pos").collect()
    assert [(r.url, bytes(r.payload)) for r in anywhere] == [(r.url, bytes(r.payload)) for r in got]
    docs, why, _ = ingest.ingest(records.read_archives(spark, found))
    assert [r.title for r in docs.orderBy("pos").collect()] == ["One Page", "Two"]
    assert reasons(why) == {"kept": 2, "undecodable": 1}
    broken, void = str(tmp_path / "c.gz"), str(tmp_path / "d.gz")
    open(broken, "wb").write(open(a, "rb").read()[:-9])
    open(void, "wb").write(gzip.compress(b""))
    told = {r.path.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in records.verify_gzip(spark, [a, broken, void]).collect()}
    assert told == {"a.wet.gz": "", "c.gz": "corrupt", "d.gz": "empty"}
    assert files.fingerprint(spark, [a, b]) == files.fingerprint(spark, [b, a]) != files.fingerprint(spark, [a])


def test_json_lines(spark, tmp_path):
    p = tmp_path / "docs.jsonl"
    p.write_text('{"id": "a", "text": "x"}\n\n  \n{"id": "b", "url": null}\n')
    got = records.read_jsonl(spark, str(p))
    assert records.row_count(got) == 2 and [r.id for r in got.orderBy("id").collect()] == ["a", "b"]
    p.write_text('{"id": "a"}\n{broken\n')
    with pytest.raises(Exception, match=r"(?i)malformed"):
        records.read_jsonl(spark, str(p)).collect()
    q = tmp_path / "q.jsonl"
    q.write_text('{"query": "one"}\n{"text": "two"}\n')
    assert [r.query for r in records.load_queries(spark, str(q)).orderBy("query_id").collect()] == ["one", "two"]
    q.write_text('{"query": " "}\n')
    with pytest.raises(Exception, match="blank query"):
        records.load_queries(spark, str(q)).collect()
    q.write_text("\n")
    with pytest.raises(ValueError, match="no queries"):
        records.load_queries(spark, str(q))
    out = str(tmp_path / "out")
    records.write_jsonl(spark.createDataFrame([("a", "u")], "id string, url string"), out)
    assert records.read_jsonl(spark, out).first().url == "u"
    with pytest.raises(Exception, match="(?i)exists"):
        records.write_jsonl(spark.range(1), out)


def test_parts(spark, tmp_path):
    assert records.strided(list("abcdefg"), 3) == ["a", "c", "e"] and records.strided(["a"], 5) == ["a"] and records.strided(["a", "b"], None) == ["a", "b"]
    listing = tmp_path / "paths.gz"
    listing.write_bytes(gzip.compress(b"x/subset=warc/a.parquet\nx/subset=robotstxt/b.parquet\nx/subset=warc/c.csv\n"))
    paths = records.part_paths(spark, str(listing))
    assert [r.path for r in paths.collect()] == ["x/subset=warc/a.parquet"]
    assert [r.url for r in records.part_urls(paths, "https://h/").collect()] == ["https://h/x/subset=warc/a.parquet"]
    root = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "subset string, n int").write.partitionBy("subset").parquet(root)
    got = records.read_parts(spark, [f"{root}/subset=a", f"{root}/subset=b"], root)
    assert {(r.subset, r.n) for r in got.collect()} == {("a", 1), ("b", 2)}
    assert records.expected_and_present(["a", "b"], ["b", "c"]) == (["a"], ["c"])
    assert records.load_corpus(spark, "synthetic", 3).count() == 3 and records.synthetic_vectors(spark, 2, 8).count() == 2
    with pytest.raises(ValueError, match="unknown corpus"):
        records.load_corpus(spark, "x", 1)


def test_replace_keeps_good_data(spark, tmp_path):
    p = str(tmp_path / "docs")
    assert files.replace_table(spark.range(3), p) == 3
    with pytest.raises(ValueError, match="no rows"):
        files.replace_table(spark.range(0), p)
    assert spark.read.parquet(p).count() == 3
    assert files.replace_table(spark.range(5), p) == 5 and spark.read.parquet(p).count() == 5
    files.append_line(spark, str(tmp_path / "l"), json.dumps({"a": 1}))
    files.append_line(spark, str(tmp_path / "l"), json.dumps({"a": 2}))
    assert [json.loads(files.read_text(spark, f))["a"] for f in files.listed(spark, str(tmp_path / "l"))] == [1, 2]


DOCS = [(0, "https://example.com/a", "2026-01-15", "alpha beta gamma of shared words here"), (1, "https://other.org/b", "2026-02-20", "alpha delta epsilon of shared words here"), (2, "https://example.com/c", "2026-01-25", "zeta eta theta of shared words here")]


@pytest.mark.parametrize(("asked", "rows"), [
    ({"domains": ["WWW.Example.COM"]}, [0, 2]), ({"domains": ["nope.example"]}, []), ({"date_range": ["2026-01-01", "2026-01-31"]}, [0, 2]), ({"month_range": ("2026-02", "2026-02")}, [1]),
    ({"month_range": ("2026-01", "2026-02")}, [0, 1, 2]), ({"keywords": ["ALPHA"]}, [0, 1]), ({"terms": ["alpha", "beta"]}, [0]), ({"domains": ["example.com"], "terms": ["alpha"]}, [0]),
    ({"allow": [1, 0, 1, 77], "domains": ["example.com"]}, [0]), ({"domains": []}, []), ({"terms": []}, []), ({"terms": ["of"]}, []), ({"month_range": ("2026-02", "2026-01")}, []), ({}, [0, 1, 2]),
])
def test_filters(spark, asked, rows):
    """By columns and by postings alike."""
    docs = facets.facet_columns(spark.createDataFrame(DOCS, "row_id long, url string, date string, text string"))
    f = facets.translate_filters(asked)
    c = f.column()
    assert sorted(r.row_id for r in (docs if c is None else docs.filter(c)).collect()) == rows
    found = facets.resolve(facets.postings(docs, facets.vocabulary(docs)), f)
    assert (found is None and f.is_empty()) or sorted(r.row_id for r in found.collect()) == rows


def test_vocabulary_is_capped(spark):
    docs = facets.facet_columns(spark.createDataFrame(DOCS, "row_id long, url string, date string, text string"))
    words = facets.vocabulary(docs, 3)
    assert [r.term for r in words.collect()] == ["here", "shared", "words"]
    posted = facets.postings(docs, words)
    assert facets.and_keys(posted, "terms", ["alpha"]).count() == 0 and facets.and_keys(posted, "terms", ["words", "here"]).count() == 3
    assert docs.filter(facets.Filter(terms=["alpha"]).column(vocabulary=["here", "shared", "words"])).count() == 0
    assert facets.facet_stats(posted, docs).first().asDict() == {"domains": 2, "dates": 2, "terms": 3, "n_docs": 3}
    assert facets.row_space_violations(posted, 3).count() == 0 and {r.key for r in facets.row_space_violations(posted, 2).collect()} == {"example.com", "2026-01", "here", "shared", "words"}


@pytest.mark.parametrize("bad", [{"date_range": ["2026-01-01"]}, {"date_range": ["2026-01", "2026-02", "2026-03"]}, {"date_range": "2026-01"}, {"date_range": ["not-a-month", "2026-01"]}, {"date_range": [None, "2026-01"]}, {"date_range": ["2026-13", "2026-14"]}, {"bogus": 1}, {"domains": "a"}, {"terms": [1]}, {"allow": ["a"]}, {"terms": ["a"] * 1001}])
def test_malformed_filters(bad):
    with pytest.raises(ValueError, match="filter|range|month"):
        facets.translate_filters(bad)


def test_filters_are_renamed():
    assert facets.translate_filters({"date_range": ["2026-01-15", "2026-08-20"], "keywords": ["a"]}) == facets.Filter(month_range=("2026-01", "2026-08"), terms=["a"])
