"""Sharding, exact dedup, chat formatting and quality rules against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat, exact_dedup, repetition, sharding

from .tables import empty, rows, ugly


def test_shards_law_and_whole(spark):
    df = ugly(spark)
    got = [(r.record.doc_id, r.record.text, r.shard, r.slot) for r in sharding.shards(df, 7, bucket_bytes=20_000, least_buckets=3).collect()]
    assert Counter((a, b) for a, b, _, _ in got) == Counter(rows())
    by = defaultdict(list)
    for _, _, shard, slot in got:
        by[shard].append(slot)
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    again = sorted(((r.record.doc_id or -1, r.shard, r.slot) for r in sharding.shards(df.repartition(3), 7, bucket_bytes=20_000, least_buckets=3).collect()))
    other = sorted(((r.record.doc_id or -1, r.shard, r.slot) for r in sharding.shards(df, 7, seed=5, bucket_bytes=20_000, least_buckets=3).collect()))
    assert again != other
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # the seed alone decides: not the partitions of the input, nor those of the session
        for partitions, adaptive in ((3, "true"), (13, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            assert again == sorted(((r.record.doc_id or -1, r.shard, r.slot) for r in sharding.shards(df, 7, bucket_bytes=20_000, least_buckets=3).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sharding.shards(empty(spark), 7).count() == 0


def test_many_equal_rows_scatter(spark):
    """Rows equal in all columns fill no bucket alone, and none is lost."""
    df = spark.range(6000).select(F.when(F.col("id") < 2000, F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, F.lit("t")).alias("text"))
    got = sharding.shuffled(df, bucket_bytes=2000, least_buckets=4).select("place", F.col("record.doc_id").alias("i")).collect()
    assert sorted(r.place for r in got) == list(range(6000)) and Counter(r.i for r in got) == Counter([*range(2000), *[None] * 4000])
    quarters = Counter(r.place // 1500 for r in got if r.i is None)
    assert all(850 < quarters[k] < 1150 for k in range(4))  # 1000 expected


def test_shuffle_is_uniform(spark):
    """Each of 400 rows lands in each quarter of the order about equally often over seeds."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    first = sum(r.place < 100 for s in range(6) for r in sharding.shuffled(df, seed=s * 10, bucket_bytes=500, least_buckets=4).filter("record.doc_id < 100").collect())
    assert 100 < first < 200  # 150 expected


def test_write_shards(spark, tmp_path):
    sharding.write_shards(ugly(spark), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows()) and back.select("shard").distinct().count() == 4


def brute_groups(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    return Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data)


@pytest.mark.parametrize(("chunk", "primes"), [(1 << 20, exact_dedup.PRIMES), (700, exact_dedup.PRIMES), (3000, (3,))])
def test_exact_groups(spark, chunk, primes):
    """Whole texts, many chunks, and a fingerprint so weak that unequal texts collide all the time."""
    got = exact_dedup.exact_groups(ugly(spark), chunk_bytes=chunk, primes=primes).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows())
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_groups_of_string_ids(spark):
    """A null id is no id of that name."""
    data = [(None, "a b"), ("null", "a b"), ("", "a b"), ("z", "q"), ("=", None)]
    df = spark.createDataFrame(data, "doc_id string, text string")
    got = exact_dedup.exact_groups(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter([(None, "null", 3), ("null", "null", 3), ("", "null", 3), ("z", "z", 1), ("=", "=", 1)])
    assert Counter(map(tuple, exact_dedup.exact_dedup(df).collect())) == Counter([("null", "a b"), ("z", "q"), ("=", None)])


def test_exact_groups_of_very_many(spark):
    """Groups and repeated rows so large that they are hot."""
    df = spark.range(4000).select((F.col("id") % 1500).alias("doc_id"), F.when(F.col("id") % 2 == 0, "even").when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise(F.lit("odd")).alias("text"))
    df = df.union(spark.range(2500).select(F.lit(7).cast("long"), F.lit("odd")))
    data = [(r.doc_id, r.text) for r in df.collect()]
    got = exact_dedup.exact_groups(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(data)
    assert Counter(r.text for r in exact_dedup.exact_dedup(df).collect()) == Counter({t for _, t in data})


def test_chunk_hashes_compose(spark):
    df = ugly(spark)
    whole = {(r.row): (r.h0, r.h1, r.h2, r.h3) for r in exact_dedup.fingerprints(df).collect()}
    parts = {(r.row): (r.h0, r.h1, r.h2, r.h3) for r in exact_dedup.fingerprints(df, chunk_bytes=64).collect()}
    assert whole == parts


def test_exact_dedup_keeps_columns(spark):
    df = ugly(spark)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    best = {}
    for i, t in rows():
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert Counter((t or "", -1 if i is None else i) for i, t in ((r.doc_id, r.text) for r in out.collect())) == Counter(best.items())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 and exact_dedup.exact_groups(empty(spark)).count() == 0


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi ###"), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (1, 3, "user", None), (1, 4, "assistant", "\\h \\\\e \\c ####### \n</turn>\n### User: x"),
    (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "tool: x ### \\", "t"), (3, 0, None, "t"), (3, 1, "?", ""), (3, 2, "=a", "</turn"), (3, 3, "User", "é\U0001f600"), (3, 4, "", ">"),
    (None, 0, "user", "q"), (None, 1, "assistant", "a\\"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "user", "q"), (5, 1, "assistant", ""),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*c, "x", 1) for c in CHATS], "conv_id long, turn long, role string, text string, segments string, state int")
    out = chat.format_chats(df)
    got = out.select("conv_id", "valid", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    for r in got:
        mine = sorted((c for c in CHATS if c[0] == r.conv_id), key=lambda c: (c[1], c[2] is not None, c[2] or "", c[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(c[2], c[3] or "") for c in mine]
        assert r.loss == "".join(c[3] or "" for c in mine if c[2] == "assistant")
        assert r.formatted.count(chat.TEMPLATE.closing) == len(mine)
    assert {r.conv_id: r.valid for r in got} == {1: True, 2: False, 3: False, None: True, 4: False, 5: True}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_another_template(spark):
    t = chat.Template(opening="<|start|>", closing="<|end|>", after_role="\n", headers=(("user", "user"), ("assistant", "bot")))
    said = ["<|end|> \\h <|start|>\n\\", "x" * 300_000, "", None]
    df = spark.createDataFrame([(0, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(said)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df, t).select("valid", chat.read_back(F.col("formatted"), t).alias("turns"), chat.loss_text(F.col("segments"), t).alias("loss")).first()
    assert r.valid and [x.text for x in r.turns] == [x or "" for x in said] and r.loss == "x" * 300_000
    for bad in ({"opening": " "}, {"closing": "a\\"}, {"opening": "##", "closing": "###"}, {"headers": (("user", "a: b"),)}, {"headers": (("user", "=u"),)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def brute_shares(text, limits):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = []
    for n in limits:
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                inside |= set(range(i, i + n))
            seen.add(g)
        out.append(sum(len(words[i]) for i in inside) / max(1, sum(map(len, words))))
    return max(out)


def test_repetition_rules(spark):
    got = repetition.repetition_rules(ugly(spark).coalesce(1)).collect()
    for (i, t), r in zip(rows(), got, strict=True):
        assert (i, *brute_rules(t)) == (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), i
        assert abs(r.gram_share - brute_shares(t, repetition.GRAM_LIMITS)) < 1e-9
        assert not (r.base_failed and r.kept)
    assert repetition.repetition_rules(empty(spark)).count() == 0


def test_op2_digest(spark):
    from lodestar.llm import queries

    got = {r.doc_id: r for r in queries.op2_sharding(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        b = (d.text or "").encode()
        assert (got[d.doc_id].size, got[d.doc_id].text_crc32) == (len(b) + 8, zlib.crc32(b))


def test_op5_oracle(spark):
    import duckdb

    from lodestar.llm import queries

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    rel = con.execute(queries.OP5_SQL)
    names = [c[0] for c in rel.description]
    assert Counter(map(tuple, queries.op5_chat_formatting(spark, "/root/testdata/sf0.001").select(*names).collect())) == Counter(rel.fetchall())


def test_op4_oracle(spark):
    import duckdb

    from lodestar.llm import queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = Counter(con.execute(queries.OP4_SQL).fetchall())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op4_exact_dedup(spark, "/root/testdata/sf0.001").collect()) == want
