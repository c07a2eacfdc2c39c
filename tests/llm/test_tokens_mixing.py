"""Token counts against the library, mixing against its own quotas and brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing, token_counts
from lodestar.llm.queries import vocabulary

from .tables import SCHEMA, empty, rows, ugly

PATH = vocabulary("byte_bpe_50k.json")
BITS = ["a", "b", " ", " ", "\n", "\t", "'s", "don't", "é", " ", " ", "12", ".", "!?", "<|endoftext|>", "\x1c", "Hello", "  ", "\r", "\U0001f600", "x" * 70, "\x85"]


@pytest.mark.parametrize("hot", [1 << 18, 1024])
def test_token_counts(spark, hot):
    from tokenizers import Tokenizer

    r = random.Random(1)
    texts = [t for _, t in rows()] + ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, *["x"] * 14) for i, t in enumerate(texts)], SCHEMA)
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in token_counts.token_counts(df, PATH, hot=hot).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 512) for i, t in enumerate(texts))


@pytest.mark.parametrize("hot", [1 << 18, 1024])
def test_first_and_inner_pre_tokens(spark, hot):
    """An inner pre-token that begins with the mark of first ones is not taken for one of these."""
    texts = ["The end", "2 of them", "see ^The mark", "x ^2 y ^2", "^The ^^The ^", "^2", "^"]
    df = spark.createDataFrame([(i, t, *["x"] * 14) for i, t in enumerate(texts)], SCHEMA)
    want = [n for t in texts for n in token_counts.piece_counts(PATH, [t])]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, PATH, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("hot", [1 << 18, 1])
def test_runs_and_special_strings(spark, hot):
    """Indented code, white space of all kinds, special strings and long runs: as the library counts whole texts."""
    import random

    r = random.Random(4)
    bits = ["def f(x):", "\n  ", "\n    return x", " \n ", "\t\t", " \t ", "  ", "\u00a0 ", " \u00a0", "\r\n", "<|endoftext|>", " <|endoftext|> ", "don't", "é", "12345", "###", " ", "\n", "\u3000", "x" * 3000, "日本語", "\x1c", " \x85 "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(300)] + ["  ", " \n ", "\n  x", "a  ", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [n for t in texts for n in token_counts.piece_counts(PATH, [t])]
    got = {x.doc_id: x.n_tokens for x in token_counts.token_counts(df, PATH, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(token_counts.split(PATH, t) is None for t in texts) == 0


def test_token_counts_repeats_and_empty(spark):
    got = token_counts.token_counts(ugly(spark), PATH).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows())
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 166.66666666666666, 83.33333333333333]
    assert sum(mixing.targets([7, 1, 900, 3, 0])) == pytest.approx(1.5 * 911)
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_flow_against_search():
    """On small graphs no whole-number flow serves more words, or as many at less cost."""
    r = random.Random(3)
    for _ in range(30):
        n_s, n_p = 2, 3
        members = [tuple(sorted(r.sample(range(n_s), r.randint(1, n_s)))) for _ in range(n_p)]
        capacity = [r.randint(1, 3) for _ in range(n_p)]
        quotas = [float(r.randint(0, 6)) for _ in range(n_s)]
        flow = mixing.min_cost_flow(capacity, members, quotas)
        edges = [(p, s) for p in range(n_p) for s in members[p]]

        def cost(out):
            return sum(min(o, c) + 4 * max(0, o - c) for o, c in zip(out, capacity, strict=True))

        best = (0, 0)
        for amounts in itertools.product(*(range(int(min(2 * capacity[p], quotas[s])) + 1) for p, s in edges)):
            out, into = [0] * n_p, [0] * n_s
            for (p, s), v in zip(edges, amounts, strict=True):
                out[p] += v
                into[s] += v
            if all(o <= 2 * c for o, c in zip(out, capacity, strict=True)) and all(i <= q for i, q in zip(into, quotas, strict=True)):
                best = min(best, (-sum(amounts), cost(out)))
        out = [sum(v for (p, _), v in flow.items() if p == i) for i in range(n_p)]
        assert (-sum(out), cost(out)) == pytest.approx(best)


def test_mix_laws(spark):
    df = ugly(spark)
    got = mixing.mix(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows())
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    names = sorted(size, key=lambda x: (x is None, x or ""))
    assert [target[s] for s in names] == pytest.approx(mixing.targets([size[s] for s in names]))
    assert all(r.source_size == size[r.source] for r in got)
    assert sum(size.values()) == sum(words(t) for _, t in rows())
    for s in names:
        # Off by no more than half the document at the cut.
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in got if r.source == s) / 2 + 1
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixing.mix(df.repartition(5)).collect())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixture(empty(spark)).count() == 0


def test_mixture_repeats_rows(spark):
    df = ugly(spark)
    plan = Counter()
    for r in mixing.mix(df).collect():
        plan[r.doc_id] += r.copies
    out = mixing.mixture(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +plan


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"] if i % 4 else None) for i in range(200)], "doc_id long, text string, source array<string>")
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("s")).collect()
    assert {r.source: r.s for r in got} == {"a": 1500, None: 500}
