"""Near-duplicates and repeated strings against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import simhash, suffix_dedup

from .tables import SCHEMA, empty, prose, rows, ugly


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_classes(data):
    """Class of each row: the smallest id of its connected group."""
    n, sets = len(data), [shingles(t) for _, t in data]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        both = len(sets[i] & sets[j])
        if (data[i][1] or "") == (data[j][1] or "") or (both and both >= 0.8 * (len(sets[i] | sets[j])) - 1e-9):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (d, _) in enumerate(data):
        ids[root(i)].append(d)
    return [(d, min((x for x in ids[root(i)] if x is not None), default=None), len(ids[root(i)])) for i, (d, _) in enumerate(data)]


def near_copies():
    r, out = random.Random(8), []
    for g in range(12):
        base = prose(g, 200).split(" ")
        for k in range(12):
            w = list(base)
            for _ in range(k):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            out.append((1000 + 100 * g + k, " ".join(w)))
    return out


@pytest.mark.parametrize("options", [{}, {"list_rows": 8}, {"verify_rows": 4}])
def test_near_classes(spark, options):
    """Whole; with lists so short that all recurse and divide; with components verified in parts."""
    data = rows() + near_copies()
    df = spark.createDataFrame([(i, t, *["x"] * 14) for i, t in data], SCHEMA)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in simhash.near_classes(df, **options).collect())
    want = Counter(brute_classes(data))
    assert sum((got & want).values()) >= (1.0 if not options else 0.9) * len(data)
    assert Counter(x[0] for x in got.elements()) == Counter(i for i, _ in data)


def star_copies(n):
    """Copies of an original, which is last in hash order, with four places changed: most pass 0.8 only against it."""
    r, base = random.Random(11), prose(500, 200).split(" ")
    base[0] = next(w for w in map(str, range(10**5)) if hashlib.md5(" ".join([w, *base[1:]]).encode()).hexdigest() > "ff")
    out = [(5000, " ".join(base))]
    for k in range(n):
        w = list(base)
        for at in r.sample(range(10, 190, 8), 4):
            w[at] = f"new{r.randrange(10**6)}"
        out.append((5001 + k, " ".join(w)))
    return out


def test_near_parts_meet_whole(spark, monkeypatch):
    """Components verified in parts are those of brute force; candidate links are given, so that none is left to chance."""
    data = star_copies(60)
    df = spark.createDataFrame([(i, t, *["x"] * 14) for i, t in data], SCHEMA)
    monkeypatch.setattr(simhash, "near_links", lambda vectors, *_, **__: vectors.crossJoin(vectors.agg({"fp": "min"}).toDF("b")).select(vectors["fp"].alias("a"), "b"))
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in simhash.near_classes(df, verify_rows=30, leaders=1).collect())
    assert got == Counter(brute_classes(data))


def test_loose_components_meet_few(spark, monkeypatch):
    """Of a component of many clusters only texts that may have a link to another cluster are compared part by part."""
    data = star_copies(20) + [(6000 + k, prose(600 + k, 120)) for k in range(180)]
    df = spark.createDataFrame([(i, t, *["x"] * 14) for i, t in data], SCHEMA)
    monkeypatch.setattr(simhash, "near_links", lambda vectors, *_, **__: vectors.crossJoin(vectors.agg({"fp": "min"}).toDF("b")).select(vectors["fp"].alias("a"), "b"))
    met, compare = spark.sparkContext.accumulator(0), simhash._meet

    def counted(similarity):
        run = compare(similarity)

        def rows(batches):
            for batch in batches:
                met.add(len(batch))
                yield batch

        return lambda batches: run(rows(batches))

    monkeypatch.setattr(simhash, "_meet", counted)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in simhash.near_classes(df, verify_rows=20, leaders=1).collect())
    assert got == Counter(brute_classes(data))
    assert met.value <= 3 * 21


def test_cluster_against_search():
    r = random.Random(6)
    for _ in range(40):
        sets = [np.asarray(sorted(r.sample(range(14), r.randint(1, 12))), np.uint64) for _ in range(25)]
        side, known = [r.randrange(2) for _ in sets], [r.randrange(20) for _ in sets]
        for s, k in ((None, None), (side, known)):
            label = list(range(25)) if k is None else [k.index(x) for x in k]
            for i, j in itertools.combinations(range(25), 2):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (s is None or s[i] != s[j]) and both >= 0.6 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
            assert simhash.cluster(sets, 0.6, k, s).tolist() == label


def test_near_dedup_keeps_one(spark):
    df = ugly(spark)
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    kept = Counter(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert set(kept) == {c for d, c, _ in brute_classes(rows()) if c is not None} and max(kept.values()) == 1
    assert simhash.near_dedup(empty(spark)).count() == 0 and simhash.near_classes(empty(spark)).count() == 0


def test_recall_of_lists():
    """The centres drawn for a recall give it on random pairs at the expected distance."""
    rng = np.random.default_rng(0)
    n = simhash.centres_for(0.9, 0.8)
    z = rng.integers(0, 2**32, n, dtype=np.uint32)
    share, hits = simhash.expected_distance(0.8), 0
    for _ in range(300):
        x = rng.integers(0, 2**32, dtype=np.uint32)
        y = x ^ np.uint32(sum(int(rng.random() < share) << b for b in range(32)))
        hits += bool(((np.bitwise_count(x ^ z) <= simhash.WEIGHT) & (np.bitwise_count(y ^ z) <= simhash.WEIGHT)).any())
    assert hits / 300 > 0.84


def test_recall_of_all_levels():
    """A pair at the expected distance keeps the recall asked for where its lists recurse to the last level."""
    rng = np.random.default_rng(1)
    centres = simhash.level_centres(0.95, 0.8)
    drawn = [[rng.integers(0, 2**32, -(-n // (4 if level == 0 else 1)), dtype=np.uint32) for _ in range(4 if level == 0 else 1)] for level, n in enumerate(centres)]
    share, hits, trials = simhash.expected_distance(0.8), 0, 1200

    def meet(x, y, z):
        z = z[np.bitwise_count(x ^ z) <= simhash.WEIGHT]
        return bool((np.bitwise_count(y ^ z) <= simhash.WEIGHT).any())

    for _ in range(trials):
        x = rng.integers(0, 2**32, 4, dtype=np.uint32)
        y = x ^ (rng.random((4, 32)) < share).astype(np.uint32) @ (np.uint32(1) << np.arange(32, dtype=np.uint32))
        hits += any(meet(x[s], y[s], drawn[0][s]) for s in range(4)) and all(meet(x[k], y[k], drawn[k][0]) for k in (1, 2, 3))
    assert hits / trials > 0.93


@pytest.mark.parametrize("options", [{"list_rows": 4}, {"list_rows": 1, "divide": 500}])
def test_long_lists_are_compared_whole(spark, options):
    """A list in parts gives the classes that it gives in one task."""
    r = random.Random(7)
    base = [r.getrandbits(128) for _ in range(3)]
    near = [base[k % 3] ^ sum(1 << b for b in r.sample(range(128), 12)) for k in range(120)]
    df = spark.createDataFrame([(bytearray(v.to_bytes(16, "little")),) for v in near], "fp binary")

    def classes(**options):
        parent = {}

        def root(v):
            while v in parent:
                v = parent[v]
            return v

        for x in simhash.near_links(df, **options).collect():
            a, b = sorted((root(bytes(x.a)), root(bytes(x.b))))
            if a != b:
                parent[b] = a
        return {v: root(v) for v in (n.to_bytes(16, "little") for n in near)}

    assert classes(**options) == classes()


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    links = [(a, b) for a, b in links if a != b]
    got = {x.node: x.label for x in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    seen = {}
    for a, b in links:
        seen.setdefault(a, {a}), seen.setdefault(b, {b})
        both = seen[a] | seen[b]
        for v in both:
            seen[v] = both
    assert got == {v: min(s) for v, s in seen.items()}


def test_components_keep_plans_small(spark):
    """What the plan says of the labels' size does not grow with the steps that a long chain takes."""
    r, n = random.Random(3), 60
    names = [str(x).zfill(9) for x in r.sample(range(n), n)]
    out = simhash.components(spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a string, b string"))
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert {(x.node, x.label) for x in out.collect()} == {(name, min(names)) for name in names}


def brute_repeats(data, length):
    texts = [(t or "").encode() for _, t in data]
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(data, texts, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def shared_passages():
    r = random.Random(4)
    shared = [prose(70 + k, 14 + k) for k in range(6)]
    out = [(2000 + k, prose(200 + k, 40) + r.choice(shared) + prose(300 + k, 30) + (r.choice(shared)[3:] if k % 3 else "")) for k in range(30)]
    return [*out, (3000, "ab" * 300), (3001, "x" * 99), (3002, "x" * 100), (3003, "abc" * 40), (3004, "é" * 80)]


@pytest.mark.parametrize("options", [{"n_batches": 5}, {"n_batches": 1, "segment": 150}, {"n_batches": 2, "contexts": 1}])
def test_repeats(spark, options):
    """Levels of one and several sizes, texts in many segments, and suffixes counted by exchange."""
    data = [x for x in rows() if len(x[1] or "") < 20_000] + shared_passages()
    df = spark.createDataFrame([(i, t, *["x"] * 14) for i, t in data], SCHEMA)
    got = suffix_dedup.remove_repeats(df, length=100, prefix=30, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_repeats(data, 100)
    for r in got:
        if r.spans:
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeats_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_levels_are_logarithmic(spark):
    family = suffix_dedup.IndexFamily()
    schema = "lead long, a long, c long"
    one = spark.createDataFrame([(0, 1, 2), (0, 1, 3)], schema)
    for i in range(5):
        family.add(one.union(spark.createDataFrame([(5, 10 + i, 7)], schema)))
    assert sorted(family.levels) == [1, 4]
    everything = family.entries(lambda batches: batches).collect()
    assert {(r.c, r.n) for r in everything if r.a == 1} == {(2, 5), (3, 5)}
    assert [r.a for r in family.repeated().collect()] == [1]
    family.drop()


def test_a_scan_meets_earlier_levels(spark):
    """A suffix that only an older, larger level holds is found when a new batch brings it again."""
    family, schema = suffix_dedup.IndexFamily(), "lead long, a long, c long"
    for a in (1, 2, 3, 2):
        family.add(spark.createDataFrame([(a, a, len(family.found))], schema))
    assert sorted(family.levels) == [4]
    assert [r.a for r in family.repeated().collect()] == [2]
    assert family.levels[4][0].count() == 4
    family.drop()
