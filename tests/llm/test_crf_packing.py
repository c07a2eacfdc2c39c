"""The field's marginals and training against enumeration, packing against brute force and the library."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import _text, packing, quality_crf
from lodestar.llm.queries import op1_quality_classifier, vocabulary

from .tables import empty, rows, ugly

SF = "/root/testdata/sf0.01"
PATH = vocabulary("word_bpe_49k.json")


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    first = np.asarray([0, 4, 4, 5, 11])
    s, a = rng.normal(size=11), rng.normal(size=(2, 2))
    odds, _, _ = quality_crf.marginals(s, first, a)
    for b, e in itertools.pairwise(first):
        total = {0: np.zeros(e - b), 1: np.zeros(e - b)}
        for y in itertools.product((0, 1), repeat=int(e - b)):
            w = math.exp(sum(s[b + i] * v for i, v in enumerate(y)) + sum(a[u, v] for u, v in itertools.pairwise(y)))
            for i, v in enumerate(y):
                total[v][i] += w
        assert np.allclose(odds[b:e], np.log(total[1] / np.maximum(total[0], 1e-300))) or e == b


def test_features_do_not_depend_on_the_block():
    texts = [t or "" for _, t in rows()]
    import pyarrow as pa

    whole = [quality_crf.features(d, o)[2] for _, _, d, o in _text.blocks(pa.array(texts))]
    single = [quality_crf.features(d, o)[2] for _, _, d, o in _text.blocks(pa.array(texts), 1)]
    assert np.allclose(np.concatenate(whole), np.concatenate(single))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op1_quality_classifier(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_score_awkward_rows(spark):
    df = ugly(spark)
    model = quality_crf.fit(df, spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, n string"))
    got = quality_crf.score(df, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows())
    blank = {r.score for r in got if r.doc_id in (103, 104, 105)}
    assert blank == {model.prior}
    kept = quality_crf.keep_good(df, model)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    assert quality_crf.score(empty(spark), model).count() == 0 and quality_crf.keep_good(empty(spark), model).count() == 0
    none = quality_crf.fit(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.predicted for r in quality_crf.score(df, none).collect()} == {1}


def test_encode_like_the_library():
    import random

    from tokenizers import Tokenizer

    r = random.Random(5)
    bits = ["Straße", "É", "é", "É", "don't", "x's", "a.b", "ab!?", "12", "\x1c", "\x85", "<|endoftext|>", "ΟΔΟΣ", "Σ", "İ", "word,", " ", "  ", "\n", "...", "²", "日本", "\U0001f600", "´", "ÀÿÐ", "'", "_"]
    texts = [t or "" for _, t in rows()] + ["".join(r.choice(bits) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in packing.encode(PATH, texts)] == [e.ids for e in want]


def test_knapsack_by_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = 9
        v = np.where(rng.random(size + 1) < 0.6, rng.random(size + 1), 0)
        v[0] = 0
        most = rng.integers(0, 4, size + 1)
        first = int(rng.integers(1, size + 1))
        best = max((sum(v[k] for k in c) for m in range(size + 1) for c in itertools.combinations_with_replacement(range(1, size + 1), m) if sum(c) <= size - first and all(c.count(k) <= most[k] for k in c)), default=0)
        (chosen,) = packing._filled(*packing.knapsack(v, most, size), np.asarray([first]), size)
        chosen[first] -= 1
        assert sum(k * n for k, n in chosen.items()) <= size - first and sum(v[k] * n for k, n in chosen.items()) == pytest.approx(best)


@pytest.mark.parametrize("counts", [{5: 3}, {6: 40, 4: 40, 3: 7, 10: 2}, {7: 500, 3: 500, 2: 300, 9: 10, 1: 90}, {}])
def test_solve_places_all(counts):
    c = np.zeros(11, np.int64)
    for k, n in counts.items():
        c[k] = n
    got = np.zeros(11, np.int64)
    plan, _ = packing.solve(c, 10)
    for times, config in plan:
        assert sum(k * n for k, n in config.items()) <= 10
        for k, n in config.items():
            got[k] += times * n
    assert (got == c).all()
    bound = -(-int((c * np.arange(11)).sum()) // 10)
    assert sum(t for t, _ in plan) <= max(bound * 1.15 + 1, c[6:].sum())


@pytest.mark.parametrize("n", [10_000, 300_000])
def test_the_program_places_most(n):
    """Most pieces go by the linear program, in as many sequences as best fit needs or hardly more."""
    lengths = np.minimum(np.random.default_rng(3).lognormal(6.3, 1.1, n).astype(int) + 1, 4096)
    c = np.bincount(lengths, minlength=4097)
    plan, placed = packing.solve(c, 4096)
    assert placed > 0.6
    assert sum(t for t, _ in plan) <= 1.0001 * sum(t for t, _ in packing.best_fit(c, 4096)) + 1


@pytest.mark.parametrize("rank_rows", [50_000, 2])
def test_pack_round_trip(spark, rank_rows):
    from tokenizers import Tokenizer

    df = ugly(spark)
    pieces = packing.tokenized(df, PATH, with_ids=True, capacity=256)
    got = packing.pack(pieces, 256, rank_rows=rank_rows).collect()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, x in rows():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            want[i, k // 256, k, len(ids[k : k + 256]), np.asarray(ids[k : k + 256], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for x in by.values():
        at = 0
        for offset, length, _ in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by) <= 1.02 * total / 256 + 2
    whole = packing.sequences(packing.pack(pieces, 256, rank_rows=rank_rows)).collect()
    assert sum(r.length for r in whole) == total and all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.pack_documents(empty(spark), PATH).count() == 0
