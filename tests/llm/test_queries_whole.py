"""The queries themselves, with their own parameters, over whole tables: against brute force or the library."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestar.llm import queries as Q

from .test_near_and_repeats import shingles

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, columns, sf=SF):
    return duckdb.connect().execute(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return dict(table("documents", "doc_id, text"))


def test_op1(spark):
    """On the fold that is held out; the smallest table has only 19 of its labels, so this is the next larger one."""
    sf = "/root/testdata/sf0.01"
    got = Q.op1_quality_classifier(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for (i,) in table("documents", "doc_id", sf))
    labels = dict(table("labels", "doc_id, quality", sf))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95


def test_op3(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary("word_bpe_49k.json"))
    want, total = Counter(), 0
    for i, text in documents.items():
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    got = Q.op3_packing(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-total // 4096) + 1


def test_op5(spark):
    talks = defaultdict(list)
    for c, n, role, text in table("conversations", "conv_id, turn, role, text"):
        talks[c].append((n, role, text or ""))
    said = "\\### Assistant: </turn> ok"
    talks[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in Q.op5_chat_formatting(spark, SF).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        r, loss = got[c], "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.formatted_chars > sum(len(t) for _, _, t in turns)


def test_op6(spark, documents):
    """Every 400-byte string by its own bytes."""
    texts = {i: (t or "").encode() for i, t in documents.items()}
    seen: dict[bytes, tuple] = {}
    gone = {i: bytearray(len(b)) for i, b in texts.items()}
    for i, b in texts.items():
        for p in range(len(b) - 399):
            h = hashlib.blake2b(b[p : p + 400], digest_size=12).digest()
            if h in seen:
                for k, q in ((i, p), seen[h]):
                    gone[k][q : q + 400] = b"\x01" * 400
            else:
                seen[h] = i, p
    got = {r.doc_id: r for r in Q.op6_suffix_dedup(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, b in texts.items():
        g, r = gone[i], got[i]
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), sum(g), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))


def rules(text):
    """All rules of operator 7 by plain Python."""
    from lodestar.llm import repetition as R

    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]] if len(lines) < 2000 else [x for k, x in enumerate(lines) if lines.index(x) < k]

    def inside(n, first):
        runs, seen, mark = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)), set(), set()
        for k in range(len(words) - n + 1):
            run = tuple(words[k : k + n])
            if (runs[run] > 1) if first else run in seen:
                mark.update(range(k, k + n))
            seen.add(run)
        return mark

    chars = sum(map(len, words))
    n_repeat = len(inside(8, True))
    base = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    bad = len(again) > R.LINE_LIMIT * len(lines) or sum(map(len, again)) > R.LINE_CHARS_LIMIT * sum(map(len, lines))
    bad = bad or any(sum(len(words[k]) for k in inside(n, False)) / max(1, chars) > limit for n, limit in R.GRAM_LIMITS.items())
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(again), n_repeat, base, not (base or bad)


def test_op7(spark, documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in Q.op7_quality_rules(spark, SF).collect()}
    assert got == {i: rules(t or "") for i, t in documents.items()}
    assert len({x[-1] for x in got.values()}) == 2


def test_op8(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in documents.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op8_token_counts(spark, SF).collect()} == {i: (b, n, n > 512) for i, (b, n) in want.items()}


def test_op9(spark):
    rows = table("documents", "doc_id, text, source")
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    of = defaultdict(int)
    for i, _, s in rows:
        of[s] += size[i]
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, share = {}, set(names), 1.5 * sum(of.values())
    while left:
        unit = share / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * unit > 2 * of[s]]
        if not over:
            target |= {s: weight[s] * unit for s in left}
            break
        for s in over:
            target[s] = 2.0 * of[s]
            share -= target[s]
            left.remove(s)
    got, taken = Q.op9_mixing(spark, SF).collect(), defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(size)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.size == size[r.doc_id] and r.source_size == of[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, Q.op9_mixing(spark, SF).collect()))


def test_op10(spark, documents):
    """No link between different texts is lost on this table, and no class holds texts that no chain of links joins."""
    ids = sorted(documents)
    sets = {i: shingles(documents[i]) for i in ids}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if (documents[i] or "") == (documents[j] or "") or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in Q.op10_simhash(spark, SF).collect()}
    assert got == {i: root(i) for i in ids}
