"""Quality classifier (operator 1): a linear-chain conditional random field labels every line good or bad.

A line's features are its own measures and those of the lines before and behind it. The field is trained on documents
with a label, every line carrying its document's. Marginals by forward-backward, weighted by line length, add up to
the document's quality, which a logistic calibration on the training documents turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _run
from . import _text as T

#: Bounds of what the field is fitted on: labelled documents, and consecutive lines of each.
TRAIN_DOCUMENTS, TRAIN_LINES = 4000, 128

_KINDS = np.full(256, 9, np.int64)  # 9: other ASCII
for _i, _set in enumerate((b" \t", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"#*$%&@^~+=_\\", b"|", b"<>[]{}/")):
    _KINDS[list(_set)] = _i
_KINDS[128:] = 10  # letters of two and more bytes
_KINDS[0xC3] = 11
N_OWN = 22


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each line, its length in bytes, own features, first line of each text), of lines with a solid byte."""
    n = len(offsets) - 1
    text, start, end = T.lines(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~T.SPACE[data], out=solid[1:])
    has = solid[end] > solid[start]
    text, start, end = text[has], start[has], end[has]
    m, size = len(text), (end - start).astype(float)
    # Every byte of a line counts once for its kind.
    of_byte = np.repeat(np.arange(m), end - start)
    where = np.arange(len(of_byte)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + np.repeat(start, end - start)
    kinds = np.bincount(of_byte * 12 + _KINDS[data[where]], minlength=12 * m).reshape(m, 12).astype(float)
    w_text, w_start, w_end = T.words(data, offsets)
    line = np.searchsorted(start, w_start, "right") - 1
    words = np.bincount(line, minlength=m).astype(float)
    h = T.Hasher(data)
    _, again = T.repeated(T.salted(h.of(w_start, w_end), line if m else w_text))
    repeats = np.bincount(line[again], minlength=m)
    tail = data[end - 1] if m else np.empty(0, np.uint8)
    head = data[start] if m else np.empty(0, np.uint8)
    odd_tail = np.isin(data[w_end - 1], np.frombuffer(b"!#*$%&|", np.uint8)) if len(w_end) else np.empty(0, bool)
    odd_words = np.bincount(line[odd_tail], minlength=m)
    twice, before = T.repeated(T.salted(h.of(start, end), text))
    keys, at = T.grams(h.of(w_start, w_end), w_text, 4)
    gram_twice, _ = T.repeated(T.salted(keys, w_text[at]))
    in_grams = np.bincount(line[T.covered(at[gram_twice], 4, len(w_text))], minlength=m)
    safe, many = np.maximum(size, 1), np.maximum(words, 1)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 10] + kinds[:, 11]
    own = np.stack([
        np.log1p(size), np.log1p(words), size / many / 10, kinds[:, 2] / np.maximum(letters, 1), kinds[:, 3] / safe, kinds[:, 4] / many, np.minimum(kinds[:, 5] / many, 2), np.minimum(kinds[:, 6] / many, 2),
        np.minimum(kinds[:, 7] / many, 2), np.minimum(kinds[:, 8] / many, 2), (kinds[:, 10] + kinds[:, 11]) / safe, letters / safe, repeats / many, odd_words / many, in_grams / many, twice.astype(float), before.astype(float),
        (kinds[:, 5:9].sum(1) > 0).astype(float), np.isin(tail, np.frombuffer(b".!?", np.uint8)).astype(float), ((head >= 65) & (head <= 90)).astype(float), (words < 4).astype(float), np.minimum(kinds[:, 9] / safe, 1),
    ], axis=1) if m else np.zeros((0, N_OWN))
    return text, size, own, np.searchsorted(text, np.arange(n + 1))


def with_neighbours(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and behind (zero at a text's ends), and marks of the ends."""
    m = len(own)
    out = np.zeros((m, 3 * own.shape[1] + 2))
    out[:, : own.shape[1]] = own
    same = text[1:] == text[:-1]
    k = own.shape[1]
    if m:
        out[1:, k : 2 * k] = own[:-1] * same[:, None]
        out[:-1, 2 * k : 3 * k] = own[1:] * same[:, None]
        out[0, -2] = out[-1, -1] = 1
        out[1:, -2], out[:-1, -1] = ~same, ~same
    return out


def _message(r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log-odds of the next state from the log-odds ``r`` of this one, through transition scores ``a``."""
    return np.logaddexp(a[0, 1], r + a[1, 1]) - np.logaddexp(a[0, 0], r + a[1, 0])


def marginals(score: np.ndarray, first: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of "good" for each line, forward messages, backward messages) of all chains side by side.

    ``first[i]:first[i + 1]`` are the lines of chain i. Chains take their steps together, the longest first.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    ahead, back = score.astype(float).copy(), np.zeros(len(score))
    alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        ahead[at] += _message(ahead[at - 1], a)
    end = begin + n - 1
    for t in range(1, len(alive)):
        at = end[: alive[t]] - t
        back[at] = _message(score[at + 1] + back[at + 1], a.T)
    return ahead + back, ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def raw(self, text: np.ndarray, size: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text; the middle for texts without lines."""
        x = (with_neighbours(own, text) - self.mean) / self.scale
        odds, _, _ = marginals(x @ self.weights + self.bias, first, self.transitions)
        n = len(first) - 1
        total = np.bincount(text, weights=size, minlength=n)
        return np.where(total > 0, np.bincount(text, weights=size * _sigmoid(odds), minlength=n) / np.maximum(total, 1e-9), 0.5)

    def quality(self, raw: np.ndarray, lined: np.ndarray) -> np.ndarray:
        p = np.clip(raw, 1e-4, 1 - 1e-4)
        return np.where(lined, _sigmoid(self.slope * np.log(p / (1 - p)) + self.offset), self.prior)


def train(chains: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 250, rate: float = 0.05, decay: float = 1e-3, seed: int = 0) -> Model:
    """Fit by Adam on the conditional likelihood of all chains; each is (line sizes, own features, label)."""
    del seed  # nothing is drawn
    chains = [c for c in chains if len(c[0])]
    if not chains or len({c[2] for c in chains}) < 2:
        prior = float(np.mean([c[2] for c in chains])) if chains else 0.5
        k = 3 * N_OWN + 2
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, np.zeros((2, 2)), 0.0, float(np.log((prior + 0.01) / (1.01 - prior))), prior)
    sizes = np.concatenate([c[0] for c in chains])
    own = np.concatenate([c[1] for c in chains])
    n = np.asarray([len(c[0]) for c in chains])
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    label = np.asarray([c[2] for c in chains], float)
    y = label[text]
    x = with_neighbours(own, text)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    weight = (1 / n)[text] / len(n)  # every document counts alike
    inner = np.flatnonzero(text[1:] == text[:-1])
    k = x.shape[1]
    theta, m1, m2 = np.zeros(k + 5), np.zeros(k + 5), np.zeros(k + 5)
    for step in range(1, steps + 1):
        w, b, a = theta[:k], theta[k], theta[k + 1 :].reshape(2, 2)
        score = x @ w + b
        odds, ahead, back = marginals(score, first, a)
        d = weight * (y - _sigmoid(odds))
        # Pairs of neighbouring states, from the messages on both sides.
        u, v = ahead[inner], score[inner + 1] + back[inner + 1]
        pair = np.stack([np.full(len(u), a[0, 0]), a[0, 1] + v, u + a[1, 0], u + v + a[1, 1]])
        pair = np.exp(pair - pair.max(0))
        pair /= pair.sum(0)
        seen = np.stack([1 - y[inner], np.zeros(len(u)), np.zeros(len(u)), y[inner]])
        grad = np.concatenate([x.T @ d, [d.sum()], ((seen - pair) * weight[inner]).sum(1)])
        grad -= decay * theta * np.concatenate([np.ones(k), [0.0], np.full(4, 20.0)])  # chains of one label would push transitions without end
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, scale, theta[:k], float(theta[k]), theta[k + 1 :].reshape(2, 2), prior=float(label.mean()))
    raw = np.clip(model.raw(text, sizes, own, first), 1e-4, 1 - 1e-4)
    z = np.log(raw / (1 - raw))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method with a small ridge
        p = _sigmoid(slope * z + offset)
        r = np.maximum(p * (1 - p), 1e-9)
        g = np.asarray([np.mean((label - p) * z) - 1e-3 * (slope - 1), np.mean(label - p)])
        h = np.asarray([[np.mean(r * z * z) + 1e-3, np.mean(r * z)], [np.mean(r * z), np.mean(r) + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + move[0], offset + move[1]
    model.slope, model.offset = float(max(slope, 1e-3)), float(offset)
    return model


def fit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", documents: int = TRAIN_DOCUMENTS, lines: int = TRAIN_LINES, seed: int = 11) -> Model:
    """Fit on at most ``documents`` labelled documents, drawn by a seeded hash, and ``lines`` of each from a seeded place.

    Labels and ids choose and mark the training rows; only texts give features. Where an id has several labels the
    largest counts; rows without id or label are not used.
    """
    drawn = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("labelled_id")).agg(F.max(label_column).cast("int").alias("label"))
    drawn = drawn.orderBy(_run.seeded(seed, "labelled_id"), "labelled_id").limit(documents)
    # At most ``documents`` rows are broadcast.
    rows = df.select(F.col(id_column).alias("labelled_id"), F.col(text_column)).join(F.broadcast(drawn), "labelled_id").select("labelled_id", "label", text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, data, offsets in T.blocks(batch.column(2)):
                _, size, own, first = features(data, offsets)
                who, label, s, x = batch.column(0)[begin:stop], batch.column(1)[begin:stop], [], []
                for i in range(stop - begin):
                    a, b = int(first[i]), int(first[i + 1])
                    if b - a > lines:
                        a += int(T.mix(np.asarray([b - a + seed], np.uint64))[0] % np.uint64(b - a - lines + 1))
                        b = a + lines
                    s.append(size[a:b].astype("<f4").tobytes())
                    x.append(own[a:b].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([who.cast(pa.string()), label, pa.array(s, pa.binary()), pa.array(x, pa.binary())], names=["id", "label", "size", "own"])

    got = rows.mapInArrow(run, "id string, label int, size binary, own binary").collect()
    got.sort(key=lambda r: (r["id"], bytes(r["size"]), bytes(r["own"])))
    seen, chains = set(), []
    for r in got:  # repeated rows of one id count once
        if r["id"] not in seen:
            seen.add(r["id"])
            chains.append((np.frombuffer(r["size"], "<f4").astype(float), np.frombuffer(r["own"], "<f4").astype(float).reshape(-1, N_OWN), int(r["label"] > 0)))
    return train(chains)


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``df``: doc_id, score, predicted, good_share (length-weighted mean marginal), n_lines.

    Whole texts are scored where they lie, without a shuffle. Null, empty and blank texts have no lines and score the
    training documents' share of label 1. Repeated rows are scored each; an empty table gives no rows.
    """
    field = df.select(id_column).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, data, offsets in T.blocks(batch.column(1)):
                text, size, own, first = features(data, offsets)
                raw, n = model.raw(text, size, own, first), np.diff(first)
                p = model.quality(raw, n > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:stop], pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(raw), pa.array(n.astype(np.int64))], names=["doc_id", "score", "predicted", "good_share", "n_lines"])

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {field.dataType.simpleString()}, score double, predicted int, good_share double, n_lines long")


def keep_good(df: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``; all columns as they are."""
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, data, offsets in T.blocks(batch.column(at)):
                text, size, own, first = features(data, offsets)
                good = model.quality(model.raw(text, size, own, first), np.diff(first) > 0) >= threshold
                yield batch.slice(begin, stop - begin).filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
