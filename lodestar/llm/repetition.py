"""Quality rules (operator 7): repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T

#: n-gram length → largest share of a text's word characters that may lie in its repeated n-grams (the first not counted).
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest shares of lines, and of characters in lines, that may repeat an earlier line.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(data: np.ndarray, offsets: np.ndarray, gram_limits: dict[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT, line_chars_limit: float = LINE_CHARS_LIMIT) -> dict[str, np.ndarray]:
    """All measures of one block of texts."""
    n = len(offsets) - 1
    text, start, end = T.words(data, offsets)
    h = T.Hasher(data)
    hashes = h.of(start, end)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(T.LEAD[data], out=lead[1:])
    chars = lead[end] - lead[start]
    n_words = np.bincount(text, minlength=n)
    word_chars = np.bincount(text, weights=chars, minlength=n).astype(np.int64)

    line_text, line_start, line_end = T.lines(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~T.SPACE[data], out=solid[1:])
    has = solid[line_end] > solid[line_start]
    line_text, line_start, line_end = line_text[has], line_start[has], line_end[has]
    _, again = T.repeated(T.salted(h.of(line_start, line_end), line_text))
    n_lines = np.bincount(line_text, minlength=n)
    n_dup_lines = np.bincount(line_text[again], minlength=n)
    line_chars = lead[line_end] - lead[line_start]
    dup_line_chars = np.bincount(line_text[again], weights=line_chars[again], minlength=n)
    all_line_chars = np.bincount(line_text, weights=line_chars, minlength=n)

    keys, at = T.grams(hashes, text, 8)
    twice, _ = T.repeated(T.salted(keys, text[at]))
    n_repeat = np.bincount(text[T.covered(at[twice], 8, len(text))], minlength=n)

    # Texts without a repeated run of the shortest length have none of a longer one.
    bad = (n_dup_lines > line_limit * n_lines) | (dup_line_chars > line_chars_limit * all_line_chars)
    shares = np.zeros((n, len(gram_limits)))
    live_hashes, live_text, live_chars = hashes, text, chars
    for i, (width, limit) in enumerate(sorted(gram_limits.items())):
        keys, at = T.grams(live_hashes, live_text, width)
        _, again = T.repeated(T.salted(keys, live_text[at]))
        inside = T.covered(at[again], width, len(live_text))
        share = np.bincount(live_text[inside], weights=live_chars[inside], minlength=n) / np.maximum(word_chars, 1)
        shares[:, i] = share
        bad |= share > limit
        some = np.zeros(n, bool)
        some[live_text[inside]] = True
        stay = some[live_text]
        live_hashes, live_text, live_chars = live_hashes[stay], live_text[stay], live_chars[stay]
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": T.per_text(_SYMBOL[data], offsets), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~(base_failed | bad), "gram_share": shares.max(axis=1, initial=0.0),
        "dup_line_share": dup_line_chars / np.maximum(all_line_chars, 1),
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, gram_share double, dup_line_share double"


def repetition_rules(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram_limits: dict[int, float] | None = None) -> DataFrame:
    """One row for each row of ``df``: its id, the measures and the verdict ``kept``.

    Every whole text is measured in its own task without a shuffle, so neither keys nor copies can be hot. A null
    or empty text has no words and fails the base rule; repeated rows get a row each; an empty table gives no rows.
    Other columns of ``df`` are not read.
    """
    limits = dict(GRAM_LIMITS if gram_limits is None else gram_limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in T.blocks(batch.column(1)):
                got = measure(data, offsets, limits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *(pa.array(v) for v in got.values())], names=["doc_id", *got])

    kind = df.select(id_column).schema[0].dataType.simpleString()
    return df.select(df[id_column], df[text_column]).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
