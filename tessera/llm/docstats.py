"""Statistics of a text: the counts that quality rules name, and the features that classifiers learn from.

Words are runs of bytes other than ASCII white space, which `bytes.split` yields; every count is over the
whole text. A null text counts as empty; all its statistics are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import ASCII_SPACE, arrow_map

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
DIGITS, UPPER, PUNCTUATION = b"0123456789", bytes(range(65, 91)), b".,;:!?'\"()-"
FEATURES = (
    "log_words", "log_chars", "word_length", "symbol_share", "dup_line_share", "repeat_word_share", "digit_share",
    "upper_share", "punctuation_share", "distinct_word_share", "log_lines", "log_line_words", "top_word_share",
    "short_word_share", "wide_share", "byte_entropy", "log_longest_word", "newline_share",
)
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES of one text."""
    if not text:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size, chars = len(words), len(raw), len(text)
    without = lambda kind: size - len(raw.translate(None, kind))
    word_chars, symbols = chars - without(ASCII_SPACE), without(SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
            lines += 1
        elif line and not line.isspace():
            seen.add(line)
            lines += 1
    repeat, top, distinct, longest, short = 0, 0, 0, 0, 0
    if n:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        _, times = np.unique(h, return_counts=True)
        distinct, top = len(times), int(times.max())
        length = np.fromiter(map(len, words), np.int64, n)
        longest, short = int(length.max()), int((length <= 3).sum())
        if n > 2:
            w = h[:-2] * _M[0] + (h[1:-1] ^ _M[1]) * _M[2] + h[2:] * _M[1]
            _, back, times = np.unique(w, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            mark = np.zeros(n, bool)
            for k in range(3):
                mark[k : n - 2 + k] |= twice
            repeat = int(mark.sum())
    freq = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = freq[freq > 0] / size
    share = lambda a, b: a / b if b else 0.0
    features = [
        np.log1p(n), np.log1p(chars), share(word_chars, n), share(symbols, word_chars), share(dup, lines), share(repeat, n),
        share(int(freq[48:58].sum()), chars), share(int(freq[65:91].sum()), chars), share(sum(int(freq[b]) for b in PUNCTUATION), chars),
        share(distinct, n), np.log1p(lines), np.log1p(share(n, lines)), share(top, n), share(short, n), share(size - chars, size),
        float(-(p * np.log2(p)).sum()), np.log1p(longest), share(int(freq[10]), chars),
    ]
    return [n, word_chars, symbols, dup, repeat], [float(x) for x in features]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, *carry, *COUNTS as long, features as array<double>), a row for each row of `docs`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = zip(*map(statistics, batch.column(batch.num_columns - 1).to_pylist()))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays(
            [*kept, *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(features, pa.list_(pa.float64()))],
            [id_col, *carry, *COUNTS, "features"],
        )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry)]
    schema = ", ".join([*kinds, *(f"{c} long" for c in COUNTS), "features array<double>"])
    return arrow_map(docs.select(id_col, *carry, text_col), run, schema, pieces=True)
