"""Word counts of line_dedup cover all texts."""

import numpy as np

from tessera.llm import line_dedup as L


def test_words_of_all_texts_are_counted(spark):
    rows = [(f"pair{i // 2} only{i}",) for i in range(120)]
    place = L.frequencies(spark.createDataFrame(rows, "text string"), "text")
    at = lambda words: place[(L.hash_words([w.encode() for w in words]) % np.uint64(L.CELLS)).astype(np.int64)]
    assert (at([f"pair{i}" for i in range(60)]) < L.KNOWN).all()
    assert (at([f"only{i}" for i in range(120)]) == L.UNSEEN).mean() > 0.95  # but for shared cells
