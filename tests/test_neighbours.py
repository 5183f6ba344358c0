import random

import numpy as np
import pytest

from tessera.operators import neighbours


@pytest.mark.parametrize("sizes", [(1024, 4096), (3, 7)])
def test_equals_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(neighbours, "QUERIES", sizes[0])
    monkeypatch.setattr(neighbours, "CARDS", sizes[1])
    r = random.Random(2)
    vectors = {i: [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for i in range(90)} | {90: [0.0] * 4, 91: None}
    c = spark.createDataFrame(list(vectors.items()), "card_id long, vector array<double>").repartition(4)
    q = spark.createDataFrame([(i, v) for i, v in vectors.items() if i % 9 == 0], "query_id long, query_vector array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    want = []
    for i, v in vectors.items():
        if i % 9 == 0 and v is not None:
            scored = sorted((-round(float(unit(v) @ unit(w)), 9) + 0.0, j) for j, w in vectors.items() if w is not None and j != i)
            want += [(i, j, n + 1, -s + 0.0) for n, (s, j) in enumerate(scored[:12])]
    got = sorted(tuple(x) for x in neighbours.nearest(q, c, 12, apart=True).collect())
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in sorted(want)]
    assert neighbours.nearest(q, c.limit(0), 3).count() == neighbours.nearest(q.limit(0), c, 3).count() == 0


def test_text_ids_and_lengths(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "card_id string, vector array<double>")
    q = spark.createDataFrame([("a", [2.0, 0.0])], "query_id string, query_vector array<double>")
    assert [(r.card_id, r.rank) for r in neighbours.nearest(q, c, 5).collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="several lengths"):
        neighbours.nearest(q, spark.createDataFrame([("a", [1.0]), ("b", [1.0, 1.0])], "card_id string, vector array<double>").coalesce(1), 5).collect()
