"""Fusion by reciprocal ranks against full rankings."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours, rank_sums, retrieval


@pytest.mark.parametrize("k", [1, 3])
def test_sums_equal_those_of_full_rankings(spark, k, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    r = random.Random(k)
    some = [[r.gauss(0, 1) for _ in range(6)] for _ in range(400)]
    vectors = some + some[:60] + [[2 * x for x in v] for v in some[:40]] + [[0.0] * 6] * 5
    r.shuffle(vectors)
    c = spark.createDataFrame(list(enumerate(vectors)), "card_id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, v, vectors[(i * 7 + v * 31) % len(vectors)]) for i in range(9) for v in range(1 + i % 3)], "query_id long, view long, query_vector array<double>")
    assert rank_sums.even(q, c)
    want, got = (x.select("query_id", "card_id", "rank", "score") for x in (retrieval.fuse_rrf(retrieval.view_ranks(q, c), k), retrieval.rrf(q, c, k)))
    assert sorted(got.collect()) == sorted(want.collect())


def test_odd_rows_take_all_ranks(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.5, 1.0]), (2, None), (3, [1.0, float("nan")]), (4, [1.0])], "card_id long, vector array<double>")
    q = c.where("card_id < 3").select(F.col("card_id").alias("query_id"), F.monotonically_increasing_id().alias("view"), F.col("vector").alias("query_vector"))
    assert not rank_sums.even(q, c)
    want, got = retrieval.fuse_rrf(retrieval.view_ranks(q, c), 3), retrieval.rrf(q, c, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
