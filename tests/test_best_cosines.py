"""Rankings by blocks against all pairs' cosines, bit by bit."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import diagnostics, neighbours, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    some = [[r.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    vectors = some + [some[0]] * 40 + [[3 * x for x in some[1]]] * 9 + [[0.0] * 5, None, [1.0, None, 2.0, 3.0, 4.0], [1.0, 2.0], [], [float("nan")] * 5, [1e-160] * 5, [float("inf")] * 5]
    r.shuffle(vectors)
    c = spark.createDataFrame(list(enumerate(vectors)), "card_id long, vector array<double>").repartition(3)
    q = c.where("card_id % 4 = 0").select(F.col("card_id").alias("query_id"), F.lit(1).alias("view"), F.col("vector").alias("query_vector"))
    return q, c


@pytest.mark.parametrize("k", [1, 4, 30, 500])
@pytest.mark.parametrize("apart", [True, False])
def test_ranks_equal_those_of_all_pairs(spark, tables, k, apart, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    q, c = tables
    s = retrieval.cosine_scores(q, c)
    s = s.where("query_id <> card_id") if apart else s
    down = [F.desc("cosine"), F.asc("card_id")]
    want, got = (retrieval.best(x.select("query_id", "card_id", "cosine"), ["query_id"], down, k) for x in (s, neighbours.best_cosines(q, c, k, apart=apart)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_competition_ranks_keep_all_ties(spark, tables):
    q, c = tables
    keys = ("query_id", "view")
    want, got = (retrieval.found_by(x, 7).select(*keys, "card_id", "competition_rank") for x in (retrieval.cosine_scores(q, c, keys), neighbours.best_cosines(q, c, 7, keys, ties=True)))
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_ranking_makes_no_row_for_each_pair(spark, sf):
    from tessera.plans import catalogue

    plan = catalogue.meaning(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan


def test_group_means_without_pairs(spark):
    r = random.Random(4)
    c = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)] if i else [0.0] * 4, min(i % 3, i // 30 + 1)) for i in range(31)] + [(40, [1.0, 2.0, 3.0, 4.0], 9)], "card_id long, vector array<double>, grp long")
    q = c.where("card_id % 4 = 0").select(F.col("card_id").alias("query_id"), F.col("vector").alias("query_vector"))
    want = diagnostics.group_cosines(retrieval.cosine_scores(q, c).where("query_id <> card_id"), c)
    got = diagnostics.query_group_cosines(q, c)
    assert {(x.query_id, x.grp): pytest.approx(x.mean_cosine, abs=2e-6) for x in want.collect()} == {(x.query_id, x.grp): x.mean_cosine for x in got.collect()}
    assert "posexplode" in got._jdf.queryExecution().executedPlan().toString()  # sums of unit vectors


@pytest.mark.parametrize("many", [1, 1 << 22])
def test_quantiles_without_pairs(spark, tables, monkeypatch, many):
    monkeypatch.setattr(diagnostics, "MANY", many)
    monkeypatch.setattr(diagnostics, "COSINE_RANGES", 64)
    q, c = tables
    for least in (0, 1, 1000):  # with and without NaN; no pairs
        x, y = q.where(f"query_id >= {least}"), c.where("NOT exists(vector, v -> isnan(v) OR v = double('inf'))") if least == 1 else c
        want = diagnostics.quantiles(retrieval.cosine_scores(x, y).where("query_id <> card_id"), "cosine").first()
        got = diagnostics.cosine_quantiles(x, y).first()
        assert [v if v is None else round(v, 6) for v in got] == pytest.approx([v if v is None else round(v, 6) for v in want], abs=2e-6, nan_ok=True)


def test_case_study_ranks_without_pairs(spark):
    c = spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(20)], "card_id long, vector array<double>")
    ranked = spark.createDataFrame([(1, 1, 1)], "query_id long, card_id long, rank int")
    got = diagnostics.case_study(c.where("card_id % 4 = 0"), c, ranked)
    means = {r.card_id: r.centrality for r in diagnostics.centrality(c).collect()}
    assert {r.card_id: r.centrality_rank for r in got.collect()} == {i: 1 + sum(m > means[i] for m in means.values()) for i in range(0, 20, 4)}
    assert "Window" in got._jdf.queryExecution().executedPlan().toString()
