"""Tag rankings by classes of equal sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, tag_classes


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("apart", [True, False])
def test_classes_equal_all_pairs(spark, seed, apart, monkeypatch):
    monkeypatch.setattr(tag_classes, "CARDS", 7)
    r = random.Random(seed)
    pick = lambda n: r.choice([None, [], *([r.sample(range(n), r.randrange(1, 4))] * 4)])
    rows = [(i, *[None if p is None else [f"{s}{x}" for x in p] for s, p in (("a", pick(70 if seed else 4)), ("b", pick(3)))]) for i in range(90)] + [(None, ["a1"], [])]
    c = spark.createDataFrame(rows, "card_id long, coordinates array<string>, tensions array<string>").repartition(3)
    q = c.where("card_id % 3 = 0").withColumnRenamed("card_id", "query_id")
    s = retrieval.structure_counts(q, c)
    s = s.where("query_id <> card_id") if apart else s
    for k in (1, 5, 200):
        want = retrieval.best(s.where("card_id IS NOT NULL"), ["query_id"], [F.desc("tension_overlap"), F.desc("coordinate_overlap"), F.asc("card_id")], k)
        got = retrieval.structure_rank(q, c, k, apart)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert sorted(retrieval.counted_ties(retrieval.overlap_counts(q, c, apart), 5).collect()) == sorted(retrieval.structure_ties(s, 5).collect())


def test_no_row_for_each_pair_of_ids(spark):
    c = spark.range(3000).select(F.col("id").alias("card_id"), F.array(F.lit("a")).alias("coordinates"), F.array(F.lit("b")).alias("tensions"))
    q = c.withColumnRenamed("card_id", "query_id")
    pairs = tag_classes.best_pairs(*(tag_classes.classes(x) for x in retrieval.mask_sides(*retrieval.tag_sides(q, c))[:2]), 15)
    assert pairs.count() == 1
