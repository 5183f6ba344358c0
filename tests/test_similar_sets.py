import random

import numpy as np
import pytest

from tessera.operators import similar_sets

SCHEMA = "set_id long, items array<string>"


@pytest.mark.parametrize("percent", [30, 60, 80, 100])
def test_equals_all_pairs(spark, percent):
    r = random.Random(percent)
    words = [f"w{i}" for i in range(25)]
    sides = []
    for n in (60, 90):
        sets = {tuple(sorted(set(r.choice(words[: r.choice([6, 25])]) for _ in range(r.randint(1, 12))))) for _ in range(n)}
        sides.append([(i, list(s)) for i, s in enumerate(sorted(sets))])
    got = similar_sets.similar(*[spark.createDataFrame(s, SCHEMA) for s in sides], percent).collect()
    want = set()
    for i, x in sides[0]:
        for j, y in sides[1]:
            c, u = len(set(x) & set(y)), len(set(x) | set(y))
            if 100 * c >= percent * u:
                want.add((i, j, c, round(c / u, 6)))
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_one_word_in_all_sets(spark):
    """A common word is last in the order, so its list isn't met."""
    rows = [(i, ["all", f"a{i}", f"b{i}", f"c{i}"]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.left_id, r.right_id) for r in similar_sets.similar(df, df, 60).collect()) == [(i, i) for i in range(300)]


def test_classes_and_edges(spark):
    df = spark.createDataFrame([(3, ["b", "a"]), (1, ["a", "b", "a"]), (2, []), (4, None), (None, ["c"])], SCHEMA)
    assert sorted((r.set_id, r["items"], r.n_members) for r in similar_sets.classes(df, "set_id", "items").where("set_id IS NOT NULL").collect()) == [(1, ["a", "b"], 2)]
    assert similar_sets.similar(df.limit(0), df.limit(0)).count() == 0


def test_pairs_that_share_one_rare_word_are_left_out_in_the_join(spark):
    """Sets that have one item in common met as rows to be verified."""
    rows = [(i, sorted({f"z{i % 3}", *(f"{i}w{j}" for j in range(4)), *(f"all{j}" for j in range(5))})) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = similar_sets.similar(df, df, 60)
    assert sorted((r.left_id, r.right_id, r.common) for r in found.collect()) == [(i, i, 10) for i in range(60)]
    assert "bit_count" in found._jdf.queryExecution().executedPlan().toString()
    x = similar_sets._posted(df, spark.sparkContext.broadcast(similar_sets._classes_of(df)), 60, "x")
    assert x.groupBy("x_id").count().where("count <> 5").count() == 0


@pytest.mark.parametrize("percent", [40, 80])
def test_large_sets_by_blocks(spark, percent):
    r = random.Random(percent)
    base = [f"w{i}" for i in range(3000)]
    sets = [r.sample(base, r.choice([3, 40, 300, 1500])) for _ in range(12)]
    sets += [sorted({*x[: len(x) * r.choice([3, 7, 9, 10]) // 10], *r.sample(base, 2)}) for x in sets for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(sets)), SCHEMA)
    want, got = (sorted(map(tuple, similar_sets.similar(df.where("set_id % 2 = 0"), df, percent, large=x).collect())) for x in (False, True))
    assert want == got and len(got) > 24


def test_large_sets_are_no_rows_of_pairs(spark, monkeypatch):
    """Parities of sets of a thousand items ruled nothing out, and each pair was two whole sets in a join."""
    r = random.Random(5)
    sets = [sorted({"all", *(f"often{k}" for k in range(40) if r.random() < 0.5), *(f"w{r.randrange(400)}" for _ in range(r.choice([1, 30, 200])))}) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sets)), SCHEMA)
    want = {(i, j): len(x & y) for i, x in enumerate(map(set, sets)) for j, y in enumerate(map(set, sets)) if 100 * len(x & y) >= 40 * len(x | y)}
    for limits in ({}, {"LEFT": (20, 500), "RIGHT": (30, 700)}):
        for name, value in limits.items():
            monkeypatch.setattr(similar_sets, name, value)
        found = similar_sets.similar(df, df, 40, large=True)
        assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = found.collect()
        assert {(x.left_id, x.right_id): x.common for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("many, meetings", [(1 << 15, 1 << 22), (100, 50), (0, 1), (1 << 40, 7)])
def test_common_items_of_blocks(monkeypatch, many, meetings):
    monkeypatch.setattr(similar_sets, "MANY", many)
    monkeypatch.setattr(similar_sets, "MEETINGS", meetings)
    r = random.Random(many)
    sides = [[{r.choice([r.randrange(9), r.randrange(2000)]) for _ in range(r.choice([1, 5, 300]))} for _ in range(n)] for n in (40, 70)]

    def block(sets):
        pairs = sorted((i, k) for k, s in enumerate(sets) for i in s)
        return np.array([len(s) for s in sets]), np.array([i for i, _ in pairs]), np.array([k for _, k in pairs], np.int32)

    got = similar_sets._common(*map(block, sides))
    assert got.tolist() == [[len(a & b) for b in sides[1]] for a in sides[0]]
