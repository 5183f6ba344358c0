import random

import numpy as np

from tessera.operators import quotations


def normal(t):
    return " ".join((t or "").lower().replace("ё", "е").translate({ord(c): None for c in '«»"'}).split())


def test_equals_containment(spark):
    r = random.Random(4)
    words = ["ab", "abc", "ёж", "e", "of", "the", "Word", "«in»", "x1", "zeta"]
    texts = [(f"t{i % 38}", " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(40)] + [("none", None)]
    quotes = [("blank", " "), ("null", None), ("miss", "ab unheard of the"), ("long", "of " * 60)]
    for i in range(120):
        t = r.choice(texts[:40])[1]
        at = r.randrange(len(t) + 1)
        quotes.append((f"q{i}", t[at : at + r.choice([1, 2, 3, 5, 9, 20, 200])]))
    got = quotations.quote_sources(spark.createDataFrame(quotes, "quote_id string, quote string"), spark.createDataFrame([(*t, 1) for t in texts], "path string, text string, q int"))
    want = {(i, p) for i, q in quotes for p, t in texts if normal(q)[:80] and normal(q)[:80] in normal(t)}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_many_places_in_one_text(spark, monkeypatch):
    monkeypatch.setattr(quotations, "PART", 2)
    text = " ".join(f"w{i}" for i in range(30))
    quotes = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4}") for i in range(25)], "quote_id long, quote string")
    texts = spark.createDataFrame([("p", text), ("s", "w1 " * 5000)], "path string, text string")
    assert sorted(r.quote_id for r in quotations.quote_sources(quotes, texts).collect()) == list(range(25))
    assert quotations.quote_sources(quotes.limit(0), texts).count() == quotations.quote_sources(quotes, texts.limit(0)).count() == 0
    plan = quotations.quote_sources(quotes, texts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_counts_without_a_row_for_each_place(spark, sf, monkeypatch):
    """Words that end alike and quotations of one letter and a word made a row for each of their places."""
    monkeypatch.setattr(quotations, "PART", 50)
    r = random.Random(5)
    texts = [(i, " ".join(r.choice(["the", "he", "ёж«e»", "le", "x"]) for _ in range(r.randint(0, 60)))) for i in range(50)] + [(50, None), (None, "the he")]
    quotes = ["e he", "e", "he", "", "nowhere", "the he le", "e x the he le x еж", "еже le"]
    got = quotations.quote_counts(spark.createDataFrame([(q,) for q in quotes + quotes], "quote string"), spark.createDataFrame(texts, "doc_id long, text string"))
    want = {(q, sum(q in normal(t) for _, t in texts), min((i for i, t in texts if i is not None and q in normal(t)), default=None)) for q in quotes if q}
    assert {tuple(x) for x in got.collect()} == {x for x in want if x[1]}
    assert quotations.quote_counts(spark.createDataFrame([("",)], "quote string"), spark.createDataFrame(texts, "doc_id long, text string")).count() == 0
    from tessera.plans import catalogue

    assert "Generate" not in catalogue.queries()["quote_search"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_windows_over_the_ends_of_parts(monkeypatch):
    monkeypatch.setattr(quotations, "PART", 4)
    every = [np.full(1 << (quotations.BITS - 3), 255, np.uint8)] * 2
    got = quotations._grams(["abcdefghij", "", "xy", "abcabcabc"], {2: [2], 3: [3], 5: [5]}, every)
    assert got == [{t[i : i + n] for n in (2, 3, 5) for i in range(len(t) - n + 1)} for t in ("abcdefghij", "", "xy", "abcabcabc")]
