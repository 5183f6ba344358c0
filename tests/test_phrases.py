import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import phrases


def test_equals_patterns_and_a_loop(spark, monkeypatch):
    r = random.Random(6)
    words = ["ab", "abab", "b", "Ёж", "of the", "x.y", "the", "a+b"]
    listed = words + ["", "unheard of", "ABAB"]
    texts = [(i, "".join(r.choice([*words, " ", " ", "_", "."]) for _ in range(r.randint(0, 25)))) for i in range(80)] + [(90, None), (91, "ab" * 40_000)]
    docs = spark.createDataFrame([(*t, "mine") for t in texts], "doc_id long, text string, phrase string")
    p = spark.createDataFrame([(x,) for x in listed], "phrase string")
    want = {(i, w.lower()): len(re.findall(f"(?={re.escape(w.lower())})", t.lower())) for i, t in texts if t for w in listed if w and w.lower() in t.lower()}
    for letters in (1 << 20, 5):
        monkeypatch.setattr(phrases, "LETTERS", letters)
        rows = phrases.phrase_hits(docs, "doc_id", "text", p).collect()
        assert {(x.doc_id, x.phrase): x.n for x in rows} == want and len(rows) == len(want)
    plain = docs.select("doc_id", F.explode(X.hits("text", [re.escape(w.lower()) for w in words])).alias("p")).collect()
    assert {(x.doc_id, re.sub(r"\\(.)", r"\1", x.p)) for x in plain} == {k for k in want if k[1] in [w.lower() for w in words]}


def test_whole_words(spark):
    docs = spark.createDataFrame([(1, "the other then the_x the, (the)")], "doc_id long, text string")
    p = spark.createDataFrame([("the",)], "phrase string")
    assert [r.n for r in phrases.phrase_hits(docs, "doc_id", "text", p, whole_words=True).collect()] == [3]
    assert phrases.phrase_hits(docs, "doc_id", "text", p.limit(0)).count() == phrases.phrase_hits(docs.limit(0), "doc_id", "text", p).count() == 0


def test_hits_apart_and_texts_that_are_read_once(spark, sf):
    from tessera.plans import catalogue

    docs = spark.createDataFrame([(1, "aaaaa ab abab"), (1, "aaa"), (2, None)], "id long, text string")
    listed = spark.createDataFrame([("aa",), ("ab",), ("a",), ("bab",)], "phrase string")
    got = phrases.phrase_hits(docs, "id", "text", listed, apart=True)
    assert sorted((r.phrase, r.n) for r in got.collect()) == sorted((p, t.count(p)) for t in ("aaaaa ab abab", "aaa") for p in ("aa", "ab", "a", "bab") if p in t)
    plan = catalogue.queries()["phrase_detectors"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
