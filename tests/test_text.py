import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("f", "given", "want"), [
    (X.collapse, "  a  b\n c ", "a b c"), (X.typography, "a --- b -- c", "a — b – c"), (X.token_norm, "Ёлка, ЁЖ!", "елка еж"),
    (X.move_norm, " The  Move.. ", "the move"), (X.sentence_count, "Раз. Два! Три…  Четыре?", 4), (X.word_count, "a-b «c» d_e", 4),
    (X.text_or_null, "  ", None), (lambda c: X.cut(c, 5), "abcdefg", "abcd…"), (lambda c: X.word_count(c, True), "a-b «c» d_e", 3),
])
def test_scalars(spark, f, given, want):
    assert one(spark, f("t"), t=given) == want


def test_missing(spark):
    assert one(spark, X.missing("t"), t=" ") is True
    df = spark.createDataFrame([([],), (None,), (["a"],)], "x array<string>")
    assert [r[0] for r in df.select(X.missing("x", "list")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(X.missing("x", "list", may_be_empty=True)).collect()] == [False, True, False]


def lead(quote, most=40):
    out, n = [], 0
    for s in [x for x in re.split(r"(?<=[.!?…])\s+", quote.strip()) if x]:
        k = len(re.findall(r"[\w«»-]+", s))
        if n + k > most:
            break
        out.append(s)
        n += k
    return " ".join(out) or None


def test_lead_excerpt_equals_loop(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", X.lead_excerpt("text").alias("x")).collect()
    for r in rows:
        if not re.search(r"[^\x00-\x7f]", r.text):
            assert r.x == lead(r.text)


def test_ngrams_and_runs(spark):
    assert one(spark, X.ngrams("t", 2), t="a b a b") == ["a b", "b a"]
    assert one(spark, X.ngrams("t", 9), t="a b") == []


def test_verbatim_and_stems(spark):
    q = "one two three four five six seven eight nine ten"
    assert one(spark, X.verbatim_excerpt("q", "e"), q=q, e="one two three four five six seven eight") is True
    assert one(spark, X.verbatim_excerpt("q", "e"), q=q, e=q) is False
    assert one(spark, X.stem_hits(F.array(F.lit("Свобода"), F.lit("долг")), "t"), t="о свободе говорят") == ["Свобода"]


def test_hits_fold_all_scripts(spark):
    assert one(spark, X.hits("t", [r"\bкоординат\w*", "xyz"]), t="КООРДИНАТЫ") == [r"\bкоординат\w*"]
    assert one(spark, X.hits_beyond("t", "g", ["a", "b"]), t="a b", g="b") == ["a"]
    assert one(spark, X.retold("d", "c"), d="Alpha beta gamma delta. Other words here entirely.", c="alpha beta gamma delta!") == ["Alpha beta gamma delta."]
    assert one(spark, X.quote_titles("t", ["Iliad"]), t="Iliad and «Iliad»") == "«Iliad» and «Iliad»"
    assert one(spark, X.message_for("t", [("time", "late"), ("x", "y")], "other"), t="timeout") == "late"
    assert one(spark, X.unqualified(F.array(F.lit("a (potential)"), F.lit("a"))), t="") == ["a"]
