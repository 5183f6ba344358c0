from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import interpretations as I
from tessera.operators import rules

SCHEMA = "id string, proposed_question string, other_questions array<string>, working_hypotheses array<string>, coordinates array<string>, canonical_tensions array<string>, free_tensions array<string>, free_narrative string, difficulty_center string"
GOOD = ("a", "Что здесь? ", [], ["h", "g"], [schemas.COORDINATES[0]], [schemas.TENSIONS[0]], ["a ↔ b"], "n", "c")


def issues(spark, **change):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    row = tuple(change.get(n, v) for n, v in zip(names, GOOD))
    df = spark.createDataFrame([row], SCHEMA)
    return sorted((r.code, r.field) for r in rules.row_issues(df, I.interpretation_rules()).collect())


def test_interpretations(spark):
    assert issues(spark) == []
    assert issues(spark, proposed_question="Вам следует уйти", working_hypotheses=["травма", None, "b", "c", "d"]) == [("ADVICE", "proposed_question"), ("DIAGNOSTIC_LABEL", "proposed_question"), ("HYPOTHESES_COUNT", "working_hypotheses"), ("NOT_A_QUESTION", "proposed_question")]
    assert issues(spark, proposed_question="Это ТРАВМА?", difficulty_center="моя травма") == []
    assert issues(spark, coordinates=None, canonical_tensions=["x", "x"], free_tensions=[schemas.TENSIONS[1], "flat"]) == [("CANONICAL_AS_FREE", "free_tensions"), ("DUPLICATE_VALUE", "canonical_tensions"), ("NO_COORDINATES", "coordinates"), ("TENSION_FORMAT", "free_tensions"), ("TENSION_NOT_CANONICAL", "canonical_tensions")]
    assert issues(spark, proposed_question=None) == [("NOT_A_QUESTION", "proposed_question")]


def test_traces_and_manifest(spark):
    r = spark.createDataFrame([(1, 10, 1, 0.9, None, None, None, True), (1, 11, 2, 0.8, 1, 2, 1, True), (1, 12, None, None, None, None, None, False)], "query_id long, card_id long, meaning_rank int, meaning_score double, structure_rank int, tension_overlap int, coordinate_overlap int, in_union boolean")
    q = spark.createDataFrame([(1, "what?"), (2, "none")], "query_id long, confirmed_question string")
    got = {x.item_id: x for x in I.traces(r, q, "r1", "0.1").collect()}
    assert [c.fragment_id for c in got[1].meaning_candidates] == [10, 11] and got[1].structure_candidates[0].signals.tension_overlap == 2
    assert [(c.fragment_id, c.found_by) for c in got[1].candidate_pool] == [(10, ["MEANING"]), (11, ["MEANING", "STRUCTURE"])] and got[2].candidate_pool == [] and got[1].input.confirmed_question == "what?"
    m = I.run_manifest(I.traces(r, q, "r1", "0.1"), spark.createDataFrame([(2,), (2,), (9,)], "item_id long"), "c", "m").first()
    assert (m.cases, m.composed, m.pending) == (2, 1, 1)


def test_texts_of_cards(spark):
    c = spark.createDataFrame([(1, "l", None, "p")], "card_id long, label string, quote string, perspective string")
    assert I.writer_brief(spark.createDataFrame([(5, 1)], "query_id long, card_id long"), c).first().brief == "Источник: l\nПерспектива: p"
    try:
        I.writer_brief(spark.createDataFrame([(5, 2)], "query_id long, card_id long"), c).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "no card 2" in str(e)
    d = spark.createDataFrame([(1, " a ", "", "q?", None)], "id long, main_idea string, applied_insight string, reflection_question string, reference string")
    assert I.copy_text(d, "id").first().text == "a\n\nq?"
    e = spark.createDataFrame([("1", "x ###", "y")], "id string, a string, b string")
    assert [(r.id, r.field) for r in I.marked_editorial(e, ["a", "b"], ("###",)).select("id", F.col("field")).collect()] == [("1", "a")]
