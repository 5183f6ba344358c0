import json

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import assembly, compositions, representations, rules, sessions

GOOD = {
    "id": "C0001", "tradition": "t", "author": "a", "work": "w", "location": "l", "fragment": "f", "thought": "t", "context": "c", "commentary": "c",
    "philosophical_questions": ["q?"], "coordinates": ["желание"], "tensions": [], "perspective": "p", "philosophical_operation": "DISTINGUISH",
    "question_structures": ["a↔b"], "relations": {"contrasts_with": [], "resonates_with": [], "complicates": []}, "translation": "t", "source": "s",
    "copyright_status": "ok", "source_verified": True, "interpretation_verified": True,
    "technical": {"operational_status": "verified", "retrieval_eligible": True, "recovery_status": None},
}


def codes(spark, change, state="READY"):
    record = json.loads(json.dumps(GOOD))
    for k, v in change.items():
        at = record
        *path, last = k.split(".")
        for p in path:
            at = at[p]
        at[last] = v
    df = spark.createDataFrame([(json.dumps(record),)], "raw string").select(F.from_json("raw", schemas.CARD).alias("r")).select("r.*").withColumn("state", F.lit(state))
    found = rules.card_rules(["DISTINGUISH"], ["a↔b"], ["[ред]"], {"thought": "Рабочее"})
    return sorted({(r.code, r.field) for r in rules.row_issues(df, found).collect()}, key=str)


def test_a_good_card_has_no_issue(spark):
    assert codes(spark, {}) == []


@pytest.mark.parametrize(("change", "code", "field"), [
    ({"work": " "}, "MISSING_SOURCE_IDENTITY", "work"), ({"question_structures": []}, "RETRIEVAL_METADATA_MISSING", "question_structures"),
    ({"thought": None}, "CONTENT_GAP", "thought"), ({"fragment": None}, "FRAGMENT_TEXT_ABSENT", "fragment"), ({"tensions": None}, "CONTENT_GAP", "tensions"),
    ({"perspective": "x [ред]"}, "EDITORIAL_TEXT_IN_MEANING", "perspective"), ({"coordinates": ["нет"]}, "INVALID_TAXONOMY_VALUE", "coordinates"),
    ({"tensions": ["желание ↔ долг (potential)", "x ↔ y"]}, "INVALID_TAXONOMY_VALUE", "tensions"), ({"coordinates": ["желание", "желание"]}, "DUPLICATE_VALUE", "coordinates"),
    ({"philosophical_operation": "X"}, "INVALID_OPERATION", "philosophical_operation"), ({"question_structures": ["ab"]}, "MALFORMED_QUESTION_STRUCTURES", "question_structures"),
    ({"question_structures": ["c↔d"]}, "UNKNOWN_QUESTION_STRUCTURE", "question_structures"), ({"question_structures": ["open / context-dependent", "a↔b"]}, "OPEN_MARKER_MIXED", "question_structures"),
    ({"relations": None}, "RELATIONS_UNAVAILABLE", "relations"), ({"relations.complicates": ["C0001"]}, "SELF_RELATION", "relations.complicates"),
    ({"source_verified": False}, "CARD_VERIFICATION_FLAG_FALSE", "source_verified"), ({"copyright_status": "check it"}, "COPYRIGHT_PENDING", "copyright_status"),
    ({"thought": "Рабочее чтение"}, "TEMPLATED_INTERPRETATION", None), ({"commentary": "[FINAL TEXTUAL PASS]"}, "PLACEHOLDER_TEXT", "commentary"),
    ({"technical.thought_placeholder": "x"}, "THOUGHT_PLACEHOLDER_PRESERVED", "thought"),
])
def test_one_change_one_code(spark, change, code, field):
    assert (code, field) in codes(spark, change)


def test_readiness_issue_and_recovery(spark):
    assert ("MEANING_NOT_READY", None) in codes(spark, {}, "GENERIC") and ("MEANING_THIN", None) in codes(spark, {}, "THIN")
    assert ("RECOVERY_GAP", "context") in codes(spark, {"context": None, "technical.recovery_status": "r"})


def test_json_issues(spark):
    rows = [(1, "{bad"), (2, '{"x": "s"}'), (3, '{"x": 1, "extra": 2}'), (4, '{"x": 1, "status": 2}'), (5, '{"x": 1}')]
    got = {(r.line, r.code) for r in rules.json_issues(spark.createDataFrame(rows, "line int, raw string"), "x int", ["x"]).collect()}
    assert got == {(1, "JSON_PARSE"), (2, "SCHEMA_TYPE"), (3, "UNKNOWN_FIELD"), (4, "FORBIDDEN_RUNTIME_FIELD")}


def test_final_corpus_contract(spark):
    base = dict.fromkeys(schemas.FINAL_CARD, "x")
    rows = [base | {"card_id": "C0001"}, base | {"card_id": "C0001"}, base | {"card_id": ""}, base | {"card_id": "X1"}, base | {"card_id": "C0002", "quote": " "}, base | {"card_id": "C0003", "verification_status": "bad"}]
    df = spark.createDataFrame([(n + 2, *[r[c] for c in schemas.FINAL_CARD]) for n, r in enumerate(rows)], "line int, " + ", ".join(f"{c} string" for c in schemas.FINAL_CARD))
    excluded = spark.createDataFrame([("C0002",)], "card_id string")
    got = {(r.line, r.problem) for r in rules.final_corpus_issues(df, schemas.FINAL_CARD, excluded, ["bad"]).collect()}
    assert got == {(3, "duplicate card_id"), (4, "blank card_id"), (5, "malformed card_id"), (6, "blank quote"), (6, "excluded"), (7, "forbidden verification_status")}
    with pytest.raises(ValueError, match="violation"):
        rules.require_clean(rules.final_corpus_issues(df, ["x"], excluded, []))


def test_assembly_layers_bar_each_other(spark):
    launch = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    card = spark.createDataFrame([("1", None)], "id string, thought string")
    recovery = spark.createDataFrame([("1", "r1"), ("2", "r2")], "id string, thought string")
    got = {r.id: r.thought for r in assembly.assemble(launch, [(card, ["thought"], "text"), (recovery, ["thought"], "text")], "id").collect()}
    assert got == {"1": None, "2": "r2", "3": None}
    filled = assembly.assemble(launch, [(card, ["thought"], None), (recovery, ["thought"], None)], "id")
    assert {r.id: r.thought for r in filled.collect()} == {"1": "r1", "2": "r2", "3": None}


def test_single_match_and_author(spark):
    titles = spark.createDataFrame([("A",), ("B",), ("C",)], "title string")
    sections = spark.createDataFrame([("A", "1"), ("A x", "9"), ("B x", "2"), ("B y", "2"), ("C x", "3"), ("C y", "4")], "section string, location string")
    assert {(r.title, r.location) for r in assembly.single_match(titles, sections).collect()} == {("A", "1"), ("B", "2")}
    cards = spark.createDataFrame([("1", " Plato "), ("2", None)], "id string, author string")
    assert [r.id for r in assembly.exclude_author(cards, "plato").collect()] == ["2"]
    with pytest.raises(KeyError):
        assembly.exclude_author(cards, "nobody")


def test_documents(spark):
    df = spark.createDataFrame([("перспектива", ["вопрос?"]), (None, [])], "p string, q array<string>")
    none = F.array().cast("array<string>")
    got = df.select(representations.card_text(F.col("p"), F.col("q")).alias("a"), representations.card_text_v1(F.col("p"), F.col("q"), F.array(F.lit("x")), none).alias("b"), representations.q1_text(F.lit("?"), none).alias("c")).collect()
    assert got[0].a == "Перспектива: перспектива\nФилософские вопросы:\n- вопрос?" and got[0].b == got[0].a + "\nКоординаты: x"
    assert got[1].a == "" and got[1].c == "Вопрос: ?\nРабочие интерпретации:"
    t = spark.range(1).select(*[representations.tension_match(F.lit(x), schemas.TENSIONS).alias(f"c{i}") for i, x in enumerate(("желание ↔ долг", "долг ↔ желание", "a ↔ b"))]).first()
    assert tuple(t) == ("exact", "reversed_poles", "case_specific")


def test_sessions_equal_loop(spark, sf):
    from tessera.plans import catalogue

    got = {r.user_id: (r.n_events, r.state, r.refused) for r in catalogue.session_state(spark, sf).collect()}
    logs = {}
    for e in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda e: (e.ts, e.event_id)):
        logs.setdefault(e.user_id, []).append(catalogue._STEPS.get(e.event_type, "other"))
    for user, steps in logs.items():
        state, refused = "new", 0
        for s in steps:
            to = sessions.TRANSITIONS[state].get(s)
            state, refused = (to, refused) if to else (state, refused + 1)
        assert got[user] == (len(steps), state, refused)


@pytest.mark.parametrize(("steps", "state", "refused"), [
    ("submit choose retrieve compose reflect", "reflected", 0), ("compose submit compose confirm compose", "answered", 2), ("submit confirm retrieve retrieve edit answer reflect reflect", "reflected", 0),
    ("submit confirm compose retrieve confirm", "retrieved", 1), ("reject choose confirm retrieve submit edit", "confirmed", 3), ("submit choose compose reflect compose retrieve choose", "confirmed", 2), ("", "new", 0),
])
def test_sessions_by_hand(spark, steps, state, refused):
    df = spark.createDataFrame([(steps.split(),)], "s array<string>")
    assert tuple(df.select(sessions.folded(F.col("s")).alias("f")).first().f) == (state, refused)


def test_compositions(spark):
    cards = spark.createDataFrame([("1", "Мысль.", "Применение.", "Что важно?"), ("2", "Раз два.", "", "Что? Как?")], "id string, main_idea string, applied_insight string, reflection_question string")
    got = {(r.id, r.problem) for r in compositions.card_problems(cards, ["id"], {"advice": ["должны"]}).collect()}
    assert got == {("2", "incomplete"), ("2", "one_question")}
    sel = spark.createDataFrame([(1, "a", "различить", "x y", "f"), (1, "b", "увидеть", "X, y!", "g"), (2, "z", "-", "e", "")], "query_id long, card_id string, distinction string, perspective_effect string, perspective_frame string")
    pool = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y")], "query_id long, card_id string")
    assert {(r.query_id, r.problem) for r in compositions.selection_problems(sel, pool).collect()} == {(1, "same_effect"), (2, "vague_distinction"), (2, "outside_pool")}
    claims = spark.createDataFrame([("k", "source", "c1", "The Word"), ("k", "user", "c2", "absent"), ("k", "user", "c3", "")], "k string, kind string, claim string, evidence string")
    texts = spark.createDataFrame([("k", "me", "in the word")], "k string, user_words string, source_data string")
    assert {(r.claim, r.problem) for r in compositions.grounding_problems(claims, texts, "k").collect()} == {("c2", "not_verbatim"), ("c3", "no_evidence")}
    quotes = spark.createDataFrame([("q", "p", "h", 2, 5, "cde"), ("r", "p", "h", 0, 3, "xyz"), ("s", "n", "h", 0, 1, "a")], "quote_id string, path string, sha256 string, start int, end int, quote string")
    files = spark.createDataFrame([("p", "h", "abcdef")], "path string, sha256 string, text string")
    assert {r.quote_id: r.problem for r in compositions.verified_quotes(quotes, files).collect()} == {"q": None, "r": "span", "s": "no_file"}
    long = spark.createDataFrame([("q", "Alpha beta gamma delta"), ("r", "unheard of words here")], "quote_id string, quote string")
    where = spark.createDataFrame([("p", "so «alpha  beta gamma delta» it is"), ("z", "nothing")], "path string, text string")
    assert [(r.quote_id, r.path) for r in compositions.quote_sources(long, where).collect()] == [("q", "p")]


def test_confirmations_and_provenance(spark):
    c = [("a", "confirmed", "q", "q", None), ("b", "confirmed", "q", "r", None), ("c", "edited", "q", "r", "r"), ("d", "replaced", "q", "q", None), ("e", "rejected", "q", None, None), ("f", "rejected", "q", "q", None), ("g", "edited", "q", "", "")]
    df = spark.createDataFrame(c, "id string, action string, proposed_question string, confirmed_question string, edited_text string")
    assert {(r.card_id, r.code) for r in rules.row_issues(df, rules.confirmation_rules()).collect()} == {
        ("b", "CONFIRMED_DIFFERS"), ("d", "OWN_TEXT_NOT_USED"), ("f", "REJECTED_BUT_CONFIRMED"), ("g", "OWN_TEXT_NOT_USED"),
    }
    p = [("a", "benchmark_adapter", "benchmark_case", "benchmark_case", "B01"), ("b", "benchmark_adapter", "user", None, ""), ("c", "live", "user", "model", None)]
    df = spark.createDataFrame(p, "id string, origin string, confirmed_question_source string, interpretation_source string, benchmark_item_id string")
    assert {(r.card_id, r.code, r.field) for r in rules.row_issues(df, rules.provenance_rules()).collect()} == {
        ("b", "BENCHMARK_SOURCE_UNMARKED", "confirmed_question_source"), ("b", "BENCHMARK_SOURCE_UNMARKED", "interpretation_source"), ("b", "BENCHMARK_ITEM_MISSING", "benchmark_item_id"),
    }


def test_status_and_tension_issues(spark):
    cards = spark.createDataFrame([("a", "verified", True), ("b", "unresolved", False), ("c", "verified", False), ("d", None, None), ("b2", "verified", True)], "id string, status string, eligible boolean")
    got = {(r.card_id, r.code) for r in rules.status_issues(cards, spark.createDataFrame([("b",), ("b2",), ("z",), (None,)], "id string")).collect()}
    assert got == {("c", "RETRIEVAL_ELIGIBILITY_MISMATCH"), ("d", "OPERATIONAL_STATUS_MISMATCH"), ("b2", "OPERATIONAL_STATUS_MISMATCH"), ("b2", "UNRESOLVED_IN_ALLOWLIST"), ("z", "UNRESOLVED_ID_MISSING")}
    t = [("a", "x ↔ y", "exact", "x ↔ y"), ("b", "y  ↔ x", "reversed_poles", "x ↔ y"), ("c", "y ↔ x", "exact", "x ↔ y"), ("d", "x", "exact", None), ("e", "p ↔ q", "case_specific", None), ("f", "p ↔ q", None, None), ("g", None, None, None)]
    got = {(r.card_id, r.code) for r in rules.tension_issues(spark.createDataFrame(t, "id string, text string, match string, taxonomy_tension string"), ["x ↔ y"]).collect()}
    assert got == {("c", "TENSION_MATCH_INCONSISTENT"), ("d", "TENSION_FORMAT"), ("f", "TENSION_MATCH_INCONSISTENT"), ("g", "TENSION_FORMAT")}


def test_checks_that_give_null_have_failed(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    assert {(r.id, r.check, r.ok) for r in rules.property_checks(df, "id", {"one": F.col("n") == 1, "some": F.col("n").isNotNull()}).collect()} == {("a", "one", True), ("a", "some", True), ("b", "one", False), ("b", "some", False)}
