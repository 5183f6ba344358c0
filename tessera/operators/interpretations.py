"""Rules of interpretations and queries, and the nested records of a retrieval run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import contains_any, hits
from tessera.operators.rules import Rule, which

# Beginnings of clinical words, which only a user may use; wordings of advice; names that no query may have.
DIAGNOSTIC = (
    "расстройств", "диагноз", "гиперопек", "гиперконтрол", "созависим", "нарцисс", "депресси", "невроз", "невротич", "травм",
    "патолог", "психопат", "биполяр", "паническ",
)
ADVICE = (
    r"\bвам следует\b", r"\bвам нужно\b", r"\bвы должны\b", r"\bвам надо\b", r"\bправильное решение\b", r"\bобратитесь к\b",
    r"\bсходите к\b", r"\bпопробуйте\b", r"\bрекомендую\b", r"\bлечени",
)
FORBIDDEN_ATTRIBUTES = ("demographics", "country", "gender", "age", "personality_type", "diagnosis", "tradition", "author")


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def tag_rules() -> list[Rule]:
    """Coordinates, canonical_tensions and free_tensions against the closed vocabularies."""
    twice = lambda c: F.size(_some(c)) > F.size(F.array_distinct(_some(c)))
    known = lambda names: lambda x: x.isin(*names)
    outside = lambda c, names: F.exists(_some(c), lambda x: ~known(names)(x))
    return [
        Rule("COORDINATE_NOT_CANONICAL", "error", outside("coordinates", schemas.COORDINATES), "coordinates"), Rule("DUPLICATE_VALUE", "error", which({c: twice(c) for c in ("coordinates", "canonical_tensions")}), each=True),
        Rule("TENSION_NOT_CANONICAL", "error", outside("canonical_tensions", schemas.TENSIONS), "canonical_tensions"), Rule("CANONICAL_AS_FREE", "error", F.exists(_some("free_tensions"), known(schemas.TENSIONS)), "free_tensions"),
        Rule("TENSION_FORMAT", "error", F.exists(_some("free_tensions"), lambda t: ~F.contains(t, F.lit("↔"))), "free_tensions"),
    ]


def interpretation_rules() -> list[Rule]:
    """An interpretation (proposed_question, other_questions, working_hypotheses, tags, free_narrative, difficulty_center).

    What it says of a person may not be clinical unless the person used the word, nor advice."""
    said = F.lower(F.concat_ws(" ", F.trim("proposed_question"), F.array_join(_some("working_hypotheses"), " ")))
    own = F.lower(F.concat_ws(" ", F.coalesce("free_narrative", F.lit("")), F.coalesce("difficulty_center", F.lit(""))))
    labels = F.filter(F.array(*map(F.lit, DIAGNOSTIC)), lambda t: F.contains(said, t) & ~F.contains(own, t))
    n = F.size(_some("working_hypotheses"))
    return [
        Rule("NOT_A_QUESTION", "error", ~F.coalesce(F.endswith(F.trim("proposed_question"), F.lit("?")), F.lit(False)), "proposed_question"), Rule("HYPOTHESES_COUNT", "error", ~n.between(2, 4), "working_hypotheses"),
        Rule("OTHER_QUESTIONS_COUNT", "error", F.size(_some("other_questions")) > 3, "other_questions"), Rule("DIAGNOSTIC_LABEL", "error", F.size(labels) > 0, "proposed_question"),
        Rule("ADVICE", "error", F.size(hits(said, ["(?U)" + p for p in ADVICE])) > 0, "proposed_question"), Rule("NO_COORDINATES", "error", F.size(_some("coordinates")) == 0, "coordinates"), *tag_rules(),
    ]


def query_rules(columns: list[str]) -> list[Rule]:
    """A retrieval query (confirmed_question, working_hypotheses, tags); `columns` are all of its attributes."""
    bad = [c for c in columns if c in FORBIDDEN_ATTRIBUTES]
    return [
        Rule("QUESTION_BLANK", "error", F.coalesce(F.trim("confirmed_question"), F.lit("")) == "", "confirmed_question"), Rule("HYPOTHESES_COUNT", "error", F.size(_some("working_hypotheses")) > 4, "working_hypotheses"),
        Rule("FORBIDDEN_ATTRIBUTE", "error", F.array(*map(F.lit, bad)).cast("array<string>"), each=True), *tag_rules(),
    ]


def traces(retrieved: DataFrame, queries: DataFrame, run_id: str, version: str) -> DataFrame:
    """One nested record a query of a run: its input, each route's candidates in order, and the pool with what found each card.

    `retrieved` is retrieval.retrieve's result; a list holds one query's candidates, two pools at most."""
    meaning = F.when(F.col("meaning_rank").isNotNull(), F.struct(F.col("meaning_rank").alias("rank"), F.col("card_id").alias("fragment_id"), F.lit("MEANING").alias("route"), F.col("meaning_score").alias("score")))
    structure = F.when(F.col("structure_rank").isNotNull(), F.struct(F.col("structure_rank").alias("rank"), F.col("card_id").alias("fragment_id"), F.lit("STRUCTURE").alias("route"), F.struct("tension_overlap", "coordinate_overlap").alias("signals")))
    found = F.array_compact(F.array(F.when(F.col("meaning_rank").isNotNull(), F.lit("MEANING")), F.when(F.col("structure_rank").isNotNull(), F.lit("STRUCTURE"))))
    pool = F.when(F.col("in_union"), F.struct(F.col("card_id").alias("fragment_id"), found.alias("found_by")))
    lists = retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_list(meaning)).alias("meaning_candidates"), F.array_sort(F.collect_list(structure)).alias("structure_candidates"), F.array_sort(F.collect_list(pool)).alias("candidate_pool"),
    )
    own = [c for c in queries.columns if c != "query_id"]
    both = queries.join(lists, "query_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c)
    return both.select(
        F.col("query_id").alias("item_id"), F.lit(run_id).alias("run_id"), F.lit(version).alias("benchmark_version"), F.struct(*own).alias("input"), *map(none, ("meaning_candidates", "structure_candidates", "candidate_pool"))
    )


def run_manifest(traces_: DataFrame, composed: DataFrame, composer: str, model: str) -> DataFrame:
    """One row: the run, who composed, how many cases there are, how many were composed and how many lack."""
    n = traces_.agg(F.min("run_id").alias("retrieval_run_id"), F.count("*").alias("cases"))
    done = traces_.join(composed.select("item_id").distinct(), "item_id", "left_semi").agg(F.count("*").alias("composed"))
    one = n.crossJoin(done)  # two single rows
    return one.select("retrieval_run_id", F.lit(composer).alias("composer"), F.lit(model).alias("model"), "cases", "composed", (F.col("cases") - F.col("composed")).alias("pending"))


def writer_brief(candidates: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, card_id, brief): what a writer is told of each selected card: its label, quotation and perspective, blank parts left out.

    A card that isn't there fails."""
    full = candidates.join(cards.withColumn("_there", F.lit(True)), "card_id", "left")
    parts = [("Источник", "label"), ("Цитата", "quote"), ("Перспектива", "perspective")]
    lines = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{n}: "), c)) for n, c in parts]))
    lost = F.raise_error(F.concat(F.lit("no card "), F.col("card_id").cast("string"))).cast("string")
    return full.select("query_id", "card_id", F.when(F.col("_there"), F.array_join(lines, "\n")).otherwise(lost).alias("brief"))


def copy_text(cards: DataFrame, key: str) -> DataFrame:
    """(key, text): a composed card as plain text for copying: its parts and its reference, each with a blank line between."""
    parts = ("main_idea", "applied_insight", "reflection_question", "reference")
    shown = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c)) for c in parts]))
    return cards.select(key, F.array_join(shown, "\n\n").alias("text"))


def marked_editorial(cards: DataFrame, fields: list[str], markers: tuple[str, ...]) -> DataFrame:
    """(id, field): fields of feedback material that still carry editorial marks."""
    return cards.select("id", F.explode(which({f: contains_any(f, markers) for f in fields})).alias("field"))
