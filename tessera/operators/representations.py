"""Texts that cards and queries are searched by, in versions, with content hashes; and their ablations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains_any

# Versions and headers of the text formats.
CARD_VERSION, CARD_VERSION_V1 = "meaning-card-doc/2.0", "meaning-card-doc/1.0"
Q0_VERSION, Q1_VERSION, Q1_VERSION_V1 = "q0-question-only/1.0", "q1-meaning-query/2.0", "q1-meaning-query/1.0"
PERSPECTIVE, QUESTIONS, COORDINATES, TENSIONS = "Перспектива: ", "Философские вопросы:", "Координаты: ", "Напряжения: "
QUESTION, HYPOTHESES, QUERY_TENSIONS = "Вопрос: ", "Рабочие интерпретации:", "Смысловые напряжения:"


def _empty() -> Column:
    return F.array().cast("array<string>")


def bullets(items: Column) -> Column:
    return F.transform(F.coalesce(items, _empty()), lambda q: F.concat(F.lit("- "), q))


def usable(text: str, markers: Sequence[str]) -> Column:
    """A text without editorial markers, else null; an empty one is null too."""
    return F.when((F.col(text) != "") & ~contains_any(text, markers), F.col(text))


def usable_list(items: str, markers: Sequence[str]) -> Column:
    return F.filter(F.coalesce(F.col(items), _empty()), lambda q: ~contains_any(q, markers))


def card_lines(perspective: Column, questions: Column) -> Column:
    first = F.when(perspective.isNotNull(), F.array(F.concat(F.lit(PERSPECTIVE), perspective))).otherwise(_empty())
    rest = F.when(F.size(questions) > 0, F.concat(F.array(F.lit(QUESTIONS)), bullets(questions))).otherwise(_empty())
    return F.concat(first, rest)


def card_text(perspective: Column, questions: Column) -> Column:
    """Perspective, then the questions as bullets under a header that only questions bring."""
    return F.array_join(card_lines(perspective, questions), "\n")


def card_text_v1(perspective: Column, questions: Column, coordinates: Column, tensions: Column) -> Column:
    """P1 and lines of coordinates and tensions, where there are any."""

    def line(header: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.array(F.concat(F.lit(header), F.array_join(items, "; ")))).otherwise(_empty())

    return F.array_join(F.concat(card_lines(perspective, questions), line(COORDINATES, coordinates), line(TENSIONS, tensions)), "\n")


def q1_text(question: Column, hypotheses: Column) -> Column:
    """The question and its hypotheses; their header stands even without any."""
    return F.array_join(F.concat(F.array(F.concat(F.lit(QUESTION), question), F.lit(HYPOTHESES)), bullets(hypotheses)), "\n")


def q1_text_v1(question: Column, hypotheses: Column, tensions: Column) -> Column:
    """P5: P4 and the tensions as bullets."""
    more = F.when(F.size(tensions) > 0, F.concat(F.array(F.lit(QUERY_TENSIONS)), bullets(tensions))).otherwise(_empty())
    return F.array_join(F.concat(F.array(q1_text(question, hypotheses)), more), "\n")


def represent(df: DataFrame, key: str, version: str, text: Column) -> DataFrame:
    """(key, version, text, sha256)."""
    return df.select(F.col(key).cast("string").alias("key"), F.lit(version).alias("version"), text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def variants(df: DataFrame, key: str, **texts: Column) -> DataFrame:
    """One row for each named variant of a text, from one scan."""
    rows = F.array(*[F.struct(F.lit(name).alias("variant"), text.alias("text")) for name, text in texts.items()])
    return df.select(F.col(key), F.explode(rows).alias("v")).select(key, "v.variant", "v.text")


def source_label(author: str, work: str, location: str) -> Column:
    """The parts that aren't empty, with commas."""
    return F.concat_ws(", ", *[F.nullif(F.trim(c), F.lit("")) for c in (author, work, location)])


def display_label(*parts: str) -> Column:
    """Distinct parts in order, with middle dots."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in parts]))), " · ")


def move_question(prefix: str, move: str) -> Column:
    """A question from a statement: its final stop becomes a question mark."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.trim(move), r"\.+$", ""), F.lit("?"))


def map_labels(items: Column, table: dict[str, str]) -> Column:
    """Items by a closed vocabulary; a label that isn't in it becomes null, to be reported."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(items, lambda x: F.element_at(pairs, x))


def split_tensions(refs: Column) -> tuple[Column, Column]:
    """Canonical and free tensions of array<struct<text, match, taxonomy_tension>>, each once, in order."""
    exact = F.filter(refs, lambda r: r["match"].isin("exact", "reversed_poles"))
    free = F.filter(refs, lambda r: ~r["match"].isin("exact", "reversed_poles"))
    return F.array_distinct(F.transform(exact, lambda r: r["taxonomy_tension"])), F.array_distinct(F.transform(free, lambda r: r["text"]))


def tension_match(text: Column, vocabulary: Sequence[str], separator: str = " ↔ ") -> Column:
    """Exact, reversed_poles (its halves swapped) or case_specific."""
    halves = F.split(text, separator)
    swapped = F.concat(F.get(halves, F.lit(1)), F.lit(separator), F.get(halves, F.lit(0)))
    return F.when(text.isin(*vocabulary), "exact").when(swapped.isin(*vocabulary), "reversed_poles").otherwise("case_specific")


def strip_quotes(text: Column) -> Column:
    """A centre without the guillemets around all of it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^«(.*)»$", "$1"))


def package(union: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, candidates, sha256): the union's cards as one ordered list for each query, J4 checked.

    `n_candidates` and `n_lost` say how many there are and how many have no card. A list holds one query's
    union, two pools at most."""
    full = union.join(cards.withColumn("_there", F.lit(True)), "card_id", "left")
    rows = full.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("card_id", "found_by", "text"))).alias("candidates"), F.count("*").alias("n_candidates"), F.count_if(F.col("_there").isNull()).alias("n_lost")
    )
    return rows.withColumn("sha256", F.sha2(F.to_json("candidates"), 256))
