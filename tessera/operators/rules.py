"""A catalogue of declarative rules: row rules give issues, set rules are aggregates and anti joins.

An issue is (severity, code, card_id, field). Each row rule is a condition or an array of offending fields;
all of them are evaluated in one pass over the cards, and `issues` unions what the set rules find.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import collapse, contains_any, missing, strip_qualifier, word_tokens

ISSUE = "array<struct<severity:string,code:string,field:string>>"
THIN = 5


@dataclass(frozen=True)
class Rule:
    """`when`: a condition, or an array of field names with one issue for each."""

    code: str
    severity: str
    when: Column
    field: str | None = None
    each: bool = False


def row_issues(cards: DataFrame, rules: Sequence[Rule], id_col: str = "id") -> DataFrame:
    """(severity, code, card_id, field) of all row rules, in one pass."""

    def of(r: Rule) -> Column:
        def issue(f: Column) -> Column:
            return F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), f.cast("string").alias("field"))

        if r.each:
            return F.transform(F.coalesce(r.when, F.array().cast("array<string>")), issue)
        return F.when(F.coalesce(r.when, F.lit(False)), F.array(issue(F.lit(r.field)))).otherwise(F.array().cast(ISSUE))

    found = cards.select(F.col(id_col).alias("card_id"), F.explode(F.concat(*map(of, rules))).alias("i"))
    return found.select("i.severity", "i.code", "card_id", "i.field")


def which(fields: dict[str, Column]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(f)) for f, c in fields.items()]))


def is_missing(field: str) -> Column:
    lists = ("philosophical_questions", "coordinates", "tensions", "question_structures")
    if field in ("source_verified", "interpretation_verified"):
        return F.col(field).isNull()
    return missing(field, "list" if field in lists else "string", field in ("tensions",))


def specific_text(thought: Column, questions: Column, perspective: Column, generic: Column, prefixes: Sequence[str] = ()) -> Column:
    """Meaning text without generic questions and template prefixes; null parts are left out."""
    text = F.array_join(F.concat(F.array_compact(F.array(thought)), F.array_except(questions, generic), F.array_compact(F.array(perspective))), " ")
    for p in prefixes:
        text = F.replace(text, F.lit(p), F.lit(" "))
    return collapse(text)


def readiness(present: Column, usable: Column, specific: Column) -> Column:
    """O1: EDITORIAL or EMPTY without usable input, GENERIC without a specific word, THIN below five, else READY."""
    n = specific_words(specific)
    return F.when(~usable, F.when(present, "EDITORIAL").otherwise("EMPTY")).when(n == 0, "GENERIC").when(n < THIN, "THIN").otherwise("READY")


def specific_words(specific: Column) -> Column:
    """Distinct lower-case words of more than three letters."""
    return F.size(F.array_distinct(F.filter(word_tokens(F.lower(specific)), lambda w: F.length(w) > 3)))


def card_rules(operations: Sequence[str], structures: Sequence[str] = (), editorial: Sequence[str] = (), prefixes: dict[str, str] | None = None) -> list[Rule]:
    """Rules of one card, against the vocabularies given. `state` is the readiness column O1."""
    eligible = F.col("technical.retrieval_eligible")
    recovered = F.col("technical.recovery_status").isNotNull()
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    blocking = which({f: is_missing(f) for f in ("philosophical_operation", "question_structures")})
    gaps = which({f: is_missing(f) for fields in schemas.CONTENT_FIELDS.values() for f in fields})
    base = F.transform(some("tensions"), lambda t: strip_qualifier(t, schemas.TENSION_QUALIFIER))
    malformed = F.exists(some("question_structures"), lambda s: (s != schemas.OPEN_STRUCTURE) & ~s.rlike("^[^↔]+↔[^↔]+$"))
    texts = ("fragment", "thought", "context", "commentary", "perspective", "translation", "source")
    none = F.array().cast("array<string>")
    own = F.col("id")
    is_editorial = {f: contains_any(f, editorial) for f in ("thought", "perspective")}
    structure_ready = F.col("philosophical_operation").isin(*operations) & (F.size(some("question_structures")) > 0) & (F.size(some("coordinates")) > 0)
    return [
        Rule("MISSING_SOURCE_IDENTITY", "error", which({f: is_missing(f) for f in ("tradition", "work", "location")}), each=True),
        Rule("RETRIEVAL_METADATA_MISSING", "error", F.when(eligible, blocking).otherwise(none), each=True),
        Rule("EXCLUDED_UNRESOLVED_NO_OPERATION", "info", F.when(eligible, none).otherwise(blocking), each=True),
        Rule("CONTENT_GAP", "warning", F.when(recovered, none).otherwise(gaps), each=True),
        Rule("RECOVERY_GAP", "warning", F.when(recovered, gaps).otherwise(none), each=True),
        Rule("FRAGMENT_TEXT_ABSENT", "warning", F.col("fragment").isNull(), "fragment"),
        Rule("MEANING_NOT_READY", "error", eligible & ~F.col("state").isin("READY", "THIN")),
        Rule("MEANING_THIN", "warning", eligible & (F.col("state") == "THIN")),
        Rule("STRUCTURE_NOT_READY", "error", eligible & ~F.coalesce(structure_ready, F.lit(False))),
        Rule("EDITORIAL_TEXT_IN_MEANING", "error", F.when(eligible, which(is_editorial)).otherwise(none), each=True),
        Rule("EDITORIAL_TEXT_IN_MEANING", "error", eligible & F.exists(some("philosophical_questions"), lambda q: contains_any(q, editorial)), "philosophical_questions"),
        Rule("TEMPLATED_INTERPRETATION", "warning", F.size(which({f: F.startswith(F.col(f), F.lit(p)) for f, p in (prefixes or {}).items()})) > 0 if prefixes else F.lit(False)),
        Rule("PLACEHOLDER_TEXT", "error", which({f: contains_any(f, schemas.PLACEHOLDERS) for f in texts}), each=True),
        Rule("INVALID_TAXONOMY_VALUE", "error", F.size(F.array_except(some("coordinates"), F.array(*map(F.lit, schemas.COORDINATES)))) > 0, "coordinates"),
        Rule("INVALID_TAXONOMY_VALUE", "error", F.size(F.array_except(base, F.array(*map(F.lit, schemas.TENSIONS)))) > 0, "tensions"),
        Rule("DUPLICATE_VALUE", "warning", F.size(some("coordinates")) > F.size(F.array_distinct(some("coordinates"))), "coordinates"),
        Rule("INVALID_OPERATION", "error", ~F.col("philosophical_operation").isin(*operations), "philosophical_operation"),
        Rule("MALFORMED_QUESTION_STRUCTURES", "error", malformed, "question_structures"),
        Rule("MALFORMED_QUESTION_STRUCTURES", "error", F.size(some("question_structures")) > F.size(F.array_distinct(some("question_structures"))), "question_structures"),
        Rule("UNKNOWN_QUESTION_STRUCTURE", "warning", F.exists(some("question_structures"), lambda s: s.rlike("^[^↔]+↔[^↔]+$") & ~s.isin(*structures)) if structures else F.lit(False), "question_structures"),
        Rule("OPEN_MARKER_MIXED", "warning", F.array_contains(some("question_structures"), schemas.OPEN_STRUCTURE) & (F.size(some("question_structures")) > 1), "question_structures"),
        Rule("RELATIONS_UNAVAILABLE", "info", F.col("relations").isNull(), "relations"),
        Rule("SELF_RELATION", "error", which({f"relations.{r}": F.array_contains(F.col(f"relations.{r}"), own) for r in schemas.RELATIONS}), each=True),
        Rule("CARD_VERIFICATION_FLAG_FALSE", "warning", eligible & (F.col("source_verified").eqNullSafe(False) | F.col("interpretation_verified").eqNullSafe(False)), "source_verified"),
        Rule("COPYRIGHT_PENDING", "info", F.col("copyright_status").startswith("check"), "copyright_status"),
        Rule("THOUGHT_PLACEHOLDER_PRESERVED", "info", F.col("technical.thought_placeholder") != "", "thought"),
        Rule("TRANSLATION_PLACEHOLDER_PRESERVED", "info", F.col("technical.translation_placeholder") != "", "translation"),
    ]


def status_issues(cards: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(severity, code, card_id, field) of (id, status, eligible) against the list of unresolved ids.

    Also ids of the list that have no card. Null statuses are neither verified nor unresolved; null flags are false."""
    listed = unresolved.select(F.col("id").alias("listed")).where("listed IS NOT NULL").distinct()
    both = cards.select("id", "status", F.coalesce("eligible", F.lit(False)).alias("eligible")).join(listed, F.col("id") == F.col("listed"), "left")
    must = F.when(F.col("listed").isNotNull(), F.lit("unresolved")).otherwise(F.lit("verified"))
    found = row_issues(both, [
        Rule("OPERATIONAL_STATUS_MISMATCH", "error", ~F.col("status").eqNullSafe(must), "technical.operational_status"),
        Rule("RETRIEVAL_ELIGIBILITY_MISMATCH", "error", F.col("eligible") != F.col("status").eqNullSafe("verified"), "technical.retrieval_eligible"),
        Rule("UNRESOLVED_IN_ALLOWLIST", "error", F.col("eligible") & F.col("listed").isNotNull(), "technical.retrieval_eligible"),
    ])
    lost = listed.join(cards.select("id"), F.col("listed") == F.col("id"), "left_anti")
    return found.unionByName(lost.select(F.lit("error").alias("severity"), F.lit("UNRESOLVED_ID_MISSING").alias("code"), F.col("listed").alias("card_id"), F.lit("id").alias("field")))


def tension_issues(tensions: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(severity, code, card_id, field) of (id, text, match, taxonomy_tension).

    A text has to be two poles around an arrow; how it matches the vocabulary, and what, has to be as marked."""
    poles = F.transform(F.split("text", "↔", 2), lambda p: F.trim(p))
    turned = F.concat(F.get(poles, F.lit(1)), F.lit(" ↔ "), F.get(poles, F.lit(0)))
    kind = F.when(F.col("text").isin(*vocabulary), "exact").when(turned.isin(*vocabulary), "reversed_poles").otherwise("case_specific")
    name = F.when(kind == "exact", F.col("text")).when(kind == "reversed_poles", turned)
    formed = F.coalesce(F.col("text").rlike("^[^↔]+↔[^↔]+$"), F.lit(False))
    return row_issues(tensions, [
        Rule("TENSION_FORMAT", "error", ~formed, "text"),
        Rule("TENSION_MATCH_INCONSISTENT", "error", formed & ~(F.col("match").eqNullSafe(kind) & F.col("taxonomy_tension").eqNullSafe(name)), "match"),
    ])


def confirmation_rules() -> list[Rule]:
    """A confirmation (action, proposed_question, confirmed_question, edited_text) agrees with itself."""
    said = F.coalesce("edited_text", F.lit("")) != ""
    return [
        Rule("CONFIRMED_DIFFERS", "error", (F.col("action") == "confirmed") & ~F.col("confirmed_question").eqNullSafe(F.col("proposed_question")), "confirmed_question"),
        Rule("OWN_TEXT_NOT_USED", "error", F.col("action").isin("edited", "replaced") & ~(said & F.col("confirmed_question").eqNullSafe(F.col("edited_text"))), "edited_text"),
        Rule("REJECTED_BUT_CONFIRMED", "error", (F.col("action") == "rejected") & F.col("confirmed_question").isNotNull(), "confirmed_question"),
    ]


def provenance_rules() -> list[Rule]:
    """Queries that a benchmark adapter made name it as their source, and their item."""
    adapted = F.col("origin") == "benchmark_adapter"
    named = lambda c: F.coalesce(F.startswith(F.col(c), F.lit("benchmark_")), F.lit(False))
    return [
        Rule("BENCHMARK_SOURCE_UNMARKED", "error", F.when(adapted, which({c: ~named(c) for c in ("confirmed_question_source", "interpretation_source")})).otherwise(F.array().cast("array<string>")), each=True),
        Rule("BENCHMARK_ITEM_MISSING", "error", adapted & (F.coalesce("benchmark_item_id", F.lit("")) == ""), "benchmark_item_id"),
    ]


def property_checks(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """(id, check, ok): every check of every row; a check that gives null has failed."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for name, c in checks.items()]))
    return df.select(id_col, rows.alias("c")).select(id_col, "c.check", "c.ok")


def json_issues(lines: DataFrame, schema: str, fields: Sequence[str], forbidden: Sequence[str] = schemas.FORBIDDEN_FIELDS) -> DataFrame:
    """V1–V4: issues of raw JSON lines (line, raw): parse errors, wrong types, unknown and forbidden names."""
    parsed = lines.withColumn("keys", F.json_object_keys("raw"))
    parsed = parsed.withColumn("record", F.from_json("raw", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    known = F.array(*map(F.lit, fields))
    cols = {
        "JSON_PARSE": F.col("keys").isNull(),
        "SCHEMA_TYPE": F.col("keys").isNotNull() & F.col("record._bad").isNotNull(),
        "FORBIDDEN_RUNTIME_FIELD": F.size(F.array_intersect("keys", F.array(*map(F.lit, forbidden)))) > 0,
        "UNKNOWN_FIELD": F.size(F.array_except(F.array_except("keys", known), F.array(*map(F.lit, forbidden)))) > 0,
    }
    return parsed.select("line", F.explode(which(cols)).alias("code"))


def duplicate_ids(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """A2, V7: (id, n, lines): ids that occur more than once with all their lines, as one array an id.

    For a report of ids with few lines; `duplicate_rows` has the same as rows, however many an id has."""
    return duplicate_rows(df, id_col, line_col).groupBy(id_col, "n").agg(F.array_sort(F.collect_set(line_col)).alias("lines"))


def duplicate_rows(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """A2, V7: (id, n, line): a row for each line of an id that occurs more than once, with its number of lines."""
    many = df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
    return df.select(id_col, line_col).join(many, id_col).select(id_col, "n", line_col)


def set_difference(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    """(id, code) of ids that lack or shouldn't be there."""
    lack = expected.select(id_col).distinct().join(actual.select(id_col), id_col, "left_anti").withColumn("code", F.lit("MISSING_EXPECTED_ID"))
    extra = actual.select(id_col).distinct().join(expected.select(id_col), id_col, "left_anti").withColumn("code", F.lit("UNEXPECTED_ID"))
    return lack.unionByName(extra)


def count_issue(df: DataFrame, expected: int) -> DataFrame:
    """(code, expected, actual) if the number of rows differs."""
    return df.agg(F.count("*").alias("actual")).select(F.lit("COUNT_MISMATCH").alias("code"), F.lit(expected).cast("long").alias("expected"), "actual").where("actual <> expected")


def broken_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, code) of edges to themselves or to nodes that don't exist."""
    own = edges.where("src = dst").select("src", "dst", F.lit("SELF_RELATION").alias("code"))
    lost = edges.where("src <> dst").join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")
    return own.unionByName(lost.select("src", "dst", F.lit("BROKEN_RELATION").alias("code")))


def issue_summary(issues: DataFrame) -> DataFrame:
    """A1: (severity, code, n)."""
    return issues.groupBy("severity", "code").agg(F.count("*").alias("n"))


def field_coverage(df: DataFrame, conditions: dict[str, Column], population: Column) -> DataFrame:
    """A3: (population, field, present, missing) for each population and for all rows, in one aggregation."""
    flags = df.select(population.alias("population"), *[F.coalesce(c, F.lit(False)).alias(f) for f, c in conditions.items()])
    both = flags.rollup("population").agg(F.count("*").alias("n"), F.grouping("population").alias("g"), *[F.sum(F.col(f).cast("long")).alias(f) for f in conditions])
    named = both.withColumn("population", F.when(F.col("g") == 1, "all").otherwise(F.col("population")))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in conditions]))
    return named.select("population", "n", rows.alias("r")).select("population", "r.field", (F.col("n") - F.col("r.missing")).alias("present"), "r.missing")


def summary(df: DataFrame, rules: Sequence[Rule], conditions: dict[str, Column], population: Column, state: Column) -> DataFrame:
    """A4, A5: (kind, population, name, value, n) in one pass: issues by code and severity, fields present and missing, readiness
    states, for each population and for all rows. What doesn't occur has no row.

    Each row gives one fact for each thing counted; grouping sets make both levels from the same facts."""
    fact = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))

    def issues(r: Rule) -> Column:
        one = fact("issue", F.lit(r.code), F.lit(r.severity))
        if r.each:
            return F.transform(F.coalesce(r.when, F.array().cast("array<string>")), lambda _: one)
        return F.when(F.coalesce(r.when, F.lit(False)), F.array(one)).otherwise(F.array().cast("array<struct<kind:string,name:string,value:string>>"))

    fields = [fact("field", F.lit(f), F.when(F.coalesce(c, F.lit(False)), "missing").otherwise("present")) for f, c in conditions.items()]
    facts = F.concat(F.array(*fields, fact("state", state, F.lit(""))), *map(issues, rules))
    each = df.select(population.alias("population"), F.explode(facts).alias("f")).select("population", "f.kind", "f.name", "f.value")
    keys = [F.col(c) for c in ("kind", "population", "name", "value")]
    both = each.groupingSets([keys, [k for k in keys if k is not keys[1]]], *keys).agg(F.count("*").alias("n"), F.grouping("population").alias("g"))
    return both.select("kind", F.when(F.col("g") == 1, "all").otherwise(F.col("population")).alias("population"), "name", "value", "n")


def final_corpus_issues(rows: DataFrame, header: Sequence[str], excluded: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """(line, card_id, problem): every violation of the flat card contract; a wrong header is the only issue.

    `rows` has the columns of FINAL_CARD and `line`."""
    if tuple(header) != schemas.FINAL_CARD:
        return rows.sparkSession.range(1).select(F.lit(1).cast("long").alias("line"), F.lit(None).cast("string").alias("card_id"), F.lit("header").alias("problem"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    there = ~blank(F.col("card_id"))
    row = which({
        "blank card_id": ~there, "malformed card_id": there & ~F.col("card_id").rlike(r"^C\d{4}$"),
        "blank philosophical_move": there & blank(F.col("philosophical_move")), "blank quote": there & blank(F.col("quote")),
        "forbidden verification_status": there & F.col("verification_status").isin(*forbidden),
    })
    own = rows.select(F.col("line").cast("long").alias("line"), "card_id", F.explode(row).alias("problem"))
    first = rows.where(there).groupBy("card_id").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(first, "card_id").where("line > first").select(F.col("line").cast("long").alias("line"), "card_id", F.lit("duplicate card_id").alias("problem"))
    active = rows.join(excluded.select("card_id").distinct(), "card_id", "left_semi").select(F.col("line").cast("long").alias("line"), "card_id", F.lit("excluded").alias("problem"))
    return own.unionByName(again).unionByName(active)


def require_clean(issues: DataFrame, shown: int = 50) -> None:
    """Raises one error that lists the violations, if there are any."""
    found = issues.limit(shown + 1).collect()  # a bounded excerpt for the message
    if found:
        raise ValueError(f"{len(found) if len(found) <= shown else f'over {shown}'} contract violation(s): " + "; ".join(map(str, found[:shown])))
