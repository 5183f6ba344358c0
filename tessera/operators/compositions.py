"""Batch checks of composed answers: card texts, selections, groundings, quotations. Contracts as rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import hits, sentence_count, sentences, token_norm, word_count
from tessera.operators.quotations import quote_sources  # noqa: F401  J13

# Limits of words and sentences of a final card.
WORD_LIMITS = {"main_idea": 45, "applied_insight": 55, "reflection_question": 22}
SENTENCE_LIMITS = {"main_idea": 3, "applied_insight": 4}
SENTENCE_WORDS = 25


def count_of(x: str, sign: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def card_problems(cards: DataFrame, keys: Sequence[str], forbidden: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, problem): every rule that a final card's texts break."""
    body = F.concat_ws(" ", "main_idea", "applied_insight", "reflection_question")
    q = "reflection_question"
    checks = {"incomplete": F.coalesce(F.trim("main_idea"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("applied_insight"), F.lit("")).eqNullSafe("")}
    checks["one_question"] = (count_of(q, "?") != 1) | ~F.rtrim(q).endswith("?") | (sentence_count(q) != 1)
    for name, patterns in forbidden.items():
        checks[name] = F.size(hits(body, patterns)) > 0
    for f, n in WORD_LIMITS.items():
        checks[f"{f}_words"] = word_count(f, display=True) > n
    for f, n in SENTENCE_LIMITS.items():
        checks[f"{f}_sentences"] = sentence_count(f) > n
        checks[f"{f}_long_sentence"] = F.exists(sentences(f), lambda s: word_count(s, display=True) > SENTENCE_WORDS)
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return cards.select(*keys, F.explode(found).alias("problem"))


def first_problem(*ordered: tuple[str, Column]) -> Column:
    """The first rule that fails; null where none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in ordered])


def selection_problems(selected: DataFrame, pool: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """(query_id, problem) of selections (query_id, card_id, distinction, perspective_effect, perspective_frame)."""
    s = selected.withColumns({"e": token_norm("perspective_effect"), "f": token_norm(F.coalesce("perspective_frame", F.lit("")))})
    per = s.groupBy("query_id").agg(
        F.count("*").alias("n"), F.countDistinct("card_id").alias("cards"), F.countDistinct("e").alias("effects"), F.countDistinct("f").alias("frames"),
        F.count_if(F.col("f") == "").alias("frameless"), F.count_if(~F.lower("distinction").rlike("различ|увидеть")).alias("vague"),
        F.count_if(F.trim(F.coalesce("perspective_effect", F.lit(""))) == "").alias("empty"),
    )
    found = F.array_compact(F.array(
        F.when(~F.col("n").between(low, high), "count"), F.when(F.col("cards") < F.col("n"), "not_distinct"), F.when(F.col("effects") < F.col("n"), "same_effect"),
        F.when((F.col("frameless") == 0) & (F.col("frames") < F.col("n")), "same_frame"), F.when(F.col("vague") > 0, "vague_distinction"), F.when(F.col("empty") > 0, "empty_effect"),
    ))
    group = per.select("query_id", F.explode(found).alias("problem"))
    outside = selected.join(pool.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti").select("query_id", F.lit("outside_pool").alias("problem")).distinct()
    return group.unionByName(outside)


def rejected(considered: DataFrame, rejected_: DataFrame, kept: DataFrame) -> DataFrame:
    """M9: (query_id, card_id, reason) of cards that weren't taken: what was considered first, then older lists."""
    keys = ["query_id", "card_id"]
    one = considered.where("decision <> 'selected'").join(kept.select(*keys), keys, "left_anti").select(*keys, F.concat_ws(": ", "decision", F.trim("reason")).alias("reason"), F.lit(0).alias("o"))
    two = rejected_.join(kept.select(*keys), keys, "left_anti").select(*keys, F.trim("reason").alias("reason"), F.lit(1).alias("o"))
    w = Window.partitionBy(*keys).orderBy("o", "reason")
    return one.unionByName(two).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "reason")


def grounding_problems(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, claim, problem): claims (kind, claim, evidence) whose evidence isn't in the texts it must come from."""
    both = claims.join(sources.select(key, token_norm("user_words").alias("_u"), token_norm("source_data").alias("_s")), key)
    e = token_norm("evidence")
    ground = F.when(F.col("kind") == "source", F.col("_s")).when(F.col("kind") == "user", F.col("_u")).otherwise(F.concat_ws(" ", "_u", "_s"))
    problem = F.when(e == "", "no_evidence").when(~F.contains(ground, e), "not_verbatim")
    return both.select(key, "claim", problem.alias("problem")).where("problem IS NOT NULL")


def real_violations(found: DataFrame, cards: DataFrame, key: str, violating: Sequence[str]) -> DataFrame:
    """a validator's violations whose sentence really stands in the card."""
    both = found.join(cards.select(key, token_norm("card_text").alias("_c")), key)
    return both.where(F.col("label").isin(*violating) & (F.trim("sentence") != "") & F.contains("_c", token_norm("sentence"))).drop("_c")


def quote_readiness(quotes: DataFrame) -> DataFrame:
    """O2: READY without reasons, PARTIAL with some, NOT_READY without a source or a span."""
    reasons = F.array_compact(F.array(
        F.when(F.col("path").isNull(), "no_source"), F.when(F.col("start").isNull() | F.col("end").isNull(), "no_span"),
        F.when(F.coalesce(F.trim("translator"), F.lit("")) == "", "no_translator"), F.when(F.coalesce(F.trim("edition"), F.lit("")) == "", "no_edition"),
    ))
    out = quotes.withColumn("reasons", reasons)
    hard = F.array_contains("reasons", "no_source") | F.array_contains("reasons", "no_span")
    return out.withColumn("readiness", F.when(F.size("reasons") == 0, "READY").when(hard, "NOT_READY").otherwise("PARTIAL"))


def verified_quotes(quotes: DataFrame, files: DataFrame) -> DataFrame:
    """(quote_id, problem): hash and exact span against (path, sha256, text); problem is null where all holds."""
    both = quotes.alias("q").join(files.select("path", F.col("sha256").alias("_sha"), F.col("text").alias("_t")), "path", "left")
    span = F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start"))
    return both.select("quote_id", first_problem(("no_file", F.col("_t").isNull()), ("sha256", F.col("_sha") != F.col("sha256")), ("span", span != F.col("quote"))).alias("problem"))
