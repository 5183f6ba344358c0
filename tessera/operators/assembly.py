"""Assembly of cards from several sources: layered precedence, overlays, conflicts, exclusions, incremental sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import contains_any, move_norm


def universe(cards: DataFrame) -> DataFrame:
    """cards that may be retrieved."""
    return cards.where(F.col("eligible") & F.col("status").isin(*schemas.RETRIEVABLE))


def without(cards: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """cards that no exclusion list names."""
    return cards.join(excluded.select(key).distinct(), key, "left_anti")


def leaks(cards: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Excluded cards that are there all the same; must be empty."""
    return cards.join(excluded.select(key).distinct(), key, "left_semi")


def exclude_author(cards: DataFrame, author: str, col: str = "author") -> DataFrame:
    """cards of other authors; a missing author is nobody's. An author of no card raises."""
    same = F.lower(F.trim(F.coalesce(F.col(col), F.lit("")))) == author.strip().lower()
    if cards.where(same).limit(1).count() == 0:
        raise KeyError(f"no card of {author}")
    return cards.where(~same)


def assemble(launch: DataFrame, layers: Sequence[tuple[DataFrame, Sequence[str], str | None]], key: str) -> DataFrame:
    """The launch list with layers joined on; a layer's fields come from the first layer that has the card.

    A layer is (frame, fields, group): layers of one group bar each other, the first with a row for the card
    giving all of the group's fields, nulls too; layers without a group only fill fields that are null."""
    out, seen = launch, {}
    for n, (frame, fields, group) in enumerate(layers):
        layer = frame.select(key, F.lit(True).alias(f"_l{n}"), *[F.col(f).alias(f"_{n}_{f}") for f in fields])
        out = out.join(layer, key, "left")
        here, earlier = F.col(f"_l{n}").isNotNull(), seen.get(group) if group else None
        for f in fields:
            had = F.col(f) if f in out.columns else F.lit(None)
            mine = F.col(f"_{n}_{f}")
            if group and earlier is None:
                value = F.when(here, mine).otherwise(had)
            elif group:
                value = F.when(here & ~earlier, mine).otherwise(had)
            else:
                value = F.coalesce(had, mine)
            out = out.withColumn(f, value)
        if group:
            out = out.withColumn(f"_g_{group}", here if earlier is None else here | F.col(f"_g_{group}"))
            seen[group] = F.col(f"_g_{group}")
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def conflicts(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, a, b) where two sources say different things; null against a value is different too."""
    both = a.alias("a").join(b.alias("b"), key)
    rows = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("a"), F.col(f"b.{f}").cast("string").alias("b"))) for f in fields]
    return both.select(key, F.explode(F.array_compact(F.array(*rows))).alias("c")).select(key, "c.field", "c.a", "c.b")


def orphans(sources: dict[str, DataFrame], launch: DataFrame, key: str) -> DataFrame:
    """(source, key) of rows that the launch list doesn't have."""
    out = None
    for name, frame in sources.items():
        part = frame.select(key).distinct().join(launch.select(key), key, "left_anti").select(F.lit(name).alias("source"), key)
        out = part if out is None else out.unionByName(part)
    return out


def merge_preferring(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the first's row whole."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*second.columns), allowMissingColumns=True)


def overlay(cards: DataFrame, layer: DataFrame, key: str, field: str, version: str) -> DataFrame:
    """The overlay's text where it has the card; `layer_version` says which rows changed."""
    o = layer.select(key, F.col(field).alias("_o"))
    return cards.join(o, key, "left").withColumns({field: F.coalesce("_o", field), "layer_version": F.when(F.col("_o").isNotNull(), F.lit(version))}).drop("_o")


def curate(cards: DataFrame, updates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per-field updates (key, field, value, file), later files first heard last, with what they replaced.

    The last update of a field wins; `curation` maps each updated field to its file."""
    last = updates.groupBy(key, "field").agg(F.max(F.struct("file", "value")).alias("u"))
    wide = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "u.value"))).alias("_new"), F.map_from_entries(F.collect_list(F.struct("field", "u.file"))).alias("curation"))
    out = cards.join(wide, key, "left")
    replaced = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields]))
    out = out.withColumn("replaced", F.when(F.col("_new").isNotNull(), F.map_filter(replaced, lambda k, v: F.map_contains_key("_new", k))))
    return out.withColumns({f: F.when(F.map_contains_key("_new", f), F.element_at("_new", f)).otherwise(F.col(f)) for f in fields}).drop("_new")


def unknown_targets(updates: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Updates of cards that don't exist; must be empty."""
    return updates.join(cards.select(key), key, "left_anti")


def reliable_legacy(final: DataFrame, legacy: DataFrame, key: str, editorial: Sequence[str]) -> DataFrame:
    """legacy texts of the same card, eligible, no placeholder, and with the same move when normalised."""
    ok = legacy.where(F.col("eligible") & F.col("perspective").isNotNull() & ~contains_any("perspective", editorial))
    a, b = final.withColumn("_m", move_norm("move")), ok.withColumn("_m", move_norm("move"))
    return a.alias("f").join(b.select(key, "_m", "perspective").alias("l"), [key, "_m"]).select(key, "l.perspective")


def single_match(titles: DataFrame, sections: DataFrame) -> DataFrame:
    """(title, location): sections with the title, else those that begin with it, where they agree on one place."""
    exact = titles.join(sections, F.col("title") == F.col("section")).select("title", "location")
    rest = titles.join(exact.select("title").distinct(), "title", "left_anti")
    begins = rest.join(sections, F.startswith("section", "title")).select("title", "location")
    both = exact.union(begins).groupBy("title").agg(F.min("location").alias("location"), F.max("location").alias("_high"))
    return both.where("location = _high").drop("_high")


def missing_embeddings(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Representations (key, version, sha256, ...) that the store has no vector of."""
    return wanted.join(stored.select("key", "version", "sha256"), ["key", "version", "sha256"], "left_anti")


def refreshed(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new vectors; entries of the same key and version, now stale, go."""
    return stored.join(new.select("key", "version").distinct(), ["key", "version"], "left_anti").unionByName(new)


def status_of(quality: Column, toxic: Column) -> Column:
    """Eligibility and status from labels: verified, rejected or, without a label, unresolved."""
    return F.when(quality.isNull(), "unresolved").when((quality == 1) & (toxic == 0), "verified").otherwise("rejected")
