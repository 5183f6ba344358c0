"""Nested JSON records as rows of paths: canonical digests, two-sided differences, checks against a declared shape.

Paths are made by variants, one level at a time, inside one stage: `$.cases[3].title`. In names, the signs `%`, `.`
and `[` are written as %25, %2E and %5B.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of nesting that become paths; what lies deeper is the value of its path.
DEPTH = 10


def paths(records: DataFrame, id_col: str, raw: str, depth: int = DEPTH) -> DataFrame:
    """(id, path, kind, value) of each leaf of JSON records, empty lists and maps included; kind is text, number, boolean,
    null, list, map, or bad for what isn't JSON (null included)."""
    tvf = records.sparkSession.tvf
    d = records.select(id_col, F.lit("$").alias("path"), F.try_parse_json(raw).alias("v"))
    for _ in range(depth):
        d = d.lateralJoin(tvf.variant_explode_outer(F.col("v").outer()))
        name = F.replace(F.replace(F.replace(F.col("key"), F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E")), F.lit("["), F.lit("%5B"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        leaf = F.col("pos").isNull()
        d = d.select(id_col, F.when(leaf, F.col("path")).otherwise(F.concat("path", step)).alias("path"), F.when(leaf, F.col("v")).otherwise(F.col("value")).alias("v"))
    of = F.schema_of_variant("v")
    kind = (
        F.when(F.col("v").isNull(), "bad").when(of == "STRING", "text").when(of == "BOOLEAN", "boolean").when(of == "VOID", "null")
        .when(F.startswith(of, F.lit("OBJECT")), "map").when(F.startswith(of, F.lit("ARRAY")), "list").otherwise("number")
    )
    return d.select(id_col, "path", kind.alias("kind"), F.to_json("v").alias("value"))


def fingerprints(leaves: DataFrame, id_col: str) -> DataFrame:
    """(id, n_paths, sha256): one digest for records that differ in the order of names, white space or number style alone."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "value"))), "\n")
    return leaves.groupBy(id_col).agg(F.count("*").alias("n_paths"), F.sha2(lines, 256).alias("sha256"))


def drift(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    """(id, path, problem, expected, actual): paths that lack, are added or have another value; of ids on both sides."""
    known = expected.select(id_col).distinct().join(actual.select(id_col).distinct(), id_col)
    a, b = (x.join(known, id_col, "left_semi").select(id_col, "path", F.col("value").alias(n)) for x, n in ((expected, "expected"), (actual, "actual")))
    both = a.join(b, [id_col, "path"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "added").otherwise("changed")
    return both.select(id_col, "path", problem.alias("problem"), "expected", "actual")


@dataclass(frozen=True)
class Shape:
    """What a place of a record has to be: `text` matching a pattern, `number`, `boolean`, a `map` of fields or a `list` of items.

    `choices` are the JSON texts of the only values; optional places may be null or left out."""

    kind: str
    pattern: str | None = None
    choices: tuple[str, ...] = ()
    optional: bool = False
    fields: dict[str, Shape] | None = None
    item: Shape | None = None
    least: int = 0
    most: int | None = None

    def places(self, at: str = "$") -> Iterator[tuple[str, Shape]]:
        yield at, self
        for name, s in (self.fields or {}).items():
            yield from s.places(f"{at}.{name}")
        if self.item is not None:
            yield from self.item.places(f"{at}[]")


def digests(leaves: DataFrame, id_col: str) -> DataFrame:
    """(id, n_paths, d0, d1): 128 bits of each record's paths and values; what is shuffled is a row for each record and task."""
    sides = [F.bit_xor(F.xxhash64(F.lit(k), "path", "value")).alias(f"d{k}") for k in range(2)]
    return leaves.groupBy(id_col).agg(F.count("*").alias("n_paths"), *sides)


#: Required names of a map for which one number tells which are there.
NAMES = 62


def shape_issues(leaves: DataFrame, id_col: str, shape: Shape) -> DataFrame:
    """(id, code, path): FORBIDDEN_FIELD for undeclared names, the outermost of nested ones; SCHEMA for everything else that
    isn't as declared: kinds, patterns, values, numbers of items, what is missing.

    Each leaf is a row of every place above it, which tells what place comes next; one aggregate of these rows, whose values
    were judged before and are hashes, says of each place what it has below it."""
    spec = [
        (p, s.kind, s.pattern, list(s.choices), s.optional, s.fields is not None, [n for n, f in (s.fields or {}).items() if not f.optional], s.least if s.kind == "list" else 0, s.most)
        for p, s in shape.places()
    ]
    words = 1 + max(len(needs) for *_, needs, _, _ in spec) // NAMES
    known = leaves.sparkSession.createDataFrame(spec, "pattern string, must string, regex string, choices array<string>, optional boolean, closed boolean, needs array<string>, least long, most long")
    flat = lambda p: F.regexp_replace(p, r"\[\d+\]", "[]").alias("pattern")
    text = F.try_parse_json("value").cast("string")
    odd = ((F.size("choices") > 0) & ~F.array_contains("choices", F.col("value"))) | (F.col("regex").isNotNull() & ~F.coalesce(F.regexp_like(text, F.col("regex")), F.lit(False)))
    judged = leaves.select("*", flat("path")).join(F.broadcast(known), "pattern", "left").select(id_col, "path", "kind", odd.alias("odd"), F.xxhash64("value").alias("h"))
    parts = F.split("path", r"(?=[.\[])")
    above = judged.select(id_col, "kind", "odd", "h", parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    at_end, below = F.col("k") == F.size("parts"), F.get("parts", F.col("k"))
    item = F.startswith(below, F.lit("["))
    above = above.select(
        id_col, F.array_join(F.slice("parts", F.lit(1), F.col("k")), "").alias("path"), F.when(at_end, F.col("kind")).when(item, "list").otherwise("map").alias("kind"),
        F.when(at_end, F.col("odd")).alias("odd"), F.when(at_end, F.col("h")).alias("h"), F.when(~item, F.substring(below, 2, 1 << 30)).alias("name"), F.when(item, F.regexp_extract(below, r"\d+", 0).cast("long")).alias("pos"),
    ).select("*", flat("path")).join(F.broadcast(known.select("pattern", "needs")), "pattern", "left")  # as many rows as the shape has places
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % NAMES).cast("int"))
    place = F.array_position("needs", F.col("name")) - 1
    has = [F.bit_or(F.when(F.floor(place / NAMES) == w, bit(place))).alias(f"has{w}") for w in range(words)]
    nodes = above.groupBy(id_col, "pattern", "path", "kind", "odd", "h").agg(*has, (F.max("pos") + 1).alias("n"))
    parent = F.regexp_replace("pattern", r"(\.[^.\[]*|\[\])$", "")
    closed = known.where("closed").select(F.col("pattern").alias("parent"), "closed")
    placed = nodes.withColumn("parent", parent).join(F.broadcast(known.drop("closed")), "pattern", "left").join(F.broadcast(closed), "parent", "left")
    off = (F.col("kind") != F.col("must")) | F.coalesce("odd", (F.size("choices") > 0) | F.col("regex").isNotNull())
    bad = F.col("must").isNotNull() & F.coalesce(off, F.lit(True)) & ~(F.col("optional") & (F.col("kind") == "null"))
    sized = (F.col("must") == "list") & (F.col("kind") == "list") & ((F.coalesce("n", F.lit(0)) < F.col("least")) | (F.coalesce("n", F.lit(0)) > F.col("most")))
    there = lambda i: F.coalesce(F.get(F.array(*[f"has{w}" for w in range(words)]), F.floor(i / NAMES).cast("int")).bitwiseAND(bit(i)), F.lit(0)) != 0
    lacking = F.when(F.col("kind") == "map", F.transform(F.filter("needs", lambda _, i: ~there(i)), lambda name: F.struct(F.lit("SCHEMA").alias("code"), F.concat("path", F.lit("."), name).alias("path"))))
    one = lambda code, when: F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(F.lit(code).alias("code"), F.col("path").alias("path"))))
    none = F.array().cast("array<struct<code:string,path:string>>")
    found = [one("FORBIDDEN_FIELD", F.col("must").isNull() & F.col("closed")), one("SCHEMA", bad), lacking, one("SCHEMA", sized)]
    return placed.select(id_col, F.explode(F.concat(*[F.coalesce(x, none) for x in found])).alias("i")).select(id_col, "i.code", "i.path")
