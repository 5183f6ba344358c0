"""Retrieval benchmarks as JSON records: compiled from labelled sections, validated by a catalogue of 23 codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import let, sentences
from tessera.operators import records
from tessera.operators.records import Shape
from tessera.sources.sinks import stored

# Ids, dimensions, failure categories and marks that a benchmark of this version has or must not have.
CASES = tuple(f"B{k:02d}" for k in range(1, 21))
PAIRS = ("CP1", "CP2", "CP3", "CP4")
DIMENSIONS = ("relevance", "transformative_value", "distinctness", "grounding", "corpus_fit")
FAILURES = ("INTERPRETATION", "QUERY", "RECALL", "CORPUS", "RANKING", "COMPOSITION", "UNRESOLVED")
TRADITIONS = (
    "стоиц", "буддиз", "буддий", "даос", "конфуци", "христиан", "ислам", "иудаи", "иудей", "индуи", "веданта",
    "эпикур", "библейск", "платон", "сократ", "эпиктет", "будда", "коран",
)
REQUIREMENT = "не должн|не должен|должен заметно"
EXPECTED = r"(?s)^(?:смысловой узел — )?(.*?); coordinates — (.*?); tensions — (.*?); (?:важное )?различение — (.*?)\.?$"
MATCHES = ('"exact"', '"reversed_poles"', '"case_specific"')
SCORES = ("0", "1", "2")

_T = Shape("text", "(?s)^.")
_O = Shape("text", "(?s)^.", optional=True)
_N = Shape("number", r"^-?\d+$")
_TENSION = Shape("map", fields={"text": _T, "match": Shape("text", choices=MATCHES), "taxonomy_tension": _O})
_VARIANT = Shape("map", fields={
    "id": Shape("text", r"^CP\d-[AB]$"), "case_ref": Shape("text", r"^B\d{2}$", optional=True), "note": _O, "narrative": _O, "expected": _O,
    "probable_coordinates": Shape("list", item=_T, optional=True), "probable_tensions": Shape("list", item=_TENSION, optional=True),
})
#: The names and kinds of a benchmark's parts.
SHAPE = Shape("map", fields={
    "schema_version": Shape("text", choices=('"benchmark-schema/0.1.0"',), optional=True), "benchmark_id": _T, "version": _T, "spec_document": _T, "spec_sha256": Shape("text", "^[0-9a-f]{64}$"),
    "corpus_context": Shape("map", fields={"total": _N, "retrieval_eligible": _N, "unresolved": _N, "source_route": _T}),
    "required_routes": Shape("list", item=Shape("text", choices=('"MEANING"', '"STRUCTURE"'))), "source_route_required": Shape("boolean", choices=("false",), optional=True),
    "expected_structure_policy": Shape("text", choices=('"evaluation_guidance_not_gold_label"',), optional=True),
    "cases": Shape("list", item=Shape("map", fields={
        "id": Shape("text", r"^B\d{2}$"), "title": _T, "circumstance": _T, "experiences": Shape("list", item=_T, least=1), "center": _T, "narrative": _T,
        "expected_structure": Shape("map", fields={
            "role": Shape("text", choices=('"evaluation_guidance"',), optional=True), "semantic_node": _T, "probable_coordinates": Shape("list", item=_T, least=1),
            "probable_tensions": Shape("list", item=_TENSION, least=1), "distinctions": Shape("list", item=_T, least=1),
        }),
        "failure_traps": Shape("list", item=_T, least=1),
    })),
    "contrast_principle": _T,
    "contrast_pairs": Shape("list", item=Shape("map", fields={"id": Shape("text", r"^CP\d$"), "title": _T, "variant_a": _VARIANT, "variant_b": _VARIANT, "expected_semantic_shift": _O, "contrast_requirement": _T})),
    "evaluation": Shape("map", fields={
        "scale": Shape("list", item=Shape("number", choices=SCORES)),
        "card_level_dimensions": Shape("list", item=Shape("map", fields={
            "id": Shape("text", choices=tuple(f'"{d}"' for d in DIMENSIONS)), "label": _T,
            "levels": Shape("list", item=Shape("map", fields={"score": Shape("number", choices=SCORES), "description": _T}), least=3, most=3),
        })),
        "aggregate_score": Shape("boolean", choices=("false",), optional=True), "aggregate_policy": _T,
        "set_level": Shape("map", fields={"set_size": Shape("map", fields={"min": _N, "max": _N}), "main_question": _T, "checks": Shape("list", item=_T, least=1)}),
    }),
    "failure_taxonomy": Shape("list", item=Shape("map", fields={"id": Shape("text", choices=tuple(f'"{f}"' for f in FAILURES)), "description": _T})),
    "rules": Shape("list", item=_T), "trace_fields": Shape("list", item=_T),
})


def ddl(s: Shape) -> str:
    """The Spark type of a shape."""
    if s.kind == "map":
        return "struct<" + ", ".join(f"`{n}`: {ddl(f)}" for n, f in s.fields.items()) + ">"
    return f"array<{ddl(s.item)}>" if s.kind == "list" else {"text": "string", "number": "long", "boolean": "boolean"}[s.kind]


# ---------------------------------------------------------------- compiling


def _list(x: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(x, sep), lambda i: F.trim(i)), lambda i: i != "")


def _turned(text: Column) -> Column:
    poles = F.transform(F.split(text, "↔", 2), lambda p: F.trim(p))
    return F.when(F.size(poles) == 2, F.concat(F.get(poles, F.lit(1)), F.lit(" ↔ "), F.get(poles, F.lit(0))))


def tension_ref(text: Column, vocabulary: Sequence[str] = schemas.TENSIONS) -> Column:
    """A tension with how it stands to the vocabulary, and the vocabulary's own wording."""
    turned = F.coalesce(_turned(text).isin(*vocabulary), F.lit(False))
    match = F.when(text.isin(*vocabulary), "exact").when(turned, "reversed_poles").otherwise("case_specific")
    name = F.when(text.isin(*vocabulary), text).when(turned, _turned(text))
    return F.struct(text.alias("text"), match.alias("match"), name.alias("taxonomy_tension"))


def probable(expected: Column, coordinates: Sequence[str] = schemas.COORDINATES) -> Column:
    """P25: coordinates and tensions of a variant from prose, where its first sentence lists them plainly; else none."""
    segments = F.transform(F.split(F.regexp_replace(F.get(sentences(expected), F.lit(0)), r"\.+$", ""), ";"), lambda s: F.trim(s))
    head = F.transform(F.split(F.get(segments, F.lit(0)), ","), lambda c: F.trim(c))
    plain = F.coalesce(F.forall(head, lambda c: c.isin(*coordinates)), F.lit(False))
    named = F.filter(F.slice(segments, F.lit(2), F.size(segments)), lambda s: F.contains(s, F.lit("↔")))
    none = F.array()
    kind = f"array<{ddl(_TENSION)}>"
    return F.struct(
        F.when(plain, head).otherwise(none.cast("array<string>")).alias("coordinates"),
        F.when(plain, F.transform(named, lambda s: tension_ref(s)).cast(kind)).otherwise(none.cast(kind)).alias("tensions"),
    )


def compiled_cases(cases: DataFrame, key: str) -> DataFrame:
    """(key, cases) in the order of ids, from (key, id, title, fields): a map of the labels Circumstance, Experiences,
    Center, Narrative, Expected structure and Failure traps. A structure that can't be read fails."""
    f = lambda name: F.element_at("fields", F.lit(name))
    part = lambda k: F.regexp_extract(f("Expected structure"), EXPECTED, k)
    bad = F.raise_error(F.concat(F.lit("unrecognised expected structure: "), F.coalesce(f("Expected structure"), F.lit("")))).cast(ddl(SHAPE.fields["cases"].item))
    case = F.struct(
        F.col("id"), F.col("title"), f("Circumstance").alias("circumstance"), _list(f("Experiences"), ",").alias("experiences"), f("Center").alias("center"), f("Narrative").alias("narrative"),
        F.struct(
            F.lit("evaluation_guidance").alias("role"), F.trim(part(1)).alias("semantic_node"), _list(part(2), ",").alias("probable_coordinates"),
            F.transform(_list(part(3), ","), lambda t: tension_ref(t)).alias("probable_tensions"), F.array(F.trim(part(4))).alias("distinctions"),
        ).alias("expected_structure"),
        _list(F.regexp_replace(f("Failure traps"), r"\.+$", ""), ";").alias("failure_traps"),
    ).cast(ddl(SHAPE.fields["cases"].item))
    read = F.when(F.coalesce(f("Expected structure").rlike(EXPECTED), F.lit(False)), case).otherwise(bad)
    rows = cases.select(key, F.struct("id", read.alias("case")).alias("c"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["case"]).alias("cases"))


def compiled_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """(key, contrast_pairs) from (key, id, title, fields): labels and values in order, in which Expected belongs to the
    variant named last. Unknown labels fail."""
    named = lambda label: F.try_element_at(F.transform(F.filter("fields", lambda x: x["label"] == F.concat("id", F.lit(label))), lambda x: x["value"]), F.lit(-1))
    start = F.struct(F.lit("").alias("last"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))

    def step(acc: Column, x: Column) -> Column:
        side = F.regexp_extract(x["label"], r"^CP\d-([AB])(?: narrative)?$", 1)
        here = x["label"] == "Expected"
        return F.struct(
            F.when(side != "", side).otherwise(acc["last"]).alias("last"), F.when(here & (acc["last"] == "A"), x["value"]).otherwise(acc["a"]).alias("a"),
            F.when(here & (acc["last"] != "A"), x["value"]).otherwise(acc["b"]).alias("b"),
        )

    known = F.forall("fields", lambda x: x["label"].isin("Expected", "Expected shift", "Contrast requirement") | x["label"].rlike(r"^CP\d-[AB](?: narrative)?$"))
    shift = F.try_element_at(F.transform(F.filter("fields", lambda x: x["label"] == "Expected shift"), lambda x: x["value"]), F.lit(-1))
    asked = F.try_element_at(F.transform(F.filter("fields", lambda x: x["label"] == "Contrast requirement"), lambda x: x["value"]), F.lit(-1))
    p = pairs.select(key, "id", "title", F.aggregate("fields", start, step).alias("e"), *[named(s).alias(n) for s, n in (("-A", "ar"), ("-B", "br"), ("-A narrative", "an"), ("-B narrative", "bn"))], shift.alias("s"), asked.alias("q"), known.alias("known"))
    said = F.filter(sentences("s"), lambda x: ~x.rlike(REQUIREMENT))
    must = F.nullif(F.array_join(F.filter(sentences("s"), lambda x: x.rlike(REQUIREMENT)), " "), F.lit(""))
    p = p.withColumns({"shift": F.when(F.col("s").isNotNull(), F.array_join(said, " ")), "need": F.coalesce("q", must)})

    def variant(side: str, ref: Column, narrative: Column, expected: Column, found: Column) -> Column:
        note = F.nullif(F.trim(F.regexp_extract(ref, r"(?s)^B\d{2}\.\s*(.*)$", 1)), F.lit(""))
        return let(found, lambda x: F.struct(
            F.concat("id", F.lit(f"-{side}")).alias("id"), F.nullif(F.regexp_extract(ref, r"^(B\d{2})\.", 1), F.lit("")).alias("case_ref"), note.alias("note"), narrative.alias("narrative"),
            expected.alias("expected"), x["coordinates"].alias("probable_coordinates"), x["tensions"].alias("probable_tensions"),
        ).cast(ddl(_VARIANT)))

    fallback = F.when(F.col("e.b").isNull(), F.col("shift")).otherwise(F.col("e.b"))
    kind = ddl(SHAPE.fields["contrast_pairs"].item)
    pair = F.struct(
        "id", "title", variant("A", F.col("ar"), F.col("an"), F.col("e.a"), probable(F.col("e.a"))).alias("variant_a"), variant("B", F.col("br"), F.col("bn"), F.col("e.b"), probable(fallback)).alias("variant_b"),
        F.col("shift").alias("expected_semantic_shift"), F.col("need").alias("contrast_requirement"),
    ).cast(kind)
    read = F.when(F.coalesce("known", F.lit(False)), pair).otherwise(F.raise_error(F.concat(F.lit("unknown label in pair "), "id")).cast(kind))
    return p.select(key, F.struct("id", read.alias("pair")).alias("c")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["pair"]).alias("contrast_pairs"))


def compile_benchmarks(cases: DataFrame, pairs: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """(key, raw): one JSON record a key. `rest` has the other parts of a benchmark as columns."""
    whole = rest.join(compiled_cases(cases, key), key, "left").join(compiled_pairs(pairs, key), key, "left")
    parts = [F.coalesce(n, F.array().cast(ddl(s))).alias(n) if n in ("cases", "contrast_pairs") else F.col(n).cast(ddl(s)).alias(n) for n, s in SHAPE.fields.items()]
    return whole.select(key, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("raw"))


# ---------------------------------------------------------------- validating


def _issues(code: str, items: Column, severity: str = "error") -> Column:
    """One issue for each item of an array of texts."""
    return F.transform(items, lambda i: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), i.alias("item")))


def _issue(code: str, when: Column, item: Column | None = None, severity: str = "error") -> Column:
    item = F.lit(None).cast("string") if item is None else item
    return _issues(code, F.when(F.coalesce(when, F.lit(False)), F.array(item)).otherwise(F.array().cast("array<string>")), severity)


def _tagged(items: Column, bad, owner: Column) -> Column:
    """The owner once for each item that is bad."""
    return F.transform(F.filter(items, bad), lambda _: owner)


def _tension_faults(tensions: Column, owner: Column) -> list[Column]:
    formed = lambda t: t["text"].rlike("^[^↔]+ ↔ [^↔]+$")
    right = lambda t: let(tension_ref(t["text"]), lambda r: t["match"].eqNullSafe(r["match"]) & t["taxonomy_tension"].eqNullSafe(r["taxonomy_tension"]))
    return [_issues("TENSION_FORMAT", _tagged(tensions, lambda t: ~formed(t), owner)), _issues("TENSION_MATCH_INCONSISTENT", _tagged(tensions, lambda t: formed(t) & ~right(t), owner))]


def _over(items: Column, faults) -> Column:
    """Issues of each item of an array, in one array."""
    return F.flatten(F.transform(items, lambda x: F.concat(*faults(x))))


def benchmark_issues(benchmarks: DataFrame, key: str, unresolved: Sequence[str] = (), specs: DataFrame | None = None) -> DataFrame:
    """(key, severity, code, item): all issues of JSON benchmarks (key, raw).

    What scans the whole text is always looked for; the other rules speak only where a record has the declared shape.
    `specs` (key, sha256, raw): the digest of each benchmark's source and a fresh compilation of it, for SPEC_DRIFT."""
    raw = benchmarks.select(key, "raw")
    ids = F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\bC\d{4}\b"), F.lit(0)))
    wanted = let(F.lower("raw"), lambda lowered: F.filter(F.array(*map(F.lit, TRADITIONS)), lambda m: F.contains(lowered, m)))
    text = raw.select(key, F.explode(F.concat(
        let(ids, lambda x: F.concat(_issue("CARD_ID_PRESENT", F.size(x) > 0), _issue("UNRESOLVED_REFERENCED", F.arrays_overlap(x, F.array(*map(F.lit, unresolved)).cast("array<string>"))))),
        _issue("TRADITION_OR_AUTHOR_REQUIRED", F.size(wanted) > 0),
    )).alias("i"))
    leaves = records.paths(raw, key, "raw")
    v = F.try_parse_json("raw")
    routes = F.exists(F.try_variant_get(v, "$.required_routes", "array<variant>"), lambda x: F.to_json(x) == '"SOURCE"')
    route = F.coalesce(routes, F.lit(False)) | F.coalesce(F.to_json(F.try_variant_get(v, "$.source_route_required", "variant")) == "true", F.lit(False))
    source = raw.where(route).select(key).distinct().select(key, F.struct(F.lit("error").alias("severity"), F.lit("SOURCE_REQUIRED").alias("code"), F.lit(None).cast("string").alias("item")).alias("i"))
    typed = raw.withColumn("_bench", F.from_json("raw", ddl(SHAPE)))
    own = F.concat(
        _over(F.flatten(F.transform("_bench.cases", lambda c: c["expected_structure"]["probable_tensions"])), lambda t: [_issue("SCHEMA", (t["match"] == "case_specific") != t["taxonomy_tension"].isNull(), F.lit("taxonomy_tension"))]),
        _over(F.col("_bench.contrast_pairs"), lambda p: [
            _issue("SCHEMA", p[v]["case_ref"].isNull() == p[v]["narrative"].isNull(), p[v]["id"]) for v in ("variant_a", "variant_b")
        ] + [_issue("SCHEMA", (F.coalesce(p["expected_semantic_shift"], F.lit("")) == "") & (p["variant_a"]["expected"].isNull() | p["variant_b"]["expected"].isNull()), p["id"])]),
    )
    shaped = records.shape_issues(leaves, key, SHAPE).select(key, F.struct(F.lit("error").alias("severity"), "code", F.col("path").alias("item")).alias("i"))
    shaped = stored(shaped.union(typed.where("_bench IS NOT NULL").select(key, F.explode(own).alias("i"))))
    good = typed.join(shaped.select(key).distinct(), key, "left_anti")
    found = text.union(source).union(shaped).union(good.select(key, F.explode(_rules(F.col("_bench"))).alias("i")))
    if specs is not None:
        # rows of digests are joined, no texts
        fresh = records.digests(records.paths(specs, key, "raw"), key).toDF(key, "n", "e0", "e1").join(specs.select(key, F.col("sha256").alias("_sha")), key)
        mine = good.select(key, F.col("_bench.spec_sha256").alias("_said")).join(records.digests(leaves, key), key)
        both = mine.join(fresh, key).where("_said <> _sha OR n_paths <> n OR d0 <> e0 OR d1 <> e1")
        found = found.union(both.select(key, F.struct(F.lit("error").alias("severity"), F.lit("SPEC_DRIFT").alias("code"), F.lit(None).cast("string").alias("item")).alias("i")))
    return found.select(key, "i.severity", "i.code", "i.item")


def _rules(b: Column) -> Column:
    """The rules of a record that has the declared shape."""
    cases, pairs = b["cases"], b["contrast_pairs"]
    ids = F.transform(cases, lambda c: c["id"])
    twice = F.filter(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1)
    unstable = (ids != F.array(*map(F.lit, CASES))) & (F.size(ids) == len(CASES)) & (F.size(F.array_distinct(ids)) == len(CASES))
    odd = lambda c: ~c.isin(*schemas.COORDINATES)
    covered = F.array_distinct(F.flatten(F.transform(cases, lambda c: c["expected_structure"]["probable_coordinates"])))
    missing = F.size(F.array_except(F.array(*map(F.lit, schemas.COORDINATES)), covered)) > 0
    specific = F.size(F.filter(F.flatten(F.transform(cases, lambda c: c["expected_structure"]["probable_tensions"])), lambda t: t["match"] == "case_specific"))

    def case(c: Column) -> list[Column]:
        e = c["expected_structure"]
        return [_issues("COORDINATE_NOT_CANONICAL", _tagged(e["probable_coordinates"], odd, c["id"])), *_tension_faults(e["probable_tensions"], c["id"])]

    def pair(p: Column) -> list[Column]:
        out = []
        for side, v in (("A", p["variant_a"]), ("B", p["variant_b"])):
            none = lambda kind: F.array().cast(kind)
            out += [
                _issue("VARIANT_ID", v["id"] != F.concat(p["id"], F.lit(f"-{side}")), p["id"]), _issue("BROKEN_CASE_REFERENCE", v["case_ref"].isNotNull() & ~F.array_contains(ids, v["case_ref"]), p["id"]),
                _issues("COORDINATE_NOT_CANONICAL", _tagged(F.coalesce(v["probable_coordinates"], none("array<string>")), odd, v["id"])),
                *_tension_faults(F.coalesce(v["probable_tensions"], none(f"array<{ddl(_TENSION)}>")), v["id"]),
            ]
        return [*out, _issue("CONTRAST_NOT_CONTRASTING", p["variant_a"]["narrative"] == p["variant_b"]["narrative"], p["id"])]

    dims = b["evaluation"]["card_level_dimensions"]
    levels = F.filter(dims, lambda d: F.transform(d["levels"], lambda x: x["score"]) != F.array(*[F.lit(k).cast("long") for k in range(3)]))
    return F.concat(
        _issue("CASE_COUNT", F.size(ids) != len(CASES)), _issues("DUPLICATE_CASE_ID", twice), _issue("CASE_IDS_UNSTABLE", unstable), _over(cases, case), _issue("COORDINATE_COVERAGE", missing, None, "warning"),
        _issue("CONTRAST_PAIRS", F.transform(pairs, lambda p: p["id"]) != F.array(*map(F.lit, PAIRS))), _over(pairs, pair),
        _issue("EVALUATION_SCALE", b["evaluation"]["scale"] != F.array(*[F.lit(k).cast("long") for k in range(3)])), _issue("EVALUATION_DIMENSIONS", F.transform(dims, lambda d: d["id"]) != F.array(*map(F.lit, DIMENSIONS))),
        _issues("EVALUATION_LEVELS", F.transform(levels, lambda d: d["id"])), _issue("FAILURE_TAXONOMY", F.transform(b["failure_taxonomy"], lambda f: f["id"]) != F.array(*map(F.lit, FAILURES))),
        _issue("CASE_SPECIFIC_TENSIONS", F.lit(True), specific.cast("string"), "info"),
    )


def benchmark_summary(benchmarks: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, status, n_errors, n_cases, n_pairs, exact, reversed_poles, case_specific) of each benchmark."""
    b = F.from_json("raw", ddl(SHAPE))
    refs = F.flatten(F.transform(F.col("_bench.cases"), lambda c: c["expected_structure"]["probable_tensions"]))
    kinds = [m.strip('"') for m in MATCHES]
    shape = benchmarks.select(key, b.alias("_bench")).select(
        key, F.size("_bench.cases").cast("long").alias("n_cases"), F.size("_bench.contrast_pairs").cast("long").alias("n_pairs"),
        *[F.size(F.filter(F.transform(refs, lambda t: t["match"]), lambda m: m == kind)).cast("long").alias(kind) for kind in kinds],
    )
    errors = issues.where("severity = 'error'").groupBy(key).agg(F.count("*").alias("n_errors"))
    n = F.coalesce("n_errors", F.lit(0))
    return shape.join(errors, key, "left").select(key, F.when(n > 0, "FAIL").otherwise("PASS").alias("status"), n.alias("n_errors"), "n_cases", "n_pairs", *kinds)
