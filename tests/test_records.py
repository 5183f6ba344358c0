import json
import random

from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import benchmarks, records
from tessera.operators.records import Shape
from tessera.sources import lines


def flat(x, at="$"):
    if isinstance(x, dict) and x:
        return [r for k, v in x.items() for r in flat(v, f"{at}." + k.replace("%", "%25").replace(".", "%2E").replace("[", "%5B"))]
    if isinstance(x, list) and x:
        return [r for i, v in enumerate(x) for r in flat(v, f"{at}[{i}]")]
    return [(at, json.dumps(x, ensure_ascii=False, separators=(",", ":")))]


def nested(r, depth=4):
    kind = r.random()
    if depth and kind < 0.35:
        return {r.choice(["a", "b", "c.d", "e[", "x%", "ключ"]): nested(r, depth - 1) for _ in range(r.randint(0, 4))}
    if depth and kind < 0.6:
        return [nested(r, depth - 1) for _ in range(r.randint(0, 3))]
    return r.choice([1, -7, "text", "", None, True, False, "ё"])


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, raw string")


def test_paths_equal_a_plain_walk(spark):
    r = random.Random(1)
    docs = [(i, nested(r, 5)) for i in range(60)]
    got = records.paths(frame(spark, [(i, json.dumps(d, ensure_ascii=False)) for i, d in docs] + [(90, "{broken"), (91, None)]), "id", "raw").collect()
    assert sorted((x.id, x.path, x.value) for x in got if x.id < 90) == sorted((i, p, v) for i, d in docs for p, v in flat(d))
    assert sorted((x.id, x.path, x.kind) for x in got if x.id >= 90) == [(90, "$", "bad"), (91, "$", "bad")]


def test_fingerprints_and_drift(spark):
    a = frame(spark, [(1, '{"x": [1, 2], "y": "t"}'), (2, '{"x": 1}'), (3, "{}")])
    b = frame(spark, [(1, '{ "y":"t","x":[1,2] }'), (2, '{"x": 2, "z": {"w": null}}'), (4, "{}")])
    pa, pb = (records.paths(x, "id", "raw") for x in (a, b))
    one, two = ({r.id: r.sha256 for r in records.fingerprints(p, "id").collect()} for p in (pa, pb))
    assert one[1] == two[1] and one[2] != two[2]
    assert sorted((r.id, r.path, r.problem, r.expected, r.actual) for r in records.drift(pa, pb, "id").collect()) == [(2, "$.x", "changed", "1", "2"), (2, "$.z.w", "added", None, "null")]


def test_shapes(spark):
    shape = Shape("map", fields={"a": Shape("text", "^x"), "b": Shape("number", optional=True), "c": Shape("list", item=Shape("map", fields={"d": Shape("text", choices=('"1"', '"2"'))}), least=1, most=2)})
    good = {"a": "xy", "c": [{"d": "1"}]}
    cases = {
        1: (good, []), 2: ({**good, "a": "y"}, [("SCHEMA", "$.a")]), 3: ({"c": [{"d": "1"}], "b": None}, [("SCHEMA", "$.a")]), 4: ({**good, "e": {"f": [1]}, "c": [{"d": "2", "g": 1}]}, [("FORBIDDEN_FIELD", "$.c[0].g"), ("FORBIDDEN_FIELD", "$.e")]),
        5: ({**good, "c": []}, [("SCHEMA", "$.c")]), 6: ({**good, "c": [{"d": "1"}] * 3}, [("SCHEMA", "$.c")]), 7: ({**good, "c": [{}, {"d": "3"}]}, [("SCHEMA", "$.c[0].d"), ("SCHEMA", "$.c[1].d")]),
        8: ({**good, "b": "1", "c": {"d": "1"}}, [("SCHEMA", "$.b"), ("SCHEMA", "$.c")]), 9: ([], [("SCHEMA", "$")]),
    }
    got = records.shape_issues(records.paths(frame(spark, [(i, json.dumps(d)) for i, (d, _) in cases.items()]), "id", "raw"), "id", shape).collect()
    assert {i: sorted((r.code, r.path) for r in got if r.id == i) for i in cases} == {i: want for i, (_, want) in cases.items()}


def test_outline(spark):
    text = ["# one", "## A", "x", "### deep", "y", "## A", "", "z", "# two", "t", "## A", "#no heading"]
    df = spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(text)], "path string, line int, raw string")
    got = lines.bodies(lines.outline(df, ["path"]), ["path"], 2).orderBy("h2.at").collect()
    assert [(r.h1.title, r.h2.title, r.h2.at, r.body) for r in got] == [("one", "A", 2, "x\n### deep\ny"), ("one", "A", 6, "\nz"), ("two", "A", 11, "#no heading")]


def test_labels_repeat_in_order(spark):
    body = "**A:** one -- two\n**Expected:** x\n\n  y **Expected:**  z\\\n**B narrative:**"
    df = spark.createDataFrame([(body,)], "body string").select(lines.labelled("body").alias("l"))
    row = df.select("l", lines.fields_of(F.col("l")).alias("m"), lines.split_field(F.col("l"), "A", "–").alias("s")).first()
    assert [tuple(x) for x in row.l] == [("A", "one – two"), ("Expected", "x y"), ("Expected", "z"), ("B narrative", "")] and row.m["Expected"] == "z" and row.s == ["one", "two"]


def test_pairs_by_label_order(spark):
    fields = [("CP1-A", "B03. as told"), ("CP1-B narrative", "n"), ("Expected", "желание, долг / ответственность; долг ↔ желание; проза."), ("Expected shift", "Moves. Набор должен заметно отличаться.")]
    df = spark.createDataFrame([("k", "CP1", "t", fields)], "key string, id string, title string, fields array<struct<label:string,value:string>>")
    p = benchmarks.compiled_pairs(df, "key").first().contrast_pairs[0]
    assert (p.variant_a.case_ref, p.variant_a.note, p.variant_a.expected, p.variant_b.narrative, p.expected_semantic_shift, p.contrast_requirement) == ("B03", "as told", None, "n", "Moves.", "Набор должен заметно отличаться.")
    assert p.variant_b.probable_coordinates == ["желание", "долг / ответственность"] and [tuple(t) for t in p.variant_b.probable_tensions] == [("долг ↔ желание", "reversed_poles", schemas.TENSIONS[0])]
