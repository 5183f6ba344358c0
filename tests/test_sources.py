import hashlib

import pytest

from tessera.sources import files, lines, sinks


def write(folder, name, text):
    p = folder / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_jsonl_keeps_line_numbers(spark, tmp_path):
    p = write(tmp_path, "a.jsonl", '{"x": 1}\n\n{"x": 2}\n')
    assert [(r.line, r.raw) for r in files.jsonl_lines(spark, p).orderBy("line").collect()] == [(1, '{"x": 1}'), (3, '{"x": 2}')]


def test_lines_of_many_splits_are_numbered_in_their_files(spark, tmp_path):
    want = {}
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 1), ("deep/c.jsonl", 700)):
        rows = [f'{{"x": {i}, "of": "{name}"}}' + "\r" * (i % 3 == 0) if i % 7 else "" for i in range(n)]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(rows) + "\n" * (n > 1), newline="")
        want |= {(name.split("/")[-1], i + 1): r.removesuffix("\r") for i, r in enumerate(rows) if r}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = files.jsonl_lines(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path), recursiveFileLookup=True).select("_metadata.file_block_start").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == len(want) and {(r.path.split("/")[-1], r.line): r.raw for r in rows} == want


def test_csv_is_verbatim(spark, tmp_path):
    p = write(tmp_path, "a.csv", '﻿card_id,quote\nC0001,"a ""b""\n c "\nC0002,\n')
    assert [tuple(r) for r in files.csv(spark, p).collect()] == [("C0001", 'a "b"\n c '), ("C0002", "")]


def test_pipe_tables(spark, tmp_path):
    p = write(tmp_path, "t.md", "| id | a |\n|---|---|\n| C0001 | t | w | l | m. |\n")
    assert files.launch_table(spark, p).first().philosophical_move == "m."
    row = "| C0002 | s | t | a | w | l | m | p | {} | — | d |\n"
    p = write(tmp_path, "r.md", row.format("x, y") + row.format("z"))
    r = files.registry(spark, p).first()
    assert (r.coordinates, r.tensions) == (["z"], [])
    with pytest.raises(Exception, match="not 5 cells"):
        files.launch_table(spark, p).collect()


def test_fixed_width(spark, tmp_path):
    text = "C0001  alpha  long\n       beta   text\n\nC0002  gamma  x\n"
    df = lines.numbered_lines(files.text_files(spark, write(tmp_path, "f.txt", text)), ["path"], "text")
    got = [r.cells for r in lines.fixed_width(df, ["path"], "-----  -----  ----").orderBy("block").collect()]
    assert got == [["C0001", "alpha beta", "long text"], ["C0002", "gamma", "x"]]


def test_sections_and_ids(spark, tmp_path):
    p = write(tmp_path, "s.md", "## batch\n### C0001\n- **key:** value\n- **b:** c\n### C0002\n- **key:** x\n")
    assert {r.id: r.fields for r in files.recovery(spark, p).collect()} == {"C0001": {"key": "value", "b": "c"}, "C0002": {"key": "x"}}
    p = write(tmp_path, "d.md", "### C0001\n- **k:** v\n### C0002\n- **k:** v\n### C0001\n- **k:** v\n")
    with pytest.raises(Exception, match="comes twice"):
        files.recovery(spark, p).collect()
    p = write(tmp_path, "u.md", "C0009\nUnresolved:\n- C0001\n- C0003\n\n## next\nC0007")
    assert sorted(r.id for r in files.unresolved_ids(spark, p).collect()) == ["C0001", "C0003"]


def test_benchmark_cases(spark, tmp_path):
    p = write(tmp_path, "b.md", "## Cases\n### B01 — First\n**Centre:** «x»\n- one\n- two\n### B02 — Second\n**Centre:** y\n## End\n- not\n")
    got = {r.id: (r.title, r.fields, r["items"]) for r in files.benchmark_cases(spark, p).collect()}
    assert got == {"B01": ("First", {"Centre": "«x»"}, ["one", "two"]), "B02": ("Second", {"Centre": "y"}, [])}


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write(tmp_path / "d", "a", "hello")
    good = hashlib.sha256(b"hello").hexdigest()
    m = write(tmp_path, "m.txt", f"# x\n{good}  5  a\n{good}  1  b\n")
    assert {r.name: r.problem for r in files.manifest_problems(files.manifest(spark, m), files.file_hashes(spark, str(tmp_path / "d"))).collect()} == {"b": "missing"}


def test_folder_hashes(spark, tmp_path, monkeypatch):
    """A folder's digest goes on from file to file; no file grows with the folder."""
    monkeypatch.setattr(files, "PART", 1000)
    rows = [(k, "ab"[k % 7 > 0], f"line {k} é\nand more" + "x" * (k % 90)) for k in range(400)]
    files.write_parts(spark.createDataFrame(rows, "k long, f string, t string").repartition(3), str(tmp_path / "d"), "f", "k", "t")
    got = {r.name: (r.size, r.sha256) for r in files.folder_hashes(spark, str(tmp_path / "d"), "f").collect()}
    whole = {f: "".join(t + "\n" for _, g, t in rows if g == f).encode() for f in "ab"}
    assert got == {f: (len(x), hashlib.sha256(x).hexdigest()) for f, x in whole.items()}
    assert len(list((tmp_path / "d" / "f=b").glob("part-*"))) > 5 and max(f.stat().st_size for f in (tmp_path / "d").rglob("part-*")) < 4000


def test_yaml_blocks(spark, tmp_path):
    pytest.importorskip("yaml")
    p = write(tmp_path, "y.md", "```yaml\nid: 2.10\nq:\n  - a: b\n```\n")
    assert files.yaml_blocks(spark, p).first().record == '{"id": "2.10", "q": ["a: b"]}'


def test_yaml_states(spark, tmp_path):
    pytest.importorskip("yaml")
    text = "x\n```yaml\na: 1.50\nb: yes\nc: ~\n```\n``` yaml\nq:\n- one: two\n- `z`\n```\n```yaml\nq: [\n```\n```python\na: 1\n```\n```yaml\nnever: ends\n"
    p = write(tmp_path, "y.md", text)
    got = files.yaml_records(files.fenced_blocks(files.text_lines(spark, p), "yaml")).orderBy("block").collect()
    assert [(r.block, r.line, r.state, r.record) for r in got] == [(0, 2, "good", '{"a": "1.50", "b": true, "c": null}'), (1, 7, "repaired", '{"q": ["one: two", "`z`"]}'), (2, 12, "refused", None)]
    with pytest.raises(Exception, match="refused at line 12"):
        files.yaml_blocks(spark, p).collect()


def test_all_or_nothing(spark, tmp_path):
    a, b = write(tmp_path, "a.txt", "one"), write(tmp_path, "b.txt", "two")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = lambda *rows: spark.createDataFrame(rows, "name string, size long, sha256 string")
    found = files.file_hashes(spark, str(tmp_path))
    files.require_files(listed(("a.txt", 3, sha("one")), ("b.txt", 3, sha("two"))), found)
    with pytest.raises(ValueError, match=r"a.txt \(sha256\), b.txt \(size\), c.txt \(missing\)"):
        files.require_files(listed(("a.txt", 3, sha("1")), ("b.txt", 4, sha("two")), ("c.txt", 1, "")), found)
    assert a and b


def test_sinks(spark, tmp_path):
    items = spark.range(4).withColumnRenamed("id", "k")
    out = str(tmp_path / "done")
    sinks.resume(items.where("k < 2"), out, "k", lambda d: d)
    sinks.resume(items, out, "k", lambda d: d)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    v = spark.createDataFrame([("p", "m", "v1", "k", [1.0])], "provider string, model string, version string, key string, vector array<double>")
    sinks.write_vectors(v, str(tmp_path / "v"))
    sinks.write_vectors(v.selectExpr("provider", "model", "'v2' AS version", "key", "vector"), str(tmp_path / "v"))
    assert files.vectors(spark, str(tmp_path / "v"), "p", "m", "v1", 1).count() == 1 and spark.read.parquet(str(tmp_path / "v")).count() == 2
    text = sinks.markdown_table(spark.createDataFrame([(2, "b"), (1, None)], "n long, t string"), ["n"], "n", "t").first().text
    assert text == "| n | t |\n|---|---|\n| 1 |  |\n| 2 | b |"


def test_stream(spark, tmp_path, sf):
    from tessera.streaming import events

    spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM (SELECT max(n) AS n FROM w GROUP BY start, event_type)").first()[0] == spark.read.parquet(str(tmp_path / "in")).count()
