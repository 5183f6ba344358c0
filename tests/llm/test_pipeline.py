import __spark_entry__
import corpus_pipeline
from tessera.llm import bpe, decontaminate, line_dedup, quality_trees
from tessera.llm.common import materialise
from tessera.llm.queries import vocabulary
from tests.llm.test_dedup import brute


def test_each_stage_on_its_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(materialise(stage(spark, steps[-1], sf)))
        assert steps[-1].columns == columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    trees = quality_trees.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(rows[1]) == {r.doc_id for r in quality_trees.judge(docs, trees).collect() if r.kept}
    assert rows[2] and all(set(r.text.split("\n")) <= set(rows[1][i].text.split("\n")) and r.n_chars == len(r.text) for i, r in rows[2].items())
    assert all(line_dedup.normalised(rows[1][i].text) for i in set(rows[1]) - set(rows[2]))
    groups = brute([(i, r.text) for i, r in rows[2].items()], size=5)
    assert set(rows[3]) == {i for i, g in groups.items() if i == g}
    bad = {r.doc_id for r in decontaminate.find(steps[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(rows[4]) == set(rows[3]) - bad
    last = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    c = bpe.codec(vocabulary())
    assert {i: c.decode(x).decode() for i, x in last.items()} == {i: r.text for i, r in rows[4].items()}


def test_edges(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", None, None), (None, "w " * 80, "en", "s", 160), (3, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("doc_id = 9")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, sf).count() <= 3


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
