from tessera.operators import diagnostics


def test_runs_are_counted_without_strings(spark):
    docs = spark.createDataFrame([(1, "A b c d e f"), (2, "a B c d e"), (2, "x"), (3, "b c d e f g h"), (4, None), (None, "a b c d e")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a b c d e f, a b c d e f"), (8, "c d e f g"), (9, "a b c"), (10, "q r s t u v")], "query_id long, text string")
    got = diagnostics.reused_runs(queries, docs)
    assert sorted(map(tuple, got.collect())) == [(7, 3, 2), (8, 1, 1)]
    assert "array_join" not in got._jdf.queryExecution().toString()
    long = diagnostics.reused_runs(queries, docs, 2)
    assert sorted(r.query_id for r in long.collect()) == [7, 8, 9]
    assert dict(docs.select(diagnostics.run_hashes("text", 5)).dtypes).popitem()[1] == "array<struct<run:bigint,check:int>>"
