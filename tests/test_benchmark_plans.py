from pyspark.sql import functions as F

from tessera.operators import benchmarks


def test_records_are_taken_apart_once(spark):
    """Paths of a record stood in the plan once for each rule that reads them, which cost the driver over 1.5 GB."""
    df = spark.createDataFrame([(1, '{"version":"0.1 C0001"}'), (2, '{"cases":[{"id":"B01"}]}'), (3, "no JSON")], "b long, raw string")
    specs = df.select("b", F.sha2(F.col("b").cast("string"), 256).alias("sha256"), "raw")
    found = benchmarks.benchmark_issues(df, "b", ["C0999"], specs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate variant_explode") <= 20
    got = found.groupBy("b").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.count_if(F.col("item") == "$.cases").alias("lacks")).orderBy("b").collect()
    assert [tuple(r) for r in got] == [(1, ["CARD_ID_PRESENT", "SCHEMA"], 1), (2, ["SCHEMA"], 0), (3, ["SCHEMA"], 0)]


def test_status_reads_records_once(spark, sf):
    """The status of benchmarks takes their issues from the same plan."""
    from tessera.plans import catalogue

    plan = catalogue.queries()["benchmark_status"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate variant_explode") <= 20 and plan.count("Scan text") == plan.count("Relation [value") == 0
