"""Writers: corpora with manifests, runs, vector stores, representations, resumable results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir), for what is read back at once.

    Only a local session may lack the setting; it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, for frames that are read more than once; lineage ends here."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a path of scratch() and is read no more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_corpus(cards: DataFrame, path: str, force: bool = False) -> None:
    """JSON lines and a manifest of counts; an existing corpus is only replaced by force."""
    mode = "overwrite" if force else "errorifexists"
    cards.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/cards")
    cards.agg(F.count("*").alias("n_cards"), F.count_if("technical.retrieval_eligible").alias("n_eligible")).coalesce(1).write.mode(mode).json(f"{path}/manifest")


def write_run(traces: DataFrame, path: str, run_id: str, **sections: DataFrame) -> None:
    """K3–K5: a run's traces and diagnostics in a folder of its own, which must be new."""
    traces.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").json(f"{path}/run_id={run_id}/traces")
    for name, df in sections.items():
        df.write.mode("errorifexists").json(f"{path}/run_id={run_id}/{name}")


def write_vectors(new: DataFrame, path: str) -> None:
    """K6: vectors partitioned by configuration; only the partitions that `new` has are replaced."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "model", "version").parquet(path)


def export_representations(rows: DataFrame, path: str) -> None:
    """K7: (key, version, sha256, text) as JSON lines."""
    rows.select("key", "version", "sha256", "text").write.mode("errorifexists").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """K8: session events, appended."""
    events.write.mode("append").parquet(path)


def resume(items: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Does and appends what a former run hasn't done. Results have `key`."""
    spark = items.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # a first run has no results to read
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = items if done is None else items.join(done, key, "left_anti")
    work(todo).write.mode("append").parquet(path)


def markdown_table(df: DataFrame, order: list[Column | str], *columns: str) -> DataFrame:
    """K9: one row `text`: a report's rows as a pipe table; for reports, which are small."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = df.select(F.struct(*order, line.alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return rows.select(F.array_join(F.concat(F.array(F.lit(head)), F.transform("rows", lambda r: r["line"])), "\n").alias("text"))
