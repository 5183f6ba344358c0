"""Helpers that the operators of this folder share: shared folders, Arrow maps, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = b" \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir).

    Where the setting is missing in a local session, as in tests, a temporary folder takes its place; executors on
    other machines could not read that, so elsewhere the setting has to be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote for these frames, of which nothing is read any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives memory that nothing uses back to the system: a worker is kept for later tasks, and what it has freed would stay its own."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)

#: Bytes of texts that become Python objects at once, where arrow_map gets them in pieces.
PIECE = 1 << 22


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, pieces: bool = False) -> DataFrame:
    """mapInArrow for a function of one record batch; batches without rows are skipped.

    With `pieces`, the function gets a batch of over PIECE bytes in slices of about that size, a row at least: for
    functions that work row by row, so that a worker's memory doesn't grow with long texts; freed memory is given back
    when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(batch.nbytes, PIECE)) if pieces else max(1, batch.num_rows)
            for at in range(0, batch.num_rows, step):
                out = fn(batch.slice(at, step))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        if pieces:
            trim()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges`: (id, component) with the smallest id of each.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set stops
    changing. Each round is one aggregation and one join; the number of rounds grows with the
    logarithm of the diameter. Self loops and repeated edges are harmless; no edges give no rows.
    Every node but the smallest of its component appears once as `id`; that smallest appears too.
    """
    pair = edges.select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    ).where("u <> v").distinct()
    pair = materialise(pair)
    last = None
    for _ in range(max_rounds):
        # large star: neighbours larger than a node move to the smallest neighbour (or the node itself)
        both = pair.select("u", "v").union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, pair = pair, materialise(small)
        release(before)
        now = pair.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = pair.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())


#: Bits of Bloom filters, as a power of two: 2 MB in each task, whatever they are made from.
FILTER_BITS = 24


def _filter_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.uint64((1 << FILTER_BITS) - 1)
    return keys & keep, (keys >> np.uint64(FILTER_BITS)) & keep


def bloom(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column of well-mixed longs; at most 2 ** (FILTER_BITS - 3) rows are fetched.

    It only saves work: what passes is joined exactly, and a filter that is too full lets all pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = _filter_places(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
        at = np.unique(np.concatenate([a, b]))
        bit = np.left_shift(1, (at & np.uint64(7)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(3)).astype(np.int32)), pa.array(bit.astype(np.int32))], ["place", "bit"])

    got = arrow_map(keys, run, "place int, bit int").groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[got["place"].to_numpy()] = got["bit"].to_numpy().astype(np.uint8)
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the unsigned 64-bit `keys` that pass the filter."""
    a, b = _filter_places(keys)
    at = np.nonzero((table[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1)[0]
    b = b[at]
    return at[((table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1) == 1]
