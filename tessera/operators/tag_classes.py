"""Overlaps of tag sets by classes: ids with equal bit masks are one class, and blocks of classes are compared at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.neighbours import SLICE, _gathered

#: Classes of a packed block of queries, and of cards.
QUERIES, CARDS = 1024, 16384
#: Longs by name, in the order of the masks: tensions, then coordinates.
OVERLAPS = ("tension_overlap", "coordinate_overlap")


def classes(masks: DataFrame) -> tuple[DataFrame, list[str]]:
    """(*masks, first, n) of (id, *masks): each class with its least id and its size."""
    id_, *names = masks.columns
    return masks.groupBy(*names).agg(F.min(id_).alias("first"), F.count("*").alias("n")), names


def _packed(df: DataFrame, names: list[str], rows: int, prefix: str, firsts: bool) -> DataFrame:
    """(masks, n) of up to `rows` classes, in the order of their least ids where `firsts` is set."""
    schema = f"{prefix}_masks binary, {prefix}_n binary"
    typed = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, rows):
            *masks, n, first = (c for c in batch.columns)
            at = np.arange(batch.num_rows)
            if firsts:
                ids = first.to_pylist()
                at = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])))
            m = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64)[at] for c in masks])
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()), pa.array([n.to_numpy(zero_copy_only=False).astype(np.int64)[at].tobytes()], pa.binary())], schema=typed)

    return df.select(*names, "n", "first").mapInArrow(pack, schema)


def _compared(q: tuple[DataFrame, list[str]], c: tuple[DataFrame, list[str]], schema: str, of) -> DataFrame:
    """`of` every slice of query classes and block of card classes: (masks of both, overlaps, sizes) to columns of `schema`."""
    spark = q[0].sparkSession
    typed = to_arrow_schema(spark.createDataFrame([], schema).schema)
    half = len(q[1]) // 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cm, cn, qm, _ = (np.frombuffer(x[at].as_py(), dtype=np.int64) for x in batch.columns)
                cm, qm = cm.reshape(2 * half, -1), qm.reshape(2 * half, -1)
                for start in range(0, qm.shape[1], SLICE):
                    a = qm[:, start : start + SLICE]
                    t, o = (sum(np.bitwise_count(a[w][:, None] & cm[w][None, :]).astype(np.int64) for w in words) for words in (range(half), range(half, 2 * half)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(of(a, cm, t, o, cn), typed)], schema=typed)

    parts = spark.sparkContext.defaultParallelism
    x = _packed(q[0].repartition(max(1, parts // 4)), q[1], QUERIES, "q", False)
    y = _packed(c[0].repartition(parts), c[1], CARDS, "c", True)
    return y.crossJoin(x).mapInArrow(compare, schema)  # of blocks of classes


def best_pairs(q: tuple[DataFrame, list[str]], c: tuple[DataFrame, list[str]], k: int) -> DataFrame:
    """(masks of both, overlaps): rows among which are each query class's k best card classes, by overlaps, then by least id."""
    schema = ", ".join([f"{n} long" for n in (*q[1], *c[1])] + [f"{o} int" for o in OVERLAPS])

    def of(a, cm, t, o, cn):
        n = cm.shape[1]
        key = (((t << 10) + o) * n) + np.arange(n)[::-1]  # no two of a row are equal
        key[(t + o) == 0] = -1
        if n > k:
            row, col = np.nonzero(key >= np.maximum(np.partition(key, n - k, axis=1)[:, n - k], 0)[:, None])
        else:
            row, col = np.nonzero(key >= 0)
        return [*(m[row] for m in a), *(m[col] for m in cm), t[row, col], o[row, col]]

    return _compared(q, c, schema, of)


def histogram(q: tuple[DataFrame, list[str]], c: tuple[DataFrame, list[str]]) -> DataFrame:
    """(masks of queries, overlaps, n): how many cards have each pair of overlaps with a query class, zeros left out."""
    schema = ", ".join([f"{n} long" for n in q[1]] + [f"{o} int" for o in OVERLAPS] + ["n long"])

    def of(a, cm, t, o, cn):
        wide, high = int(o.max(initial=0)) + 1, int(t.max(initial=0)) + 1
        cell = (np.arange(len(t))[:, None] * high + t) * wide + o
        n = np.bincount(cell.ravel(), weights=np.broadcast_to(cn, t.shape).ravel(), minlength=len(t) * high * wide).astype(np.int64)
        at = np.nonzero(n)[0]
        row, over = at // (high * wide), at % (high * wide)
        keep = over > 0
        row, over, at = row[keep], over[keep], at[keep]
        return [*(m[row] for m in a), over // wide, over % wide, n[at]]

    found = _compared(q, c, schema, of)
    return found.groupBy(*q[1], *OVERLAPS).agg(F.sum("n").alias("n"))
