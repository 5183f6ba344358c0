"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

Trees are grown level by level on histograms of a bounded, hash-chosen sample of labelled rows, with
monotonic constraints (`MONOTONE`): a document never gains from more symbols, repeated lines or repeated
words. They are flattened into numpy arrays of nodes, which every task scores in whole batches.

Defined cases: null and empty texts have no words and fail the base rules; documents without a label are
scored like others; several labels of one document are averaged; null labels don't count. Without rows of
both labels there is no model and the base rules decide alone. Repeated rows each get their row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map
from tessera.llm.docstats import COUNTS, FEATURES, document_statistics, statistics

MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1}
#: At most so many labelled documents are fetched to fit the trees.
SAMPLE = 50_000
KEEP = 0.3


@dataclass
class Trees:
    """Complete binary trees: node i has children 2 i + 1 and 2 i + 2; one row of each array per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            margin += value[at]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[str, int] = MONOTONE, names: tuple[str, ...] = FEATURES,
        rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 5.0, least: float = 2.0) -> Trees | None:
    """Logistic loss, second-order gains. None unless both labels occur.

    Under a constraint of sign s, a split is taken only if s * (right - left) >= 0 for its two weights, and
    the children stay on either side of the middle between them.
    """
    if len(np.unique(y)) < 2:
        return None
    n, d = x.shape
    sign = np.array([monotone.get(f, 0) for f in names])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    nodes, first = 2 ** (depth + 1) - 1, 2**depth - 1
    shape = (rounds, nodes)
    out = Trees(np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape), float(np.log(y.mean() / (1 - y.mean()))), depth)
    margin = np.full(n, out.base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = at - start
            for j in range(d):
                size = width * bins
                cell = local * bins + code[:, j]
                gs = np.bincount(cell, g, size).reshape(width, bins).cumsum(1)
                hs = np.bincount(cell, h, size).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                lo, hi = low[start : start + width, None], high[start : start + width, None]
                wl = np.clip(-gs / (hs + ridge), lo, hi)
                wr = np.clip(-(gt - gs) / (ht - hs + ridge), lo, hi)
                wp = np.clip(-gt / (ht + ridge), lo, hi)
                loss = lambda w, a, b: a * w + 0.5 * (b + ridge) * w * w
                gain = loss(wp, gt, ht) - loss(wl, gs, hs) - loss(wr, gt - gs, ht - hs)
                gain[(hs < least) | (ht - hs < least) | (sign[j] * (wr - wl) < 0)] = 0
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                for i in np.nonzero(gain[np.arange(width), k] > best)[0]:
                    best[i] = gain[i, k[i]]
                    node = start + i
                    out.feature[t, node], out.threshold[t, node] = j, cuts[j][k[i]]
                    for child in (2 * node + 1, 2 * node + 2):
                        low[child], high[child] = low[node], high[node]
                    if sign[j]:
                        mid = (wl[i, k[i]] + wr[i, k[i]]) / 2
                        below, above = (2 * node + 1, 2 * node + 2)[:: int(sign[j])]
                        high[below], low[above] = min(high[below], mid), max(low[above], mid)
            # a node that isn't split sends its rows left, below the infinite threshold
            for i in np.nonzero(best <= 1e-6)[0]:
                for child in (2 * (start + i) + 1, 2 * (start + i) + 2):
                    low[child], high[child] = low[start + i], high[start + i]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[t, at]] > out.threshold[t, at])
        leaf = at - first
        w = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        out.value[t, first:] = rate * np.clip(w, low[first:], high[first:])
        margin += out.value[t, at]
    return out


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: rows with 0 are held out of every fit."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def labelled(labels: DataFrame, column: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, label) outside the held-out fold, one row per document: label 1 where half or more say so."""
    return (
        labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
        .groupBy(id_col).agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Fits on at most `sample` labelled documents, those whose ids have the smallest hashes."""
    chosen = labelled(labels, id_col=id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # as many rows as `sample` at most
    got = document_statistics(rows, id_col, text_col, carry=("label",)).select("label", "features", id_col).toPandas()
    if got.empty:
        return None
    got = got.sort_values(id_col, kind="stable")
    return fit(np.array(got["features"].tolist()), got["label"].to_numpy(float))


def verdicts(c: np.ndarray, features: np.ndarray, trees: Trees | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score and kept, from rows of COUNTS and FEATURES."""
    failed = (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])
    score = trees.score(features) if trees else np.ones(len(c))
    return failed, score, ~failed & (score >= threshold)


def judge(docs: DataFrame, trees: Trees | None, threshold: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *COUNTS, base_failed, score, kept) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = zip(*map(statistics, batch.column(1).to_pylist()))
        c = np.array(counts, np.int64)
        failed, score, kept = verdicts(c, np.array(features), trees, threshold)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(kept)],
            [id_col, *COUNTS, "base_failed", "score", "kept"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"{id_col} {kind}", *(f"{c} long" for c in COUNTS), "base_failed boolean, score double, kept boolean"])
    return arrow_map(docs.select(id_col, text_col), run, schema)


def keep(docs: DataFrame, trees: Trees | None, threshold: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass the base rules and the trees, with all their columns; nothing is shuffled."""
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = zip(*map(statistics, batch.column(place).to_pylist()))
        return batch.filter(pa.array(verdicts(np.array(counts, np.int64), np.array(features), trees, threshold)[2]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, schema, pieces=True)
