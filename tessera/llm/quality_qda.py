"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and its diagonal. The score is the
difference of the two Mahalanobis log densities, through cached Cholesky factors, mapped to a probability
by a logistic curve fitted on the training rows. Sums of statistics and of their products are aggregated by
Spark over all labelled rows outside the held-out fold; only those sums reach the driver.

Defined cases: null and empty texts have all statistics 0 and get that point's score; documents without a
label are scored like others; null labels don't count; several labels of one document are averaged. Without
rows of both labels every score is the share of label 1, or 0.5 where there are none. Repeated rows each
get their row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialise
from tessera.llm.docstats import FEATURES, document_statistics
from tessera.llm.quality_trees import fold, labelled

DECISION = 0.3
#: Shares of the pooled covariance and of the diagonal in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
#: Statistics that are shares of small values: their square roots spread better.
ROOTED = tuple(i for i, f in enumerate(FEATURES) if f.endswith("_share"))
#: Log-density differences are cut here for calibration and counted in so many bins a unit.
SPAN, BINS = 60.0, 4


def transform(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, ROOTED] = np.sqrt(np.maximum(x[:, ROOTED], 0))
    return x


@dataclass
class Discriminant:
    """Means, Cholesky factors' inverses and log determinants of both classes; slope and intercept of the curve."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    scale: np.ndarray
    centre: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0
    constant: float | None = None

    def difference(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.zeros(len(features))
        x = (transform(features) - self.centre) / self.scale
        log = [-0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)]
        return np.clip((log[1] - log[0]) / x.shape[1], -SPAN, SPAN)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-(self.slope * self.difference(features) + self.intercept)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of the transformed features, by label; each partition sums first."""
    d = len(FEATURES)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = np.array(batch.column(0).to_pylist())
        x = transform(np.array(batch.column(1).to_pylist()))
        at = np.unique(label)
        sums = [np.concatenate([[(label == c).sum()], x[label == c].sum(0), (x[label == c].T @ x[label == c]).ravel()]) for c in at]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], ["label", "s"])

    parts = arrow_map(rows.select("label", "features"), run, "label int, s array<double>")
    total = parts.select("label", F.posexplode("s").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    out = {}
    got = total.toPandas()  # 2 (1 + d + d d) numbers
    for c, g in got.groupby("label"):
        v = g.sort_values("at")["v"].to_numpy()
        out[int(c)] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    none = np.zeros(0)
    if set(sums) != {0, 1}:
        n = {c: s[0] for c, s in sums.items()}
        return Discriminant(none, none, none, none, none, constant=n.get(1, 0) / sum(n.values()) if n else 0.5)
    n = sum(s[0] for s in sums.values())
    centre = sum(s[1] for s in sums.values()) / n
    spread = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    mean = [(sums[c][1] / sums[c][0] - centre) / scale for c in (0, 1)]
    cov = [(sums[c][2] / sums[c][0] - np.outer(sums[c][1], sums[c][1]) / sums[c][0] ** 2) / np.outer(scale, scale) for c in (0, 1)]
    pooled = sum(cov[c] * sums[c][0] for c in (0, 1)) / n
    whiten, log_det = [], []
    for c in (0, 1):
        # fewer rows lean more on what both classes share
        lean = max(TO_POOLED, min(1.0, len(FEATURES) / sums[c][0]))
        s = (1 - lean) * cov[c] + lean * pooled
        s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(np.array(mean), np.array(whiten), np.array(log_det), scale, centre)


def calibrate(model: Discriminant, rows: DataFrame) -> Discriminant:
    """Slope and intercept by Newton steps over counts in bins of the difference: a bounded table."""
    if model.constant is not None:
        return model

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = np.round(model.difference(np.array(batch.column(1).to_pylist())) * BINS).astype("int32")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(z)], ["label", "z"])

    got = arrow_map(rows.select("label", "features"), run, "label int, z int").groupBy("label", "z").count().toPandas()
    z, y, w = got["z"].to_numpy() / BINS, got["label"].to_numpy(float), got["count"].to_numpy(float)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([(w * (y - p) * z).sum() - 1e-3 * (a - 1), (w * (y - p)).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.intercept = max(a, 1e-6), b
    return model


def classify(docs: DataFrame, labels: DataFrame, decision: float = DECISION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of `docs`; statistics are computed once and stored."""
    stored = materialise(document_statistics(docs, id_col, text_col).select(id_col, "features"))
    rows = stored.join(labelled(labels, id_col=id_col), id_col).select("label", "features")
    model = calibrate(fit(moments(rows)), rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(np.array(batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= decision).astype("int32"))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = arrow_map(stored, run, f"{id_col} {kind}, score double, predicted int")
    return scored.select(id_col, (F.coalesce(fold(id_col), F.lit(-1)) == 0).alias("held_out"), "score", "predicted")
