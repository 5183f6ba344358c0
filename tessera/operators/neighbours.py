"""Nearest vectors by blocked matrix products: packed blocks of both sides, the best of each block pair, merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Vectors of a packed block of queries, and of cards: with 64 dimensions, half a megabyte and two.
QUERIES, CARDS = 1024, 4096
#: Cosines are compared at so many digits, so that the order of sums doesn't decide ties; then by id.
DIGITS = 9


def packed(df: DataFrame, id_col: str, vector: str, rows: int) -> DataFrame:
    """(ids, units): blocks of up to `rows` unit vectors of one partition, as 64-bit floats in one binary; null vectors are left out.

    A zero vector stays zero, so that its cosines are 0."""
    kind = df.schema[id_col].dataType.simpleString()
    typed = to_arrow_schema(df.sparkSession.createDataFrame([], f"ids array<{kind}>, units binary").schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, vectors = batch.slice(at, rows).columns
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(flat) % len(ids) or len(set(vectors.value_lengths().to_pylist())) > 1:
                    raise ValueError("vectors of several lengths")
                m = flat.reshape(len(ids), -1)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], typed[0].type), pa.array([np.divide(m, n, out=m, where=n > 0).tobytes()], pa.binary())], schema=typed)

    return df.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>")).mapInArrow(pack, f"ids array<{kind}>, units binary")


def _best(r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest values, equal ones by id."""
    if r.shape[1] > k:
        least = -np.partition(-r, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(r >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(r.shape))
    order = np.lexsort((np.argsort(np.argsort(ids, kind="stable"), kind="stable")[col], -r[row, col], row))
    row, col = row[order], col[order]
    starts = np.searchsorted(row, np.arange(r.shape[0]))
    keep = np.arange(len(row)) - starts[row] < k
    return row[keep], col[keep]


def nearest(queries: DataFrame, cards: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """(query_id, card_id, rank, cosine) of the k nearest cards (card_id, vector) of each query (query_id, query_vector).

    Both sides are packed; a pair of blocks costs one matrix product and keeps k rows a query, so what is shuffled is k
    rows for each query and card block. The queries are a stated set. `apart` leaves out the card that is the query
    itself. Cosines have DIGITS digits, equal ones are ordered by id."""
    spark = queries.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(), cards.schema["card_id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, card_id {kinds[1]}, cosine double"
    typed = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, qm, c, cm in zip(*(x.to_pylist() for x in batch.columns)):
                a, b = np.frombuffer(qm).reshape(len(q), -1), np.frombuffer(cm).reshape(len(c), -1)
                r = np.round(a @ b.T, DIGITS) + 0.0  # no negative zeros
                ids = np.array(c)
                if apart:
                    r[np.array(q)[:, None] == ids[None, :]] = -np.inf
                row, col = _best(r, ids, k)
                real = np.isfinite(r[row, col])
                row, col = row[real], col[real]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q)[row].tolist(), typed[0].type), pa.array(ids[col].tolist(), typed[1].type), pa.array(r[row, col])], schema=typed)

    x = packed(queries, "query_id", "query_vector", QUERIES).toDF("q", "qm")
    y = packed(cards, "card_id", "vector", CARDS).toDF("c", "cm")
    pairs = y.crossJoin(x).select("q", "qm", "c", "cm")  # of blocks: a stated query set against all rows
    found = pairs.mapInArrow(multiply, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("card_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "card_id", "rank", "cosine")


def case_ranks(studied: DataFrame, ranked: DataFrame) -> DataFrame:
    """(card_id, query_id, rank) of the studied cards in the rankings of all cases that have them."""
    return ranked.join(studied.select("card_id").distinct(), "card_id", "left_semi").select("card_id", "query_id", "rank")


def variant_frequencies(queries: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    """(variant, card_id, freq, best_rank): how often each card (variant, card_id, vector) is among a query's k nearest, by
    variant of the documents.

    A variant's cards are ranked among themselves: block pairs are made of one variant's cards alone, by ids that name both."""
    spark = queries.sparkSession
    names = sorted(r.variant for r in variants.select("variant").distinct().collect())  # a handful of declared variants
    found = spark.createDataFrame([], f"variant string, card_id {variants.schema['card_id'].dataType.simpleString()}, freq long, best_rank int")
    for name in names:
        r = nearest(queries, variants.where(F.col("variant") == name).select("card_id", "vector"), k)
        found = found.union(r.groupBy("card_id").agg(F.count("*").alias("freq"), F.min("rank").alias("best_rank")).select(F.lit(name).alias("variant"), "card_id", "freq", "best_rank"))
    return found


#: What a product of unit vectors may differ by from the cosine as it is summed item by item, and queries multiplied at once.
MARGIN, SLICE = 1e-9, 128
#: Cards of a block of `best_cosines`: with 64 dimensions, eight megabytes.
BLOCK = 16384


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, `rows` at a time."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(df: DataFrame, keys: list[str], vector: str, rows: int, names: tuple[str, str, str]) -> DataFrame:
    """(ids, dims, values): blocks of up to `rows` vectors of one length, as they are; dims is -1 where a vector or an item is null."""
    fields = ", ".join(f"{k}: {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{names[0]} array<struct<{fields}>>, {names[1]} int, {names[2]} binary"
    typed = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, rows):
            ids, vectors = pa.StructArray.from_arrays(batch.columns[:-1], fields=list(typed[0].type.value_type)), batch.columns[-1]
            length = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
            if vectors.flatten().null_count:
                length[[v is not None and None in v for v in vectors.to_pylist()]] = -1
            for n in np.unique(length):
                own = pa.array(np.nonzero(length == n)[0])
                values = vectors.take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if n >= 0 else b""
                held = ids.take(own)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held).cast(typed[0].type), pa.array([int(n)], pa.int32()), pa.array([values], pa.binary())], schema=typed)

    return df.select(*keys, F.col(vector).cast("array<double>")).mapInArrow(pack, schema)


class _Side:
    """A block's vectors with their lengths and units, summed in the order of the items; `odd` ones can't be screened."""

    def __init__(self, n: int, dims: int, values: bytes):
        with np.errstate(all="ignore"):
            self.v = np.frombuffer(values).reshape(n, dims)
            norm = np.sqrt(np.cumsum(self.v * self.v, axis=1)[:, -1]) if dims else np.zeros(n)
            self.norm = np.where(norm == 0, 1.0, norm)
            self.odd = ~np.isfinite(norm) | ((self.norm < 1e-100) | (self.norm > 1e100))
            self.units = np.where(self.odd[:, None], 0.0, self.v / self.norm[:, None])
        self.columns = np.ascontiguousarray(self.v.T)


def _block_best(q: _Side, c: _Side, rows: np.ndarray, order: np.ndarray, own: list[np.ndarray], k: int, ties: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the k best of each of `rows`: screened by a product of matrices, then summed item by item."""
    r = q.units[rows] @ c.units.T
    r[:, c.odd] = -np.inf
    for i, at in enumerate(own):
        r[i, at] = -np.inf
    least = np.partition(r, r.shape[1] - k, axis=1)[:, r.shape[1] - k] - MARGIN if r.shape[1] > k else np.full(len(rows), -np.inf)
    near = (r >= least[:, None]) | c.odd[None, :]
    near[q.odd[rows]] = True
    for i, at in enumerate(own):
        near[i, at] = False
    row, col = np.nonzero(near)
    total, full = np.zeros(len(row)), rows[row]
    with np.errstate(all="ignore"):
        for d in range(len(c.columns)):
            total += q.columns[d][full] * c.columns[d][col]
        total /= q.norm[full] * c.norm[col]
    key = np.where(np.isnan(total), np.inf, total)
    by = np.lexsort((order[col], -key, row))
    row, col, total, key = row[by], col[by], total[by], key[by]
    first = np.searchsorted(row, np.arange(len(rows)))
    keep = np.arange(len(row)) - first[row] < k
    if ties and len(row):
        last = np.minimum(first + k - 1, len(row) - 1)
        keep |= (row[last] == np.arange(len(rows)))[row] & (key == key[last][row])
    return row[keep], col[keep], total[keep]


def best_cosines(queries: DataFrame, cards: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), apart: bool = False, ties: bool = False) -> DataFrame:
    """(*keys, card_id, cosine), unrounded: rows among which are the k best of each query, by cosine, then by id.

    With `ties`, also those whose cosine equals the k-th. Both sides are packed; of a pair of blocks, a product of
    matrices leaves what comes within MARGIN of the k best, and those cosines are summed item by item, so that order and
    ties are those of plain doubles. `apart` leaves out the card that is the query itself."""
    spark = queries.sparkSession
    queries = queries.select(*keys, "query_vector")
    cards = cards.select("card_id", "vector")
    if apart:
        queries, cards = queries.where("query_id IS NOT NULL"), cards.where("card_id IS NOT NULL")
    schema = ", ".join([f"{n} {queries.schema[n].dataType.simpleString()}" for n in keys] + [f"card_id {cards.schema['card_id'].dataType.simpleString()}", "cosine double"])
    typed = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (qi, qd, qv, ci, cd, cv) = (x[at] for x in batch.columns)
                qi, ci, qd, cd = qi.values, ci.values, qd.as_py(), cd.as_py()
                names = ci.field(0).to_pylist()
                place = {x: i for i, x in enumerate(sorted(set(names), key=lambda x: (x is not None, x)))}
                order = np.array([place[x] for x in names])
                sorted_ = np.argsort(order, kind="stable")
                mine = np.array([place.get(x, -1) for x in qi.field(list(keys).index("query_id")).to_pylist()]) if apart else np.full(len(qi), -1)
                low, high = (np.searchsorted(order[sorted_], mine, side) for side in ("left", "right"))
                if real := qd == cd and qd >= 0:
                    q, c = _Side(len(qi), qd, qv.as_py()), _Side(len(ci), cd, cv.as_py())
                for start in range(0, len(qi), SLICE):
                    rows = np.arange(start, min(start + SLICE, len(qi)))
                    own = [sorted_[low[i] : high[i]] for i in rows]
                    if real:
                        row, col, cosine = _block_best(q, c, rows, order, own, k, ties)
                        cosine = pa.array(cosine)
                    else:  # no cosine at all: by id
                        kept = [[x for x in (sorted_ if ties else sorted_[: k + len(o)]) if x not in o] for o in own]
                        row, col = np.repeat(np.arange(len(rows)), [len(x) for x in kept]), np.array([x for o in kept for x in o], dtype=np.int64)
                        cosine = pa.nulls(len(row), pa.float64())
                    held = qi.take(pa.array(rows[row]))
                    yield pa.RecordBatch.from_arrays([*[held.field(i) for i in range(len(keys))], ci.field(0).take(pa.array(col)), cosine], schema=typed)

    return _block_pairs(queries, cards, keys).mapInArrow(multiply, schema)


def _block_pairs(queries: DataFrame, cards: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(q, qd, qm, c, cd, cm): packed blocks of queries against packed blocks of all cards."""
    parts = queries.sparkSession.sparkContext.defaultParallelism
    x = _blocks(queries.repartition(max(1, parts // 4)), list(keys), "query_vector", QUERIES, ("q", "qd", "qm"))
    y = _blocks(cards.repartition(parts), ["card_id"], "vector", BLOCK, ("c", "cd", "cm"))
    return y.crossJoin(x).select("q", "qd", "qm", "c", "cd", "cm")  # of blocks: a stated query set against all rows


def _summed(q: _Side, c: _Side, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of pairs, summed item by item."""
    total = np.zeros(len(row))
    with np.errstate(all="ignore"):
        for d in range(len(c.columns)):
            total += q.columns[d][row] * c.columns[d][col]
        return total / (q.norm[row] * c.norm[col])


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of block pairs with ids (query_id) and (card_id): the cosines of all pairs of different ids, SLICE queries at once; NaN is infinite."""
    for batch in batches:
        for at in range(batch.num_rows):
            (qi, qd, qv, ci, cd, cv) = (x[at] for x in batch.columns)
            qd, cd = qd.as_py(), cd.as_py()
            if qd != cd or qd < 0:
                continue  # no cosine at all
            mine, theirs = (np.array(x.values.field(0).to_pylist()) for x in (qi, ci))
            q, c = _Side(len(mine), qd, qv.as_py()), _Side(len(theirs), cd, cv.as_py())
            odd = np.nonzero(c.odd)[0]
            order = np.argsort(theirs, kind="stable")
            low, high = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
            for start in range(0, len(mine), SLICE):
                rows = np.arange(start, min(start + SLICE, len(mine)))
                r = q.units[rows] @ c.units.T
                for i in np.nonzero(q.odd[rows])[0]:
                    r[i] = _summed(q, c, np.full(len(theirs), rows[i]), np.arange(len(theirs)))
                if len(odd):
                    r[:, odd] = _summed(q, c, np.repeat(rows, len(odd)), np.tile(odd, len(rows))).reshape(len(rows), -1)
                if len(odd) or q.odd[rows].any():
                    r[np.isnan(r)] = np.inf
                if (low[rows] < high[rows]).any():
                    other = np.ones(r.shape, bool)
                    for i, k in enumerate(rows):
                        other[i, order[low[k] : high[k]]] = False
                    r = r[other]
                yield r.ravel()
