"""Fusion by reciprocal ranks without a full ranking of each view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tessera.functions.vectors import dot, doubles, norm
from tessera.operators.neighbours import MARGIN, SLICE, _block_pairs, _Side, _summed, best_cosines
from tessera.sources.sinks import stored

RRF_K = 60
#: Sums of reciprocal ranks are compared at twelve digits.
ROUNDING = 2e-12


def even(views: DataFrame, cards: DataFrame) -> bool:
    """Whether ids are single ones and vectors of one length without odd values, so that bounds of ranks hold."""
    v = doubles("vector")
    own = cards.select("card_id", "vector").union(views.select(F.lit(None), "query_vector"))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    odd = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x)) | ~((squares == 0) | squares.between(1e-200, 1e200))
    n = own.agg(F.countDistinct(F.coalesce(F.size("vector"), F.lit(-1))).alias("lengths"), F.count_if(F.coalesce(odd, F.lit(True))).alias("odd")).first()
    if n.lengths > 1 or n.odd or not cards.where("card_id IS NULL").isEmpty() or not views.where("query_id IS NULL OR view IS NULL").isEmpty():
        return False
    twice = [df.groupBy(*keys).count().where("count > 1") for df, keys in ((cards, ["card_id"]), (views, ["query_id", "view"]))]
    return all(df.isEmpty() for df in twice)


def _before(wanted: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, view, card_id, n): how many cards come before each wanted one of (query_id, view, wanted, query_vector), by cosine, then by id.

    `wanted` has structs (cosine, card_id). Each block's cosines are sorted; what is within MARGIN of a wanted one is summed item by item."""
    kinds = [wanted.schema[c].dataType.simpleString() for c in ("query_id", "view")]
    schema = f"query_id {kinds[0]}, view {kinds[1]}, n array<long>"
    typed = to_arrow_schema(wanted.sparkSession.createDataFrame([], schema).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                (qi, qd, qv, ci, cd, cv) = (x[at] for x in batch.columns)
                names = [qi.values.field(k).to_pylist() for k in range(2)]
                asked, ids = qi.values.field(2), np.array(ci.values.field(0).to_pylist())
                ends = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))])
                cosine, card = (asked.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
                key = (names[0][0], names[1][0], len(names[0]))  # a block is made once in a task for each of the other side's
                if key not in held:
                    held[key] = [*names, ends, np.zeros(len(cosine), np.int64)]
                total = held[key][3]
                q, c = _Side(len(names[0]), qd.as_py(), qv.as_py()), _Side(len(ids), cd.as_py(), cv.as_py())
                for start in range(0, len(names[0]), SLICE):
                    rows = np.arange(start, min(start + SLICE, len(names[0])))
                    r = q.units[rows] @ c.units.T
                    order = np.argsort(r, axis=1)
                    r = np.take_along_axis(r, order, axis=1)
                    for i, row in enumerate(rows):
                        own = slice(ends[row], ends[row + 1])
                        low, high = np.searchsorted(r[i], cosine[own] - MARGIN, "left"), np.searchsorted(r[i], cosine[own] + MARGIN, "right")
                        total[own] += len(ids) - high
                        near = np.nonzero(high > low)[0]
                        if len(near):
                            n = (high - low)[near]
                            of = np.repeat(near, n)
                            col = order[i][np.repeat(low[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                            exact = _summed(q, c, np.full(len(col), row), col)
                            first = (exact > cosine[own][of]) | ((exact == cosine[own][of]) & (ids[col] < card[own][of]))
                            total[own] += np.bincount(of[first], minlength=len(low))
        for a, b, ends, total in held.values():
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(total))
            yield pa.RecordBatch.from_arrays([pa.array(a, typed[0].type), pa.array(b, typed[1].type), lists.cast(typed[2].type)], schema=typed)

    counts = _block_pairs(wanted.select("query_id", "view", "wanted", "query_vector"), cards.select("card_id", "vector"), ("query_id", "view", "wanted")).mapInArrow(count, schema)
    sums = counts.select("query_id", "view", F.posexplode("n").alias("at", "n")).groupBy("query_id", "view", "at").agg(F.sum("n").alias("n"))
    named = wanted.select("query_id", "view", F.posexplode("wanted").alias("at", "w"))
    return named.join(sums, ["query_id", "view", "at"]).select("query_id", "view", "w.card_id", "n")


def reciprocal_ranks(views: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """(query_id, view, card_id, rank): of each query's cards, all ranks of those that may be among the k best by the sum of
    1 / (60 + rank) over its views (query_id, view, query_vector).

    Of each view so many cards are ranked that one which is in none of these heads can't be among the k best. Sums have
    bounds then; the cards within reach get their places in the other views by counting what comes before them."""
    number = views.groupBy("query_id").agg(F.count("*").alias("n_views"))
    most = number.agg(F.max("n_views")).first()[0] or 1
    depth = most * (RRF_K + k) - RRF_K
    w = Window.partitionBy("query_id", "view").orderBy(F.desc("cosine"), F.asc("card_id"))
    head = best_cosines(views, cards, depth, ("query_id", "view")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
    head = stored(head.select("query_id", "view", "card_id", "rank"))
    sums = head.groupBy("query_id", "card_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("least"), F.collect_set("view").alias("known")).join(number, "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("least")))
    cut = sums.select("query_id", "least", place.alias("place")).where(F.col("place") == k).select("query_id", F.col("least").alias("cut"))
    reach = F.col("least") + (F.col("n_views") - F.size("known")) / F.lit(float(RRF_K + depth + 1))
    near = stored(sums.join(cut, "query_id", "left").where(reach >= F.coalesce("cut", F.lit(0.0)) - ROUNDING).select("query_id", "card_id", "known"))
    # a card's vector is fetched once for a query, then it meets the views that don't have its rank
    v, qv = doubles("vector"), doubles("query_vector")
    met = near.join(cards.select("card_id", "vector"), "card_id").join(views.select("query_id", "view", "query_vector"), "query_id").where(~F.array_contains("known", F.col("view")))
    cosine = dot(qv, v) / (norm(qv) * norm(v))
    lists = met.select("query_id", "view", F.struct(cosine.alias("cosine"), "card_id").alias("w")).groupBy("query_id", "view").agg(F.collect_list("w").alias("wanted"))
    wanted = stored(lists.join(views.select("query_id", "view", "query_vector"), ["query_id", "view"]))
    known = head.join(near.select("query_id", "card_id"), ["query_id", "card_id"], "left_semi").select("query_id", "view", "card_id", "rank")
    return known.union(_before(wanted, cards).select("query_id", "view", "card_id", (F.col("n") + 1).cast("int")))
