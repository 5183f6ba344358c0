"""Joins of sets by similarity: rare items first, prefixes, lengths and places as filters, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.text import content_words, sentences
from tessera.sources.sinks import stored

#: Cells in which items are counted for their order.
CELLS = 1 << 20
#: Sets and items of a block of the left side, and of the right: a block has one set at least.
LEFT, RIGHT = (1024, 1 << 17), (1024, 1 << 18)
#: Meetings of items that are counted at once, and above which an item of two blocks is a column of a matrix product.
MEETINGS, MANY = 1 << 18, 1 << 15


def classes(df: DataFrame, id_col: str, items: str) -> DataFrame:
    """(set_id, items, n_members): equal sets are one, with the smallest id of its members; empty and null sets are left out.

    Copies then cost one row each in a similarity join, not a pair each."""
    same = df.select(id_col, F.array_sort(F.array_distinct(items)).alias("items")).where(F.size("items") > 0)
    return same.groupBy("items").agg(F.min(id_col).alias("set_id"), F.count("*").alias("n_members")).select("set_id", "items", "n_members")


def _classes_of(sets: DataFrame) -> np.ndarray:
    """By cells of their hashes, how frequent items are, in steps of an eighth of a power of two: an order of fixed size."""
    cell = F.pmod(F.xxhash64("item"), F.lit(CELLS)).cast("int").alias("cell")
    got = sets.select(F.explode("items").alias("item")).groupBy(cell).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[got["cell"].to_numpy()] = 1 + np.minimum(254, 8 * np.log2(got["n"].to_numpy().astype(np.float64))).astype(np.uint8)
    return out


def _posted(sets: DataFrame, order, percent: int, s: str) -> DataFrame:
    """(id, n, at, item, s0, s1): each set under its first items in one order for all sets, those of few sets first.

    s0 and s1 are parities of its items by 128 cells: two sets differ in as many items as these differ in bits, at least."""
    kind = sets.schema["set_id"].dataType.simpleString()
    schema = f"id {kind}, n int, at int, item long, s0 long, s1 long"
    typed = to_arrow_schema(sets.sparkSession.createDataFrame([], schema).schema)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = batch.columns
            n = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = items.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            by = np.lexsort((h, order.value[h % CELLS], owner))
            at = np.arange(len(h)) - starts[owner]
            keep = at < (n - (n * percent + 99) // 100 + 1)[owner]
            u = h.view(np.uint64) >> np.uint64(40)
            bit = np.uint64(1) << (u & np.uint64(63))
            half = (u >> np.uint64(6) & np.uint64(1)).astype(bool)
            zero = np.uint64(0)
            sides = [np.bitwise_xor.reduceat(np.where(half == k, bit, zero), starts).view(np.int64) if len(h) else np.zeros(0, np.int64) for k in (False, True)]
            o = owner[keep]
            columns = [ids.take(pa.array(o)).cast(typed[0].type), *(pa.array(x.astype(np.int32)) for x in (n[o], at[keep])), *(pa.array(x) for x in (h[by][keep], sides[0][o], sides[1][o]))]
            yield pa.RecordBatch.from_arrays(columns, schema=typed)

    hashed = sets.where(F.size("items") > 0).select("set_id", F.transform("items", lambda x: F.xxhash64(x)).alias("items"))
    return hashed.mapInArrow(post, schema).toDF(*[f"{s}_{c}" if c != "item" else c for c in ("id", "n", "at", "item", "s0", "s1")])


def _packed(sets: DataFrame, limits: tuple[int, int], s: str) -> DataFrame:
    """(ids, n, items, own): blocks of sets: their sizes, and their items in ascending order, each with its set's place."""
    kind = sets.schema["set_id"].dataType.simpleString()
    schema = f"{s}_ids array<{kind}>, {s}_n binary, {s}_items binary, {s}_own binary"
    typed = to_arrow_schema(sets.sparkSession.createDataFrame([], schema).schema)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p.column(0) for p in parts])
        n = np.concatenate([p.column(1).value_lengths().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        items = np.concatenate([p.column(1).flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        by = np.argsort(items, kind="stable")
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (n, items[by], np.repeat(np.arange(len(n), dtype=np.int32), n)[by])]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids).cast(typed[0].type), *binary], schema=typed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, items = [], 0, 0
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                fit = min(int(np.searchsorted(ends, before + limits[1] - items, "right")), at + limits[0] - rows)
                if fit <= at and held:
                    yield block(held)
                    held, rows, items = [], 0, 0
                    continue
                to = max(at + 1, fit)
                held.append(batch.slice(at, to - at))
                rows, items, at = rows + to - at, items + int(ends[to - 1] - before), to
        if held:
            yield block(held)

    return sets.where(F.size("items") > 0).select("set_id", F.transform("items", lambda x: F.xxhash64(x)).alias("items")).mapInArrow(pack, schema)


def _common(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many items each two sets of two blocks (sizes, items, places) have in common."""
    (xn, xi, xo), (yn, yi, yo) = x, y
    first, last = np.searchsorted(yi, xi, "left"), np.searchsorted(yi, xi, "right")
    met = np.nonzero(last > first)[0]
    xi, xo, first, n = xi[met], xo[met], first[met], (last - first)[met]
    out = np.zeros(len(xn) * len(yn), np.int64)
    new = np.ones(len(xi), bool)
    new[1:] = xi[1:] != xi[:-1]
    item = np.cumsum(new) - 1
    heads = np.nonzero(new)[0]
    often = np.nonzero(np.diff(np.append(heads, len(xi))) * n[heads] > MANY)[0]
    for at in range(0, len(often), 256):  # an item that many sets of both have is a column of ones and noughts
        part = often[at : at + 256]
        a, b = np.zeros((len(xn), len(part)), np.float32), np.zeros((len(part), len(yn)), np.float32)
        for k, h in enumerate(part):
            from_, to = heads[h], heads[h + 1] if h + 1 < len(heads) else len(xi)
            a[xo[from_:to], k] = 1
            b[k, yo[first[from_] : first[from_] + n[from_]]] = 1
        out += (a @ b).astype(np.int64).ravel()
    few = np.ones(len(heads), bool)
    few[often] = False
    few = few[item]
    xo, first, n = xo[few].astype(np.int64), first[few], n[few]
    ends, at = np.cumsum(n), 0
    while at < len(n):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + MEETINGS, "right")))
        m = n[at:to]
        place = np.arange(ends[to - 1] - before) + np.repeat(first[at:to] - (ends[at:to] - m - before), m)
        out += np.bincount(np.repeat(xo[at:to] * len(yn), m) + yo[place], minlength=len(out))
        at = to
    return out.reshape(len(xn), len(yn))


def _near(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(left_id, right_id, common, total): similar pairs and the sum of their sizes, counted in blocks of both sides: no row, and no
    item shuffled, for what isn't similar."""
    kinds = [df.schema["set_id"].dataType.simpleString() for df in (left, right)]
    schema = f"left_id {kinds[0]}, right_id {kinds[1]}, common long, total long"
    typed = to_arrow_schema(left.sparkSession.createDataFrame([], schema).schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                xi, *x, yi, yn, yt, yo = (c[at] for c in batch.columns)
                x, y = (tuple(np.frombuffer(v.as_buffer(), kind) for v, kind in zip(side, (np.int64, np.int64, np.int32))) for side in (x, (yn, yt, yo)))
                common = _common(x, y)
                row, col = np.nonzero((100 + percent) * common >= percent * (x[0][:, None] + y[0][None, :]))
                c, total = common[row, col], x[0][row] + y[0][col]
                yield pa.RecordBatch.from_arrays([*(v.values.take(pa.array(k)).cast(t.type) for v, k, t in zip((xi, yi), (row, col), typed)), pa.array(c), pa.array(total)], schema=typed)
            del batch, xi, x, yi, y, yn, yt, yo, common
            pa.default_memory_pool().release_unused()

    parts = left.sparkSession.sparkContext.defaultParallelism
    x, y = _packed(left.repartition(max(1, parts // 4)), LEFT, "x"), _packed(right.repartition(parts), RIGHT, "y")
    return y.crossJoin(x).select(*x.columns, *y.columns).mapInArrow(compare, schema)  # of blocks: a stated query set


def similar(left: DataFrame, right: DataFrame, percent: int = 60, large: bool = False) -> DataFrame:
    """(left_id, right_id, common, jaccard) of sets (set_id, items) with a Jaccard similarity of `percent` or more.

    Two such sets share an item among the first n - ceil(percent n / 100) + 1 of either, in any one order; in the order
    of frequency (of cells of fixed number) these are rare, so lists under an item stay short. What meets there has to fit
    by size, by how many items can still be common after it and by parities of the items; each pair is verified once on
    whole sets. Items have to be distinct within a set, and equal sets of a side one row (see classes). For `large` sets, of which
    most would meet under some item, common items are counted in blocks of both sides."""
    if large:
        return _near(left, right, percent).select("left_id", "right_id", "common", F.round(F.col("common") / (F.col("total") - F.col("common")), 6).alias("jaccard"))
    order = left.sparkSession.sparkContext.broadcast(_classes_of(right))
    x, y = (_posted(sets, order, percent, s) for sets, s in ((left, "x"), (right, "y")))
    most = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    total = F.col("x_n") + F.col("y_n")
    apart = F.bit_count(F.col("x_s0").bitwiseXOR(F.col("y_s0"))) + F.bit_count(F.col("x_s1").bitwiseXOR(F.col("y_s1")))
    fits = (100 * most >= percent * (total - most)) & ((100 + percent) * (total - apart) >= 2 * percent * total)
    return _verified(x.join(y, "item").where(fits).select("x_id", "y_id").distinct(), left, right, percent)


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """`similar` of pairs (x_id, y_id) of sets, by their items."""
    hashes = F.transform("items", lambda i: F.xxhash64(i))
    x, y = left.select(F.col("set_id").alias("x_id"), hashes.alias("xi")), right.select(F.col("set_id").alias("y_id"), hashes.alias("yi"))
    both = pairs.join(x, "x_id").join(y, "y_id").withColumn("common", F.size(F.array_intersect("xi", "yi")).cast("long"))
    union = F.size("xi") + F.size("yi") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select(F.col("x_id").alias("left_id"), F.col("y_id").alias("right_id"), "common", F.round(F.col("common") / union, 6).alias("jaccard"))


def retellings(details: DataFrame, cards: DataFrame, id_col: str, text: str, percent: int = 60) -> DataFrame:
    """(id, at, n_sets, n_sentences, nearest): sentences of `details` that retell others of `cards`: how many word sets and
    sentences are like it, and the largest similarity. Sentences with the very same words, its own among them, count too."""

    def split(df: DataFrame) -> DataFrame:
        s = df.select(id_col, F.posexplode(sentences(text)).alias("at", "s"))
        words = F.transform(content_words("s"), lambda w: F.xxhash64(w))
        return s.select(F.struct(id_col, "at").alias("place"), F.array_sort(words).alias("items")).where(F.size("items") > 0)

    mine = split(details)
    x, y = stored(classes(mine, "place", "items")), stored(classes(split(cards), "place", "items"))
    found = similar(x, y, percent).join(y.select(F.col("set_id").alias("right_id"), "n_members"), "right_id")
    per = found.groupBy("left_id").agg(F.count("*").alias("n_sets"), F.sum("n_members").alias("n_sentences"), F.max("jaccard").alias("nearest"))
    known = x.select(F.col("set_id").alias("left_id"), "items").join(per, "left_id").drop("left_id")
    return mine.join(known, "items").select(f"place.{id_col}", "place.at", "n_sets", "n_sentences", "nearest")
