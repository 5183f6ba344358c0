"""Ranked lexical search with integer impact scores by the Best Position Algorithm.

Documents are read once for a block of items: each keeps its number of terms and the counts of the items' terms. Tasks
then turn runs of such rows into index segments, as search engines do: for every term a list of the segment's documents
by falling impact, and for every document its terms with their positions in those lists. An item's lists are read from
the top by turns; each new document is scored by direct access, which also marks its positions in all lists. The best
position of a list is the last of its unbroken run of seen positions from the top; the impacts there bound every unseen
document, and reading stops once their sum is strictly below the k-th score.

A first round over one document in PROBE (by hash) gives a score that k documents reach for certain; the second round,
over all documents, starts from it, so it reads less and returns little more than the k best. It drops nothing that
could be among them.

Defined cases: a null text has no terms; items without terms and documents without common terms give no rows; every
row of `items` is an item and every row of `docs` a document, repeated ids included; equal scores are ordered by doc_id,
nulls last. Other columns are not read. The items are the stated query set: they pass through the driver in blocks of
BLOCK_TERMS terms (one item at least), each with its own pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialise, release

#: Terms of the items that are searched in one pass.
BLOCK_TERMS = 1 << 16
#: Postings of a segment: some 50 MB with positions.
SEGMENT = 1 << 20
PROBE = 64
#: A text is cut into words in pieces of about this many bytes.
PIECE = 1 << 22

_TERM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_LOWER = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms in order, in lists of bounded size: runs of digits, letters and everything beyond ASCII; A-Z are lower-cased."""
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def postings(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of each document as a number, and those of `ids` with their counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get, n, terms, counts, ends = ids.get, [], [], [], [0]
        for text in batch.column(1).cast(pa.binary()):
            found: Counter = Counter()
            total = 0
            for words in terms_of(text.as_py() or b""):
                total += len(words)
                found.update(map(get, words))
            found.pop(None, None)
            n.append(total)
            terms.extend(found)
            counts.extend(found.values())
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
            ["doc_id", "n", "terms", "counts"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, terms array<int>, counts array<long>")


class Segment:
    """Impact lists of some documents, and for each document the positions of its terms in them."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, average: tuple[int, int]):
        documents, length = average
        m = 50 + (50 * n * documents) // length
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(n)), sizes)
        self.terms, self.impacts = terms, (1_000_000_000 * counts) // (1000 * counts + 20 * m[owner])
        order = np.lexsort((-self.impacts, terms))
        self.listed, self.falling = owner[order], self.impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.places = np.empty(len(terms), np.int64)
        self.places[order] = np.arange(len(terms)) - self.starts[terms[order]]

    def best(self, wanted: np.ndarray, weights: np.ndarray, k: int, reached: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (by place) and scores that are among the k best with scores of at least `reached`, ties included; and the number of documents looked at."""
        wanted = wanted[(self.starts[wanted + 1] > self.starts[wanted]) & (weights[wanted] > 0)]
        lists = [(int(self.starts[t]), int(self.starts[t + 1])) for t in wanted]
        weight = weights[wanted]
        local = np.full(len(weights), -1, np.int64)
        local[wanted] = np.arange(len(wanted))
        bases = np.concatenate([[0], np.cumsum([b - a for a, b in lists])]).astype(np.int64)
        seen, passed = np.zeros(len(self.ends) - 1, bool), np.zeros(bases[-1], bool)
        read, best = [0] * len(lists), [0] * len(lists)
        docs, scores, step = [], [], 8
        top = np.zeros(0, np.int64)
        while any(r < b - a for r, (a, b) in zip(read, lists)):
            fresh = np.unique(np.concatenate([self.listed[a + r : min(a + r + step, b)] for r, (a, b) in zip(read, lists)]))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            if len(fresh):
                score, marks = self.direct(fresh, local, weight, bases)
                passed[marks] = True
                docs.append(fresh)
                scores.append(score)
                top = np.concatenate([top, score])
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[-k:]
                if len(top) == k:
                    reached = max(reached, int(top.min()))
            bound = 0
            for i, (a, b) in enumerate(lists):
                run = passed[bases[i] + best[i] : bases[i + 1]]
                first = int(run.argmin()) if len(run) else 0
                best[i] = b - a if len(run) and run[first] else best[i] + first
                read[i] = max(min(read[i] + step, b - a), best[i])
                if best[i] < b - a:
                    bound += int(weight[i]) * int(self.falling[a + max(best[i] - 1, 0)])
            if bound < reached:
                break
            step *= 2
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        doc, score = np.concatenate(docs), np.concatenate(scores)
        keep = score >= max(reached, 1)
        return doc[keep], score[keep], len(doc)

    def direct(self, docs: np.ndarray, local: np.ndarray, weight: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents from all their terms, and the places of the passed positions."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.ends[docs] - (ends - sizes), sizes)
        which = local[self.terms[at]]
        mine = which >= 0
        which, at = which[mine], at[mine]
        gains = np.zeros(len(mine) + 1, np.int64)
        gains[1:][mine] = weight[which] * self.impacts[at]
        sums = np.cumsum(gains)
        return sums[ends] - sums[ends - sizes], bases[which] + self.places[at]


def _ordered(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~known, -scores))[:k]


def _hits(rows: DataFrame, items: list[tuple[object, np.ndarray]], kind: str, weights: np.ndarray, average: tuple[int, int], k: int, reached: list[int]) -> DataFrame:
    """(item, item_id, doc_id, score): for each task the k best of its documents for each item, from `reached` scores on."""
    item_type = _arrow_type(rows, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        kept = [(none, none.astype(bool), none)] * len(items)
        held: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            ids, known, n, sizes, terms, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = Segment(n, sizes, terms, counts, weights, average)
            for q, (_, wanted) in enumerate(items):
                old = kept[q]
                docs, scores, _ = part.best(wanted, weights, k, max(reached[q], int(old[2][-1]) if len(old[2]) == k else 0))
                if len(docs):
                    new = [np.concatenate(x) for x in zip(old, (ids[docs], known[docs], scores))]
                    kept[q] = tuple(x[_ordered(*new, k)] for x in new)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                ids, terms, counts = piece.column(0), piece.column(2), piece.column(3)
                held.append((
                    ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), piece.column(1).to_numpy(zero_copy_only=False),
                    terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False),
                ))
                size += len(held[-1][4])
                if size >= SEGMENT:
                    search()
                    size = 0
        if held:
            search()
        for q, (ids, known, scores) in enumerate(kept):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), q, np.int32)), pa.array([items[q][0]] * len(ids), item_type), pa.array(ids, mask=~known), pa.array(scores)], ["item", "item_id", "doc_id", "score"]
                )

    return rows.mapInArrow(run, f"item int, item_id {kind}, doc_id long, score long")


def _arrow_type(df: DataFrame, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], f"x {kind}").schema).field(0).type


def blocks(items: DataFrame) -> Iterator[tuple[list[tuple[object, np.ndarray]], dict[bytes, int]]]:
    """Items with the numbers of their distinct terms, and those numbers, block by block."""
    block: list[tuple[object, np.ndarray]] = []
    ids: dict[bytes, int] = {}
    for row in items.select("item_id", F.encode("text", "utf-8").alias("text")).toLocalIterator():
        words = {w for piece in terms_of(bytes(row.text or b"")) for w in piece}
        if block and len(ids) + len(words) > BLOCK_TERMS:
            yield block, ids
            block, ids = [], {}
        if words:
            block.append((row.item_id, np.array(sorted(ids.setdefault(w, len(ids)) for w in sorted(words)), np.int64)))
    if block:
        yield block, ids


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block, ids in blocks(items):
        rows = materialise(postings(docs, ids))
        total: Row = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total.terms:
            release(rows)
            break
        counted = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        weights = np.zeros(len(ids), np.int64)
        for term, df in zip(counted["term"].to_pylist(), counted["count"].to_pylist()):
            weights[term] = weight(total.documents, df)
        average = (total.documents, total.terms)
        probe = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(PROBE)) == 0)
        ranked = _hits(probe, block, kind, weights, average, k, [0] * len(block)).withColumn("rank", F.row_number().over(place))
        reached = [0] * len(block)
        for r in ranked.where(F.col("rank") == k).select("item", "score").collect():
            reached[r.item] = r.score
        ranked = _hits(rows, block, kind, weights, average, k, reached).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        best = materialise(ranked.select("item_id", "rank", "doc_id", "score"))
        release(rows)
        found = found.union(best)
    return found
