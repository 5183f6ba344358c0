"""Benchmark passages in documents, by spaced seeds that tolerate substituted words.

Words are runs of letters, digits and other characters than ASCII signs and white space, lower-cased. Fixed
masks name the places of a window that are hashed; the others are ignored. Two masks of six places are enough
for every window of 13 words with two substitutions to keep one seed whole. Seeds of the benchmark and of the
documents are joined; around each hit the two texts are laid over each other, and an item is found in a
document if some window of 13 aligned words has 11 equal ones at least.

Before the join, document seeds are held against a Bloom filter of fixed size, so that only documents with
seeds of the benchmark, and those seeds, are shuffled; the filter only saves work and decides nothing.

Items of 8 to 12 words must fit as a whole with one substitution at most, those of 5 to 7 as a whole without;
both are sought by runs of four words. Items of fewer words are found in no document: they would be everywhere.

Defined cases: null and empty texts and items hold nothing; repeated rows give one row each pair of ids; items
with a null id count as one item without an id, documents likewise, but `clean` tells their texts apart; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, bloom, materialise, may_hold
from tessera.llm.shingles import hash_words, windows

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8))
SHORT_MASK = (0, 1, 2, 3)
SHORTEST = 5
APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(APART).split()
    return hash_words(words)


def rule(n: int) -> tuple[int, int] | None:
    """Window and allowed substitutions for an item of n words."""
    if n >= WINDOW:
        return WINDOW, SUBSTITUTIONS
    return (n, int(n >= 8)) if n >= SHORTEST else None


def best(a: np.ndarray, b: np.ndarray, window: int) -> tuple[int, int]:
    """Most equal words in a window of two aligned sequences, and where the first such window begins."""
    if len(a) < window:
        return 0, 0
    equal = np.concatenate([[0], np.cumsum(a == b)])
    per = equal[window:] - equal[:-window]
    return int(per.max()), int(per.argmax())


def item_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, seed, item_at): seeds of all items that are long enough, with the item's word hashes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = word_hashes(text)
            if rule(len(h)):
                masks = enumerate(MASKS) if len(h) >= WINDOW else [(len(MASKS), SHORT_MASK)]
                words = h.view(np.int64).tolist()
                rows += [(item, words, s, at) for k, m in masks for at, s in enumerate(windows(h, m, k + 1).view(np.int64).tolist())]
        if rows:
            item, words, s, at = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, batch.column(0).type), pa.array(words, pa.list_(pa.int64())), pa.array(s, pa.int64()), pa.array(at, pa.int32())],
                ["item_id", "words", "seed", "item_at"],
            )

    kind = items.schema[id_col].dataType.simpleString()
    return arrow_map(items.select(id_col, text_col).distinct(), run, f"item_id {kind}, words array<long>, seed long, item_at int")


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, matched, window, doc_word): one row for each document and item found in it.

    `matched` of `window` aligned words are equal in the best window, which begins at word `doc_word`."""
    known = materialise(item_seeds(items, item_col, item_text))
    bits = docs.sparkSession.sparkContext.broadcast(bloom(known.select("seed")))
    short = known.where(F.size("words") < WINDOW).limit(1).count() > 0

    def hits(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text, rid in zip(*(c.to_pylist() for c in batch.columns)):
            h = word_hashes(text)
            found_at, found = [], []
            for k, m in [*enumerate(MASKS), *([(len(MASKS), SHORT_MASK)] if short else [])]:
                s = windows(h, m, k + 1)
                at = may_hold(bits.value, s)
                found_at += at.tolist()
                found += s[at].view(np.int64).tolist()
            if found:
                rows.append((doc, rid, text, found, found_at))
        if rows:
            doc, rid, text, found, at = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.column(0).type), pa.array(rid, pa.int64()), pa.array(text, pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "text", "seeds", "places"],
            )

    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    near = materialise(arrow_map(docs.select(id_col, text_col, F.xxhash64(text_col)), hits, f"doc_id {kind}, text_hash long, text string, seeds array<long>, places array<int>", pieces=True))
    each = near.select("doc_id", "text_hash", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select(
        "doc_id", "text_hash", F.col("x.seeds").alias("seed"), F.col("x.places").alias("doc_at")
    )
    # the ways in which each item lies over a document, as distinct shifts; its words are joined once
    laid = each.join(known.select("seed", "item_id", "item_at"), "seed").groupBy("doc_id", "text_hash", "item_id").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts"))
    words = known.select("item_id", "words").distinct()
    laid = laid.alias("l").join(words.alias("w"), F.expr("l.item_id <=> w.item_id")).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("l.item_id", "shifts", "words")).alias("laid")
    )
    texts = near.select("doc_id", "text_hash", "text").distinct()
    both = texts.alias("t").join(laid.alias("l"), F.expr("t.doc_id <=> l.doc_id AND t.text_hash = l.text_hash")).select("t.doc_id", "t.text_hash", "text", "laid")

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, rid, text, laid in zip(*(c.to_pylist() for c in batch.columns)):
            h, top = word_hashes(text), {}
            for x in laid:
                item = np.array(x["words"], np.int64).view(np.uint64)
                window, allowed = rule(len(item))
                for shift in x["shifts"]:
                    low, high = max(0, shift), min(len(h), shift + len(item))
                    matched, at = best(h[low:high], item[low - shift : high - shift], window)
                    if matched >= window - allowed:
                        mine = (matched, -(low + at), window)
                        top[x["item_id"]] = max(mine, top.get(x["item_id"], mine))
            rows += [(doc, rid, item, matched, window, -at) for item, (matched, at, window) in top.items()]
        if rows:
            kinds = (batch.column(0).type, pa.int64(), batch.column(3).type.value_type.field(0).type, pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [id_col, "text_hash", item_col, "matched", "window", "doc_word"])

    out = arrow_map(both, verify, f"{id_col} {kind}, text_hash long, {item_col} {item_kind}, matched int, window int, doc_word int", pieces=True)
    return out


def pairs(found: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row for each pair of ids, also where documents share an id: the best window, the earliest of equals."""
    top = F.max(F.struct("matched", "window", -F.col("doc_word"))).alias("top")
    return found.groupBy(id_col, item_col).agg(top).select(id_col, item_col, "top.matched", "top.window", (-F.col("top.col3")).alias("doc_word"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """`docs` without the rows whose id and text were found to hold an item; rows without an id go by their own texts."""
    found = find(docs, items, id_col, text_col, **names).select(F.col(id_col).alias("_found"), F.col("text_hash").alias("_found_text")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_found"]) & (F.xxhash64(docs[text_col]) == found["_found_text"]), "left_anti")
