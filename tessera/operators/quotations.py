"""Search of quotations in a corpus of texts by the hashes of their letters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.text import collapse, fold

#: Letters whose windows are hashed at once.
PART = 1 << 18
#: Lengths at which windows are looked at first: of a quotation, the longest of these that it has.
PREFIXES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 24)
#: Bits of a filter, as a power of two: 16 MB, whatever it is made from.
BITS = 27
#: Quotations that a task counts before it passes them on.
HELD = 1 << 16
BASE = 0x9E3779B97F4A7C15


def normalised(text: str) -> Column:
    """Lower case, without quotation marks, words one space apart."""
    return collapse(F.regexp_replace(fold(text), "[«»\"]", ""))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2 ** 64, from 0 on."""
    return tuple(np.cumprod(np.array([1] + [x] * n, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


class _Windows:
    """Hashes of the windows of some letters: differences of running sums."""

    def __init__(self, letters: str):
        codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        room = 1 << len(codes).bit_length()
        power, self.back = _powers(room)
        self.n = len(codes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes * np.uint64(BASE)) * power[: self.n])])

    def first(self, n: int, length: int) -> np.ndarray:
        """Of the windows that begin at the first n letters."""
        n = max(0, min(n, self.n - length + 1))
        return _mixed((self.sums[length : length + n] - self.sums[:n]) * self.back[:n] + np.uint64(length))

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[places + length] - self.sums[places]) * self.back[places] + np.uint64(length) << np.uint64(1))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64((1 << BITS) - 1), h >> np.uint64(64 - BITS)


def _held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of hashes that pass a filter."""
    a, b = _bits(h)
    at = np.nonzero((table[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1)[0]
    b = b[at]
    return at[((table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1) == 1]


def _prefix(length: int) -> int:
    return max(p for p in PREFIXES if p <= length)


def _filters(quotes: DataFrame) -> tuple[dict[int, list[int]], list[np.ndarray]]:
    """The lengths of quotations (q) by prefix, and filters of the prefixes and the whole ones.

    They only save work: what passes is joined exactly, and a filter that is too full lets all pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds: list[list[np.ndarray]] = [[], []]
            for q in batch.column(0).to_pylist():
                w = _Windows(q)
                kinds[0].append(w.first(1, _prefix(len(q))))
                kinds[1].append(w.at(np.zeros(1, np.int64), len(q)))
            for kind, found in enumerate(kinds):
                at = np.unique(np.concatenate([x for h in found for x in _bits(h)])) if found else np.zeros(0, np.uint64)
                bit = np.left_shift(1, (at & np.uint64(7)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array((at >> np.uint64(3)).astype(np.int32)), pa.array(bit.astype(np.int32))], ["kind", "place", "bit"])

    lengths: dict[int, list[int]] = {}
    for r in quotes.select(F.length("q").alias("n")).distinct().orderBy("n").collect():  # a few dozen
        lengths.setdefault(_prefix(r.n), []).append(r.n)
    got = quotes.select("q").mapInArrow(run, "kind int, place int, bit int").groupBy("kind", "place").agg(F.bit_or("bit").alias("bit")).toArrow()
    kind, place, bit = (got[c].to_numpy() for c in ("kind", "place", "bit"))
    tables = []
    for k in range(2):
        table = np.zeros(1 << (BITS - 3), np.uint8)
        table[place[kind == k]] = bit[kind == k].astype(np.uint8)
        tables.append(table)
    return lengths, tables


def _grams(texts: list[str], lengths: dict[int, list[int]], filters: list[np.ndarray]) -> list[set[str]]:
    """Of each text, the parts that pass the filters, each once."""
    out: list[set[str]] = [set() for _ in texts]
    whole, ends = "".join(texts), np.cumsum([len(t) for t in texts])
    most = max(map(max, lengths.values()))
    for start in range(0, len(whole), PART):
        part = whole[start : start + PART + most - 1]
        w = _Windows(part)
        for prefix, own in lengths.items():
            hit = _held(filters[0], w.first(min(PART, len(whole) - start), prefix))
            for n in own:
                at = hit[hit + n <= w.n]
                at = at[_held(filters[1], w.at(at, n))]
                owner = np.searchsorted(ends, at + start, "right")
                inside = at + start + n <= ends[owner]
                for p, o in zip(at[inside].tolist(), owner[inside].tolist()):
                    out[o].add(part[p : p + n])
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about PART bytes, a row at the least."""
    for batch in batches:
        step = max(1, batch.num_rows * PART // max(batch.nbytes, PART))
        for at in range(0, batch.num_rows, step):
            ids, texts = (c.to_pylist() for c in batch.slice(at, step).columns)
            yield ids, texts


def _searched(quotes: DataFrame, texts: DataFrame, id_col: str) -> tuple[DataFrame, object] | None:
    """The texts (id, normalised text) and what their parts are held against; None without quotations."""
    lengths, tables = _filters(quotes)
    if not lengths:
        return None
    rows = texts.select(id_col, normalised("text").alias("text")).where("text <> ''")
    return rows, quotes.sparkSession.sparkContext.broadcast((lengths, tables))


def quote_counts(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote, n_texts, first_text): how many of the texts (doc_id, text) hold each quotation (quote), and the smallest id.

    Quotations are normalised already; each is counted once. Every window of a text that may be a quotation is hashed and held
    against filters of fixed size; what passes is counted in the task, so a part that stands in many texts costs a row for each
    task, and nothing is shuffled but parts of texts that are found."""
    q = quotes.select(F.col("quote").alias("q")).where("q <> ''").distinct()
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"q string, n_texts long, first_text {kind}"
    typed = to_arrow_schema(quotes.sparkSession.createDataFrame([], schema).schema)
    made = _searched(q, texts, "doc_id")
    if made is None:
        return quotes.sparkSession.createDataFrame([], schema).withColumnRenamed("q", "quote")
    rows, shared = made

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def passed() -> pa.RecordBatch:
            out = [pa.array(list(held), pa.string()), *(pa.array([x[k] for x in held.values()], typed[k + 1].type) for k in range(2))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, schema=typed)

        for ids, parts in _pieces(batches):
            for i, grams in zip(ids, _grams(parts, *shared.value)):
                for g in grams:
                    if (x := held.get(g)) is None:
                        held[g] = [1, i]
                    else:
                        x[0] += 1
                        if i is not None and (x[1] is None or i < x[1]):
                            x[1] = i
            if len(held) >= HELD:
                yield passed()
        yield passed()

    per = rows.mapInArrow(count, schema).groupBy("q").agg(F.sum("n_texts").alias("n_texts"), F.min("first_text").alias("first_text"))
    return per.join(q, "q").select(F.col("q").alias("quote"), "n_texts", "first_text")


def quote_sources(quotes: DataFrame, texts: DataFrame, letters: int = 80) -> DataFrame:
    """(quote_id, path): texts that hold a quotation's first `letters` letters, both normalised.

    Every window of a text that may be a quotation is held against filters of fixed size; what passes, once a text, is
    joined with the quotations. Blank and null quotations are in no text; rows that repeat a path are further texts of it."""
    named = quotes.select("quote_id", F.substring(normalised("quote"), 1, letters).alias("q")).where("q <> ''")
    kind = texts.schema["path"].dataType.simpleString()
    schema = f"path {kind}, q string"
    typed = to_arrow_schema(quotes.sparkSession.createDataFrame([], schema).schema)
    made = _searched(named.select("q").distinct(), texts.where("path IS NOT NULL"), "path")
    if made is None:
        return named.join(quotes.sparkSession.createDataFrame([], schema), "q").select("quote_id", "path")
    rows, shared = made

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, parts in _pieces(batches):
            found = [(i, g) for i, grams in zip(ids, _grams(parts, *shared.value)) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], typed[k].type) for k in range(2)], schema=typed)

    return rows.mapInArrow(search, schema).join(named, "q").select("quote_id", "path").distinct()
