"""Detectors over large lists of phrases: one automaton for all of them, one pass over each text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Letters of phrases that one automaton holds, some 100 bytes each in a worker; longer lists take several passes.
LETTERS = 1 << 20


@lru_cache(maxsize=2)
def _automaton(phrases: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


def _blocks(phrases: DataFrame) -> Iterator[tuple[str, ...]]:
    """The distinct phrases in parts of up to LETTERS letters."""
    block, size = [], 0
    for r in phrases.select(F.lower("phrase").alias("p")).where("p <> ''").distinct().orderBy("p").toLocalIterator():
        if block and size + len(r.p) > LETTERS:
            yield tuple(block)
            block, size = [], 0
        block.append(r.p)
        size += len(r.p)
    if block:
        yield tuple(block)


def _inside(text: str, start: int, end: int) -> bool:
    """Whether a match begins or ends within a word."""
    word = lambda c: c.isalnum() or c == "_"
    return (start > 0 and word(text[start - 1]) and word(text[start])) or (end < len(text) and word(text[end]) and word(text[end - 1]))


def _apart(hits: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str]]:
    """Of each phrase's hits, in the order of their ends, those that begin after the last one taken."""
    last: dict[str, int] = {}
    for end, p in hits:
        if end - len(p) >= last.get(p, -1):
            last[p] = end
            yield end, p


def phrase_hits(docs: DataFrame, id_col: str, text_col: str, phrases: DataFrame, whole_words: bool = False, apart: bool = False) -> DataFrame:
    """(id, phrase, n): the phrases (phrase) that stand in each text, ignoring case, and how often, overlaps included.

    The list goes to the tasks as automata (Aho and Corasick) of bounded size, each read in one pass over the texts; a
    text's time depends on its length and hits, not on the number of phrases. With `whole_words`, a phrase may not begin or
    end inside a word; with `apart`, n counts occurrences that don't overlap, from the left. Null texts and blank phrases have no hits; each row of `docs` is a text."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, phrase string, n long"
    typed = to_arrow_schema(spark.createDataFrame([], schema).schema)
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.lower(text_col))
    found = spark.createDataFrame([], schema)
    for block in _blocks(phrases):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value)
            for batch in batches:
                ids, names, counts = [], [], []
                for i, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    hits = automaton.iter(text)
                    if whole_words:
                        hits = ((end, p) for end, p in hits if not _inside(text, end + 1 - len(p), end + 1))
                    n = Counter(p for _, p in (_apart(hits) if apart else hits))
                    ids += [i.as_py()] * len(n)
                    names += n
                    counts += n.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, typed[0].type), pa.array(names, pa.string()), pa.array(counts, pa.int64())], schema=typed)

        found = found.union(texts.mapInArrow(scan, schema))
    return found
