import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import lexical_search as ls
from tessera.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [b for b in bags if b[1]]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        terms, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * bag[w]) // (1000 * bag[w] + 20 * m)) for w in terms if bag[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def made(seed, size):
    r = random.Random(seed)
    words = [f"w{j}" for j in range(60)] + ["Ünder", "ÉTÉ", "naïve", "x_y"]
    docs = [(i, " ".join(r.choice(words[: r.choice([5, 20, 64])]) for _ in range(r.choice([1, 3, 12, 80])))) for i in range(size)]
    docs += [(3, "w1 w2 w2"), (None, "w1 w2 w2"), (None, None), (9000, ""), (9001, "?! ,"), (9002, "w7 " * 3000), (3, "w1 w2 w2")]
    items = [(j, " ".join(r.choice(words) for _ in range(r.choice([1, 4, 20])))) for j in range(12)]
    return docs, items + [(90, None), (91, ""), (92, "unheard of"), (None, "W1 w1 W2"), (5, "w3 w4"), (93, "ÉTÉ été")]


@pytest.mark.parametrize("segment,block,probe,k", [(1 << 20, 1 << 16, 64, 50), (200, 9, 2, 3), (1, 1, 1, 7)])
def test_equals_full_scores(spark, monkeypatch, segment, block, probe, k):
    monkeypatch.setattr(ls, "SEGMENT", segment)
    monkeypatch.setattr(ls, "BLOCK_TERMS", block)
    monkeypatch.setattr(ls, "PROBE", probe)
    monkeypatch.setattr(ls, "PIECE", 40)
    docs, items = made(k, 150)
    items = items if block > 1 else items[-6:]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, terms int").repartition(3)
    got = ls.search(frame, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"), k).collect()
    assert sorted(map(tuple, got), key=repr) == plain(docs, items, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(docs, items).collect() == [] and ls.search(items.toDF("doc_id", "text"), items.limit(0)).collect() == []
    assert ls.search(spark.createDataFrame([(1, None), (2, "  ")], "doc_id long, text string"), items).collect() == []


def test_reading_stops_early():
    """Ten documents hold a rare term: the common term's list of 20,000 isn't read to its end."""
    n = np.full(20_000, 10, np.int64)
    sizes = np.full(20_000, 1, np.int64)
    sizes[:10] = 2
    terms = np.zeros(20_010, np.int64)
    terms[1:20:2] = 1
    part = ls.Segment(n, sizes, terms, np.ones(20_010, np.int64) + np.arange(20_010) % 2, np.array([1, 9000]), (20_000, 200_000))
    docs, scores, looked = part.best(np.array([0, 1]), np.array([1, 9000]), 10, 0)
    assert sorted(docs) == list(range(10)) and looked < 500


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.sql(queries.ORACLE_SQL["op12_lexical_search"]).df()
    mine = queries.QUERIES["op12_lexical_search"](spark, sf).toPandas()
    assert list(mine.columns) == list(theirs.columns) and sorted(map(tuple, mine.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))
