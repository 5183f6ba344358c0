"""Line dedup's words, cut for many texts at once, and its lists: pairs of short ones and postings of long ones, by both ways."""

import random
from itertools import combinations

import numpy as np

from tessera.llm import line_dedup as L


def test_words_and_lines_of_many_texts_at_once():
    texts = ["", "\n", "  Two  words, İΣ \n\n x\ty \r\n", "今天天气 很好abc我们!\nวันนี้ ok\n", "one\n" + "long" * 3000 + " end", "a" * 8 + " " + "b" * 9 + " " + "b" * 9 + "\n..\n-"]
    raw, h, counts = L.words_of("\n".join(texts))
    lines = [w for t in texts for w in L.normalised(t)]
    assert L.normalised_lines(raw).split(b"\n") == [b" ".join(w) for w in lines]
    parts = [L.UNSPACED.sub(r" \g<0> ", b" ".join(w).decode()).encode().split() for w in lines]
    assert counts.tolist() == [len(w) for w in parts]
    words = [x for w in parts for x in w]
    assert (h == L.hash_words(words)).all() and len(set(h.tolist())) == len(set(words))
    assert [len(range(9)[p]) for p in L.portions(["x" * L.PORTION, "y", "z"])] == [1, 2]


def test_lists_of_both_ways_are_whole(spark):
    r = random.Random(4)
    few, many = [101, 102, 103], [201, 202]  # keys of up to LIST lines, and of more
    rows = []
    for n in range(2 * L.LIST):
        keys = [10_000 + n] + ([few[n % 3]] if n < L.LIST else []) + [k for k in many if r.random() < 0.9]
        rows.append((n, 40, 0, r.getrandbits(20), 1 + n % 5, keys))
    distinct = spark.createDataFrame(rows, "line long, size int, s0 long, s1 long, times long, keys array<long>").coalesce(1)
    fits = lambda x, y: bin(x[3] ^ y[3]).count("1") <= 2 * (15 * 40 // 100)
    want = {(x[0], y[0]) for x, y in combinations(rows, 2) for k in few if k in x[5] and k in y[5] and fits(x, y)}
    long = sorted((k, x[0], x[4]) for x in rows for k in x[5] if k in many)
    for crowded in (L.crowded(distinct), L.crowded(distinct).where("false")):
        filled = spark.sparkContext.broadcast(L.bloom(crowded))
        posted, packed = L.postings(distinct, filled)
        near = L.close_by(packed).collect()
        assert len(posted.collect()) == (len(long) if filled.value.any() else 0)
        assert {(x.a, x.b) for x in near if x.a is not None} == want and len([x for x in near if x.a is not None]) == len(want)
        got = [(x.key, x.node, x.times) for x in near if x.a is None] + [(x.key, x.node, x.times) for x in posted.collect()]
        assert sorted(got) == long
    assert np.dtype(L.POSTING).itemsize == 44
