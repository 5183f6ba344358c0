"""Long lists of lines that share a key: compared in blocks, without a row for each pair."""

import random

import pytest

from tessera.llm import line_dedup


@pytest.mark.parametrize("block", [512, 16])
def test_only_links_become_rows(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    lines = []
    for _ in range(8):
        base = r.sample(words, 8)
        for _ in range(12):
            w = list(base)
            at = r.randrange(8)
            w[at] = w[at][:-1] + r.choice("pqrs")
            lines.append(" ".join(w))
    lines = sorted(set(lines))
    sketch = line_dedup.counts_of(lines).tolist()
    rows = [(k, n, len(x), *sketch[n], n, False, [7, 9], x) for n, x in enumerate(lines) for k in (7, 9)]
    schema = "key long, node long, size int, s0 long, s1 long, part long, top boolean, keys array<long>, whole string"
    members = spark.createDataFrame(rows, schema).selectExpr("*", f"{len(lines)}L AS c")
    got = [(x.a, x.b) for x in line_dedup.linked(members).collect()]

    def components(pairs):
        part = list(range(len(lines)))
        for a, b in pairs:
            old, new = part[a], part[b]
            part = [new if p == old else p for p in part]
        return {frozenset(i for i, p in enumerate(part) if p == q) for q in part}

    pairs = [(a, b) for b in range(len(lines)) for a in range(b) if line_dedup.alike(lines[a], lines[b])]
    assert components(got) == components(pairs) and all(line_dedup.alike(lines[a], lines[b]) for a, b in got)
    assert len(pairs) > 3 * len(lines)
    if block > len(lines):
        assert len(got) == len(lines) - len(components(pairs))  # neither a row for each pair, nor one for each list
    near = [x.line for x in line_dedup.near_nodes(members).collect()]
    assert len(near) == len(set(near)) and {n for p in pairs for n in p} <= set(near)
