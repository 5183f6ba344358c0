import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import conversation_repair as cr
from tessera.llm import queries

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """Counts and all edits of one conversation's ordered rows, by a shortest path through rows and states of the grammar."""
    seen, counts, kinds = set(), [0, 0, 0], []
    for _, _, role, text in rows:
        letters = BLANK.findall(text)
        fault = 0 if not letters else 1 if (role, text) in seen else 2 if letters[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(fault)
        if fault is not None:
            counts[fault] += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    ways = {("", 0, 0): {(0, "", ())}}  # state, rows read, inserts since the last row: all audits, without any pruning by their text
    best = set()
    for i in range(len(rows) + 1):
        for ins in range(3):
            for state in ("", "s", "u", "a"):
                for cost, audit, said in ways.get((state, i, ins), ()):
                    if i == len(rows) and state in ("", "a"):
                        best.add((cost, audit, said))
                    moves = [(state, i, ins + 1, 3, "I", n, (f"{n}:",)) for n in ("user", "assistant")] if ins < 2 else []
                    if i < len(rows):
                        role, text = rows[i][2:]
                        extra = 3 if kinds[i] == 2 else 0
                        moves.append((state, i + 1, 0, 4, "D", None, ()))
                        if kinds[i] not in (0, 1):
                            moves.append((state, i + 1, 0, extra, "K", role, (f"{role}:{text}",)))
                            moves += [(state, i + 1, 0, 3 + extra, "R", n, (f"{n}:{text}",)) for n in ("user", "assistant")]
                    for s, at, k, more, letter, spoken, line in moves:
                        if spoken is not None:
                            s = step.get((state, spoken[:1]))
                            if s is None:
                                continue
                        ways.setdefault((s, at, k), set()).add((cost + more, audit + letter, said + line))
    cost, audit, said = min(best)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    return {c: plain(sorted(g, key=lambda r: (r[1] is not None, r[1] or 0))) for c, g in groups.items()}


SCHEMA = "conv_id long, turn long, role string, text string, copies int, h1 string"


def made(seed):
    r = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 5)):
            role = r.choice(["user", "assistant", "system", "tool", None, ""]) if r.random() < 0.4 else ["user", "assistant"][t % 2]
            text = r.choice(["Hi.", "Yes!", "No", "why? ", " \n", "", None, "ok.\t"]) if r.random() < 0.4 else f"line {t} of {c}{r.choice(['.', '.', ''])}"
            rows.append((c if c else None, (t + (t > 2) * 2) if t else None, role, text, 5, "x"))
    return rows


@pytest.mark.parametrize("seed,chunk,parts", [(1, 32, 3), (2, 1, 5), (3, 2, 7)])
def test_equals_all_edits(spark, seed, chunk, parts, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    rows = made(seed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r[0]: tuple(r)[1:] for r in cr.repaired(cr.damage(spark.createDataFrame(rows, SCHEMA))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = expected([r[:4] for r in rows])
    assert got == want


def test_long_conversation_in_chunks(spark, monkeypatch):
    """The same rows as one alignment and as chunks over many partitions."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "system"]) if r.random() < 0.3 else ["user", "assistant"][t % 2], f"t{t}" + r.choice([".", "", "!"]), 1, "") for t in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    chunked = cr.repaired(cr.damage(frame)).collect()
    monkeypatch.setattr(cr, "CHUNK", 1000)
    ordered = sorted(plain_damage([x[:4] for x in rows]), key=lambda x: x[1])
    seen, kinds = set(), []
    for _, _, role, text in ordered:
        dead = not BLANK.search(text) or (role, text) in seen
        seen.add((role, text))
        kinds.append(None if dead else (role[:1], 0 if text[-1] in ".!?" else 3))
    assert len(chunked) == 1 and (chunked[0].cost, chunked[0].audit) == cr.repair(kinds)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repaired(cr.damage(empty)).collect() == []
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = cr.repaired(cr.damage(spark.createDataFrame([(gone, 0, "user", "x" * 100_000, 1, "")], SCHEMA))).collect()
    assert tuple(lost[0]) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    twice = spark.createDataFrame([(7, 1, "user", "a.", 1, ""), (7, 1, "user", "a.", 1, ""), (7, 2, "assistant", "b." * 50_000, 1, "")], SCHEMA)
    one = cr.repaired(cr.intact(twice), with_text=True).collect()[0]
    assert (one.duplicate, one.audit, one.cost, one.repaired) == (1, "KDK", 4, ["user:a.", "assistant:" + "b." * 50_000])


def test_query_on_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected([r for r in rows if sum(x[0] == r[0] for x in rows) <= 5])
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, sf).collect()}
    assert len(got) == len({r[0] for r in rows}) and want and all(got[c] == w for c, w in want.items())
