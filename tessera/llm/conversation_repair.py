"""Conversation structure repair: turns aligned to the alternating grammar `(s?(ua)+)?` at the least cost.

A conversation's rows are aligned to each feasible length of the grammar's string (Wagner-Fischer), inside the band
that the cost of the best alignment so far leaves open (Ukkonen). Audits of equally cheap alignments are read from
the tables and compared; the ASCII-least is kept.

A long conversation isn't collected. Rows are dealt by ranges of (conversation, turn), so one may lie in several
partitions; every CHUNK rows are aligned to the grammar's strings between each two states of it (nothing, after s,
after u, after a), and chunks are joined by their costs. That is exact: inserts stand before a row of their chunk, so
each audit of a chunk ends with a row's letter, none is a prefix of another, and the least audit of the whole is made
of least audits of its parts.

Defined cases: a null role or text is one space; null turns come first; rows of one turn are ordered by role, then by a
hash of the text; rows with a null conv_id are one conversation; repeated rows are duplicates; conversations that
lost every row have zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other columns are
not read. A conversation's audit is one cell of the result, and SHA-256 runs over its text in order: one task reads
the texts of a conversation as a stream, with only the audit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a conversation that are aligned together.
CHUNK = 32
#: States of the grammar: nothing yet, after s, after u, after a. For each, the strings that lead on from it and the state after a prefix.
STARTS = {0: ("", "s"), 1: ("",), 2: ("",), 3: ("",)}
#: Inserts that a conversation needs at its end.
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
SPACE = " \t\n\x0b\x0c\r"
INITIALS = ("su", "ua", "au")

Row = tuple[str, int] | None  # initial and added cost of a row that may stay; None for one that has to go


def target(state: int, head: str, length: int) -> str:
    """The string of `length` roles that leads on from `state`."""
    pair = "au" if state == 2 else "ua"
    return (head + pair * (length // 2 + 1))[:length]


def after(state: int, string: str) -> int:
    return " sua".index(string[-1]) if string else state


def band(rows: int, length: int, limit: int) -> tuple[int, int]:
    """The least and the largest j - i on a path of at most `limit`: drift costs inserts or deletes, and so does the way back."""
    delta = length - rows

    def least(d: int) -> int:
        back = delta - d
        return max(INSERT * d, -DELETE * d) + max(INSERT * back, -DELETE * back)

    low, high = min(0, delta), max(0, delta)
    while low > -rows and least(low - 1) <= limit:
        low -= 1
    while high < length and least(high + 1) <= limit:
        high += 1
    return low, high


def align(rows: list[tuple[str, int]], string: str, limit: int, closing: bool) -> tuple[list[list[int]], int] | None:
    """Costs from each place (row, role) to the end, inside the band; None if all of it costs more than `limit`.

    Without `closing` nothing is inserted after the last row."""
    m, n, none = len(rows), len(string), limit + 1
    low, high = band(m, n, limit)
    width = high - low + 1
    table = [[]] * (m + 1)
    table[m] = [none if (j := m + low + k) < 0 or j > n or (j < n and not closing) else INSERT * (n - j) for k in range(width)]
    for i in range(m - 1, -1, -1):
        initial, added = rows[i]
        below, here = table[i + 1], [none] * width
        for k in range(min(width - 1, n - i - low), max(-1, -i - low - 1), -1):
            j = i + low + k
            cost = DELETE + below[k - 1] if k else none
            if j < n:
                wanted = string[j]
                if initial == wanted:
                    cost = min(cost, KEEP + added + below[k])
                elif wanted != "s":
                    cost = min(cost, REROLE + added + below[k])
                if wanted != "s" and k + 1 < width:
                    cost = min(cost, INSERT + here[k + 1])
            here[k] = min(cost, none)
        table[i] = here
    return (table, low) if table[0][-low] <= limit else None


def backtrace(rows: list[tuple[str, int]], string: str, aligned: tuple[list[list[int]], int], gone: list[int]) -> str:
    """The ASCII-least audit among the cheapest paths. gone[i] rows before row i have to be deleted: first of all, as D is the least letter."""
    table, low = aligned
    m, n, i, j, out = len(rows), len(string), 0, 0, ["D" * gone[0]]

    def cost(i: int, j: int) -> int:
        k = j - i - low
        return table[i][k] if 0 <= k < len(table[i]) else 1 << 60

    while i < m or j < n:
        now = cost(i, j)
        if i < m and DELETE + cost(i + 1, j) == now:
            i += 1
            out.append("D" + "D" * gone[i])
        elif j < n and string[j] != "s" and INSERT + cost(i, j + 1) == now:
            j += 1
            out.append("I")
        else:
            out.append("K" if rows[i][0] == string[j] else "R")
            i, j = i + 1, j + 1
            out.append("D" * gone[i])
    return "".join(out)


def split(rows: list[Row]) -> tuple[list[tuple[str, int]], list[int]]:
    stay, gone = [], [0]
    for r in rows:
        if r is None:
            gone[-1] += 1
        else:
            stay.append(r)
            gone.append(0)
    return stay, gone


def lengths(rows: int) -> Iterator[tuple[int, int]]:
    """Lengths of strings with the least cost that each needs, cheapest first; a string may be as long as all rows and inserts at twice their number."""
    yield from sorted((max(INSERT * (n - rows), DELETE * (rows - n)), n) for n in range(2 * rows + 3))


def repair(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    stay, gone = split(rows)
    limit, audit = DELETE * len(stay), "D" * len(rows)
    with_s = any(c == "s" for c, _ in stay)
    for least, n in lengths(len(stay)):
        if least > limit:
            break
        if n == 0 or n == 1 or (n % 2 and not with_s):
            continue
        string = target(0, "s" if n % 2 else "", n)
        if found := align(stay, string, limit, True):
            cost, other = found[0][0][-found[1]], backtrace(stay, string, found, gone)
            limit, audit = min((limit, audit), (cost, other))
    return limit + DELETE * (len(rows) - len(stay)), audit


def matrix(rows: list[Row]) -> tuple[list[int], list[str]]:
    """Cost and audit of a chunk between each two states, -1 where there is no way."""
    stay, gone = split(rows)
    fixed = DELETE * (len(rows) - len(stay))
    best: list[tuple[int, str] | None] = [None] * 16
    for state, heads in STARTS.items():
        for head in heads:
            if head and not any(c == "s" for c, _ in stay):
                continue
            for least, n in lengths(len(stay)):
                if n < len(head):
                    continue
                string = target(state, head, n)
                at = 4 * state + after(state, string)
                limit = best[at][0] if best[at] else DELETE * len(stay) + 2 * INSERT
                if least > limit:
                    continue
                if found := align(stay, string, limit, False):
                    one = (found[0][0][-found[1]], backtrace(stay, string, found, gone))
                    best[at] = min(best[at], one) if best[at] else one
    return [b[0] + fixed if b else -1 for b in best], [b[1] if b else "" for b in best]


def joined(chunks: list[tuple[list[int], list[str]]]) -> tuple[int, str]:
    """Cost and least audit of a conversation from those of its chunks in order."""
    none = 1 << 60
    ahead = [[INSERT * len(TAIL[p]) for p in range(4)]]
    for costs, _ in reversed(chunks):
        ahead.append([min(costs[4 * p + q] + ahead[-1][q] if costs[4 * p + q] >= 0 else none for q in range(4)) for p in range(4)])
    ahead.reverse()
    state, out = 0, []
    for k, (costs, audits) in enumerate(chunks):
        audit, state = min((audits[4 * state + q], q) for q in range(4) if costs[4 * state + q] >= 0 and costs[4 * state + q] + ahead[k + 1][q] == ahead[k][state])
        out.append(audit)
    return ahead[0][0], "".join(out) + TAIL[state]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows damaged by the checksum of their place: copies is 0, 1 or 2."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "utf-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def intact(conversations: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), F.lit(1).alias("copies"))


def _hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")]


ORDER = ["turn", "role", "h1", "h2"]


def turns(rows: DataFrame) -> DataFrame:
    """Rows without texts: (conv_id, turn, role, h1, h2, copies, blank, ended, again); equal rows of a turn are one with a count.

    `again` says that role and text were seen at an earlier turn."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.select("conv_id", "turn", "role", *_hashes(), "copies", (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(*".!?").alias("ended"))
    light = light.groupBy("conv_id", *ORDER, "blank", "ended").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    seen = light.where("copies > 0 AND NOT blank").groupBy("conv_id", "role", "h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    x, y = light.alias("x"), seen.alias("y")
    same = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id"))
    for c in ("role", "h1", "h2"):
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    again = F.col("y.first").isNotNull() & ~place_of("x").eqNullSafe(F.col("y.first"))
    return x.join(y, same, "left").select("x.*", again.alias("again"))


def place_of(alias: str) -> Column:
    return F.struct(F.col(f"{alias}.turn").isNotNull().alias("known"), F.col(f"{alias}.turn").alias("at"))


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
AUDIT = f"gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string"
PIECE = "turns long, low long, high long, head string, tail string, first_turn long, last_turn long, " + ", ".join(f"{c} long" for c in COUNTS)


class _Piece:
    """Rows of one conversation as they come in order: counts, and the rows that aren't aligned yet."""

    def __init__(self, conv, opened: bool):
        self.conv, self.opened, self.rows, self.chunks = conv, opened, [], []
        self.turns, self.low, self.high, self.head, self.tail, self.first, self.last = 0, None, None, None, None, None, None
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn, initial: str, copies: int, blank: bool, ended: bool, again: bool) -> None:
        if not copies:
            return
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
            self.first = turn if self.first is None else self.first
        for k in range(copies):
            if self.tail is not None and self.tail + initial not in INITIALS:
                self.counts["illegal"] += 1
            self.head, self.tail = initial if self.head is None else self.head, initial
            fault = "blank" if blank else "duplicate" if again or k else None if ended else "truncated"
            if fault:
                self.counts[fault] += 1
            self.rows.append(None if blank or again or k else (initial, 0 if ended else TRUNCATED))
            if len(self.rows) > CHUNK:
                self.chunks.append(matrix(self.rows[:CHUNK]))
                del self.rows[:CHUNK]

    def stats(self) -> tuple:
        return (self.turns, self.low, self.high, self.head, self.tail, self.first, self.last, *(self.counts[c] for c in COUNTS))

    def whole(self) -> tuple:
        return (self.conv, None, None, *self.stats(), *repair(self.rows), None, None)

    def parts(self, part: int) -> Iterator[tuple]:
        """A row for each chunk; the first has the counts."""
        for seq, (costs, audits) in enumerate([*self.chunks, matrix(self.rows)]):
            stats = self.stats() if not seq else (0, None, None, None, None, None, None, 0, 0, 0, 0)
            yield (self.conv, part, seq, *stats, None, None, costs, audits)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _typed(df: DataFrame, schema: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in `rows` (see damage)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = turns(rows).select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), "copies", "blank", "ended", "again")
    ordered = ordered.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", "initial", "copies", "blank", "ended", "again")
    schema = f"conv_id {kind}, part int, seq int, {PIECE}, cost long, audit string, costs array<long>, audits array<string>"
    typed = _typed(rows, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found() -> Iterator[tuple]:
            now: _Piece | None = None
            for batch in batches:
                for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or conv != now.conv:
                        if now is not None:  # the first of a partition may have begun in another
                            yield from now.parts(part) if now.opened or now.chunks else [now.whole()]
                        now = _Piece(conv, now is None)
                    now.add(*row)
            if now is not None:
                yield from now.parts(part)

        yield from _batches(found(), typed)

    pieces = materialise(ordered.mapInArrow(read, schema))
    final = f"conv_id {kind}, {AUDIT}"
    end = _typed(rows, final)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = pieces.where("part IS NULL").select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(conv, stats: list[dict], chunks: list) -> tuple:
            n, low, high, last, tail = 0, None, None, None, None
            counts = dict.fromkeys(COUNTS, 0)
            for s in stats:
                n += s["turns"] - (s["first_turn"] is not None and s["first_turn"] == last)
                low, high, last = s["low"] if low is None else low, high if s["high"] is None else s["high"], last if s["last_turn"] is None else s["last_turn"]
                for c in COUNTS:
                    counts[c] += s[c]
                if s["head"] is not None:
                    counts["illegal"] += tail is not None and tail + s["head"] not in INITIALS
                    tail = s["tail"]
            return (conv, 0 if low is None else high - low + 1 - n, *counts.values(), *joined(chunks))

        def found() -> Iterator[tuple]:
            started, conv, stats, chunks = False, None, [], []
            for batch in batches:
                for r in batch.to_pylist():
                    if started and r["conv_id"] != conv:
                        yield close(conv, stats, chunks)
                        stats, chunks = [], []
                    started, conv = True, r["conv_id"]
                    if r["seq"] == 0:
                        stats.append(r)
                    chunks.append((r["costs"], r["audits"]))
            if started:
                yield close(conv, stats, chunks)

        yield from _batches(found(), end)

    parts = pieces.where("part IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.union(parts.mapInArrow(join, final))


def repaired(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """audits() with repaired_sha256: the digest of the repaired `role:text` lines, and with_text their array `repaired`."""
    found = audits(rows)
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", *_hashes(), "text", "copies")
    heads = found.withColumn("kind", F.lit(0))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    both = both.select(*found.columns, "kind", "role", "text", "copies")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {AUDIT}, repaired_sha256 string, repaired array<string>"
    typed = _typed(rows, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            head, say = None, None
            for batch in batches:
                for *row, kind, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind == 0:
                        if head is not None:
                            yield (*head, *say.end())
                        head, say = row, _Speech(row[-1], with_text)
                    else:
                        for _ in range(copies):
                            say.row(role, text)
            if head is not None:
                yield (*head, *say.end())

        yield from _batches(found(), typed)

    out = both.mapInArrow(read, schema)
    return out if with_text else out.drop("repaired")


class _Speech:
    """A conversation's repaired rows from its audit and its rows in order."""

    def __init__(self, audit: str, with_text: bool):
        self.audit, self.at, self.last, self.digest, self.empty = audit, 0, "", hashlib.sha256(), True
        self.lines = [] if with_text else None

    def say(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.digest.update((line if self.empty else "\n" + line).encode("utf-8", "surrogatepass"))
        self.empty, self.last = False, role[:1]
        if self.lines is not None:
            self.lines.append(line)

    def next_role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.say(self.next_role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.say(role, text)
        elif letter == "R":
            self.say(self.next_role(), text)

    def end(self) -> tuple:
        self.inserts()
        return self.digest.hexdigest(), self.lines
