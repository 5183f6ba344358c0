"""Fuzzy line deduplication: a prefix join on rare words of normalised lines, a SimHash filter, verified edit similarity.

Lines of LEAST_WORDS words or more are normalised: lower case, signs to spaces. In scripts without spaces each
character is a word. Equal ones are one line. Blocks of a line's SimHash can't be the keys of the join: within
SIMILARITY a line differs from its source in up to a third of the bits, so blocks that one of them is sure to leave
whole would be three bits long. Instead the words of a line are put in one order for all lines, rare ones that a
sketch of fixed size has seen first, then common ones, then unseen ones (most typos), and the line is posted under its
first words: up to SINGLES rare ones each by itself, the others of the first PREFIX by pairs. Two lines share a key for
certain if fewer than SINGLES words differ where all of these are rare, or up to PREFIX - 2 where none is; and nearly
always if the differing words are few of all, since the order puts most typos last.

Pairs of a list go through filters inside the join: their sizes; for lines of under LONG characters the counts of
characters, which rule out only what can't be alike; for longer ones a SimHash of SIM_BITS bits over each line's first
SIM_WORDS words, of which BITS may differ (lines that keep two thirds of these words pass nearly always). What is left is
verified on the lines: edit distance up to (100 - SIMILARITY) percent of the longer one. Of each connected group one
occurrence stays, in the document with the smallest id, of those without one or with the same in the text with the
smallest hash: there the line with the smallest hash, where it stands first. All others go.

Defined cases: shorter and blank lines always stay; null texts stay null and empty ones empty, with no lines
removed; documents without an id come last in the order; rows that repeat id and text are the same document and
keep the same lines; a document may lose all its lines and then has an empty text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PIECE, arrow_map, bloom, components, materialise, may_hold, release, trim

LEAST_WORDS = 5
SIMILARITY = 85
#: Of a line's first PREFIX words, up to SINGLES rare ones are keys by themselves, the others in pairs: in lines of up to
#: SHORT words, and in longer ones.
SHORT, SINGLES, PREFIX = 16, (4, 3), (6, 4)
#: A word is rare if it stands in about so many lines at the most.
RARE = 64
#: From LONG characters on a SimHash of SIM_WORDS words takes the place of counts of characters.
LONG, SIM_WORDS, SIM_BITS, BITS = 120, 32, 128, 48
#: How far equal words are searched for, and after how many times the limit a pair's distance is looked at first.
REACH, FAR = 8, 3
#: Lists of more lines than this are compared with one centre first, and then in blocks of about so many.
LIST, BLOCK = 64, 512
#: Characters that are cut into words at once, words whose keys are made at once, and fetched lines that are passed on together.
PORTION, WORDS, LINES = 1 << 20, 1 << 18, 1 << 12
#: The low bytes of a long, and the size from which a word is hashed by itself.
MASKS, FAR_END = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 1 << 12
#: Cells of the sketch of word frequencies, and how many of them go together.
CELLS, CELLS_A_ROW = 1 << 20, 1 << 12
#: Lines of over a HOT-th of all are joined by broadcast: HOT rows at most.
HOT = 4096
#: Classes of words: below KNOWN rare ones, UNSEEN those of one line at the most, which link nothing.
KNOWN, UNSEEN = 0x80, 0xFF
APART = bytes(b if b >= 128 or b == 10 or chr(b).isalnum() else 32 for b in range(256))
#: What two lines x and y of one list have to fulfil: an edit changes the size by one and two counts of characters at
#: the most, and the two sketches are of one kind only where both sizes are on the same side of LONG.
FITS = (
    f"100 * (greatest(x_size, y_size) - least(x_size, y_size)) <= {100 - SIMILARITY} * greatest(x_size, y_size) AND "
    f"bit_count(x_s0 ^ y_s0) + bit_count(x_s1 ^ y_s1) <= CASE WHEN least(x_size, y_size) >= {LONG} THEN {BITS} "
    f"WHEN greatest(x_size, y_size) < {LONG} THEN 2 * floor({100 - SIMILARITY} * greatest(x_size, y_size) / 100) ELSE {SIM_BITS} END"
)


def apart(low: str) -> bytes:
    """A text in lower case, its signs as spaces."""
    return low.encode("utf-8", "surrogatepass").translate(APART)


def normalised(text: str) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in apart(text.lower()).split(b"\n")]


#: Thai, Lao, Myanmar, Khmer, kana, Han: scripts without spaces between words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


#: Bytes that characters of these scripts begin with, in UTF-8.
LEADS = bytes([0xE0, 0xE1, 0xE3, *range(0xE4, 0xEA), 0xEF, 0xF0])


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash."""
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def spaced_out(text: str, raw: bytes) -> bytes:
    """`raw`, the lower-case bytes of `text`, with each character of a script without spaces between spaces."""
    if len(raw.translate(None, LEADS)) == len(raw) or not UNSPACED.search(text):
        return raw
    return apart(UNSPACED.sub(r" \g<0> ", text))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in lines of words and spaces, and how many words each line has."""
    b = np.frombuffer(raw, np.uint8)
    apart = np.ones(len(b) + 2, bool)
    apart[1:-1] = (b == 32) | (b == 10)
    starts, ends = np.nonzero(apart[:-1] & ~apart[1:])[0], np.nonzero(~apart[:-1] & apart[1:])[0]
    before = np.searchsorted(starts, np.append(np.nonzero(b == 10)[0], len(b)))
    return starts, ends, np.diff(before, prepend=0)


def hash_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the parts of `raw`, all at once: eight bytes a step."""
    eights = np.ndarray(len(raw) + 1, np.uint64, raw + bytes(8), strides=1)
    left = ends - starts
    h, at, todo = left.astype(np.uint64), starts, slice(None)
    while len(at):
        h[todo] = mixed(h[todo] ^ eights[at] & MASKS[np.minimum(left, 8)], 0)
        more = np.nonzero((left > 8) & (left <= FAR_END))[0]
        todo, at, left = more if isinstance(todo, slice) else todo[more], at[more] + 8, left[more] - 8
    for k in np.nonzero(ends - starts > FAR_END)[0].tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return h


def hash_words(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    return hash_spans(b"".join(words), ends - sizes, ends)


def words_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of texts joined by line breaks, hashes of the words (in scripts without spaces, of the characters), and their number in each line."""
    text = text.lower()
    raw = apart(text)
    parts = spaced_out(text, raw)
    starts, ends, counts = word_bounds(parts)
    return raw, hash_spans(parts, starts, ends), counts


def normalised_lines(raw: bytes) -> bytes:
    """The lines with one space between words and none around them."""
    starts, _, counts = word_bounds(raw)
    b = np.frombuffer(raw, np.uint8)
    keep = b != 32
    later = np.ones(len(starts), bool)
    later[(np.cumsum(counts) - counts)[counts > 0]] = False
    keep[starts[later] - 1] = True
    return b[keep].tobytes()


def portions(texts: list[str]) -> Iterator[slice]:
    """Of texts, so many that they have about PORTION characters, one at least."""
    lo = size = 0
    for hi, text in enumerate(texts):
        if size and size + len(text) > PORTION:
            yield slice(lo, hi)
            lo, size = hi, 0
        size += len(text) + 1
    if lo < len(texts):
        yield slice(lo, len(texts))


def frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """The place of words in the order, by cells of their hashes: below KNOWN rare ones, then common ones, UNSEEN last.

    Classes are steps of an eighth of a power of two. They are counted over the lines of all texts. Words of a single line can't
    be shared with another, so they come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(batch.nbytes, PIECE))
            for lo in range(0, batch.num_rows, step):
                texts = batch.column(0).slice(lo, step).to_pylist()
                for part in portions(texts):
                    _, h, counts = words_of("\n".join(texts[part]))
                    # a line's word once, though it stands there twice
                    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(40)
                    seen = np.sort(owner | h & np.uint64((1 << 40) - 1))
                    seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] if len(seen) else seen
                    n += np.bincount((seen % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        trim()
        rows = n.reshape(-1, CELLS_A_ROW)
        at = np.nonzero(rows.any(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([rows[k].tobytes() for k in at.tolist()], pa.binary())], ["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[part] = total.get(part, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    # a task's counts are one batch, and a row for each of CELLS / CELLS_A_ROW parts of the cells
    counted = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "part int, counts binary")
    n = np.zeros((CELLS // CELLS_A_ROW, CELLS_A_ROW))
    for part, counts in zip(*(c.to_pylist() for c in counted.repartition("part").mapInArrow(summed, "part int, counts binary").toArrow().columns)):
        n[part] = np.frombuffer(counts, np.int64)
    n = n.ravel()
    steps = np.minimum(KNOWN - 1, 8 * np.log2(np.maximum(n, 1)))
    return np.where(n < 2, UNSEEN, np.where(n <= RARE, steps, np.minimum(UNSEEN - 1, KNOWN + steps))).astype(np.uint8)


def ordered(h: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lines with `counts` words each, by line and in the order of all words, and their classes.

    A word's second place in a line is another word, of the same class."""
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(40)
    ranked = np.sort(owner | classes[h % np.uint64(CELLS)].astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
    place = np.arange(len(ranked))
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    again = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mixed((ranked & np.uint64(0xFFFFFFFF)) + (again << np.uint64(32)), 1), (ranked >> np.uint64(32) & np.uint64(255)).astype(np.uint8)


def keys_of(word: np.ndarray, kind: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """The keys of each line: its rare words, and the pairs of the others among the first PREFIX."""
    starts = np.cumsum(counts) - counts
    singles, prefix = (np.where(counts > SHORT, n[1], np.minimum(n[0], counts)) for n in (SINGLES, PREFIX))
    at = [np.minimum(starts + k, len(word) - 1) for k in range(max(PREFIX))]
    there = [(k < singles) & (kind[at[k]] < KNOWN) for k in range(max(SINGLES))]
    keys, many = [word[at[k]] for k in range(max(SINGLES))], np.sum(there, 0)
    for j in range(max(PREFIX)):
        for i in range(j):
            # rare words, if they aren't more than SINGLES, stand before both
            keys.append(mixed(word[at[i]] * np.uint64(3) + word[at[j]], 2))
            there.append((many < singles) & (i >= many) & (j < prefix))
    keys, there = np.stack(keys, 1), np.stack(there, 1)
    ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[there].view(np.int64)))


def counts_of(lines: list[str]) -> np.ndarray:
    """Two longs for each line: by the last five bits of characters, their counts modulo 8 in four bits each.

    Counts are in a ring code, whose neighbours differ in one bit: an edit changes two bits at most."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 31
    n = np.bincount(np.repeat(np.arange(len(lines)) * 32, sizes) + codes, minlength=32 * len(lines)).reshape(-1, 32) & 7
    ring = np.array([0, 1, 3, 7, 15, 14, 12, 8], np.uint8)[n]
    return (ring[:, ::2] | ring[:, 1::2] << 4).view(np.int64)


def simhash(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two longs for each line: for each bit, what most of its first SIM_WORDS words have there."""
    out = np.zeros((len(counts), SIM_BITS // 8), np.uint8)
    starts, used = np.cumsum(counts) - counts, np.minimum(counts, SIM_WORDS)
    for lo in range(0, len(counts), 1024):
        n = used[lo : lo + 1024]
        first = np.cumsum(n) - n
        h = word[np.repeat(starts[lo : lo + 1024] - first, n) + np.arange(n.sum())]
        bits = np.unpackbits(np.stack([mixed(h, 3), mixed(h, 4)], 1).view(np.uint8), axis=1).view(np.int8)
        out[lo : lo + 1024] = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int8) > n[:, None], axis=1)
    return out.view(np.int64)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, place, line, first, size, s0, s1, keys): each line that counts; `first` in its text.

    `doc` is the id, or the largest long without one; `size` counts characters; s0 and s1 are counts of characters or
    a SimHash."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text_col))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs, hashes = (batch.column(k).to_numpy() for k in range(2))
        texts = batch.column(2).to_pylist()
        for part in portions(texts):
            raw, h, counts = words_of("\n".join(texts[part]))
            breaks = np.array([t.count("\n") + 1 for t in texts[part]])
            owner = np.repeat(np.arange(part.start, part.stop), breaks)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(breaks) - breaks, breaks)
            good = counts >= LEAST_WORDS
            norm, at = normalised_lines(raw), np.nonzero(good)[0]
            whole = norm.split(b"\n")
            line = np.fromiter((xxhash.xxh3_64_intdigest(whole[k]) for k in at.tolist()), np.uint64, len(at))
            whole = norm.decode("utf-8", "replace").split("\n")
            first = np.zeros(len(at), bool)
            first[np.unique(mixed(line ^ mixed(owner[at].astype(np.uint64), 5), 6), return_index=True)[1]] = True
            h, n = h[np.repeat(good, counts)], counts[at]
            ends = np.cumsum(n)
            # a text of many words in pieces
            for k in np.split(np.arange(len(at)), np.unique(np.searchsorted(ends, np.arange(WORDS, ends[-1], WORDS)))) if len(at) else []:
                if not len(k):
                    continue
                word, kind = ordered(h[ends[k[0]] - n[k[0]] : ends[k[-1]]], n[k], shared.value)
                lines = [whole[j] for j in at[k].tolist()]
                sizes = np.fromiter(map(len, lines), np.int32, len(k))
                sketch, long = np.zeros((len(k), 2), np.int64), sizes >= LONG
                if not long.all():
                    sketch[~long] = counts_of([x for x in lines if len(x) < LONG])
                if long.any():
                    sketch[long] = simhash(word[np.repeat(long, n[k])], n[k][long])
                columns = [docs[owner[at[k]]], hashes[owner[at[k]]], place[at[k]].astype(np.int32), line[k].view(np.int64), first[k], sizes, sketch[:, 0], sketch[:, 1]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), keys_of(word, kind, n[k])], ["doc", "text_hash", "place", "line", "first", "size", "s0", "s1", "keys"])

    rows = docs.where(F.col(text_col).isNotNull()).select(order(id_col), F.xxhash64(text_col), text_col)
    return arrow_map(rows, run, "doc long, text_hash long, place int, line long, first boolean, size int, s0 long, s1 long, keys array<long>", pieces=True)


def order(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc")


def distances(a: str, b: str) -> Iterator[int]:
    """Levenshtein distances of `a` and each prefix of `b`, by bit vectors (Myers, 1999): one step for each character."""
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score, get = full, 0, len(a), peq.get
    for c in b:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        yield score


def edit_distance(a: str, b: str) -> int:
    score = len(a)
    if not a or not b:
        return len(a) + len(b)
    for score in distances(a, b):
        pass
    return score


def at_most(x: list[str], y: list[str], limit: int) -> int:
    """A distance that two lines of words have at the most; over the limit when the search ends early.

    Equal words are matched in their order, after differences of up to REACH words on either side."""
    i = j = cost = 0
    while (i < len(x) or j < len(y)) and cost <= limit:
        if i < len(x) and j < len(y) and x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for reach in range(1, REACH + 1):
            d = next((d for d in range(reach + 1) if i + d < len(x) and j + reach - d < len(y) and x[i + d] == y[j + reach - d]), None)
            if d is not None:
                p, q = " ".join(x[i : i + d]), " ".join(y[j : j + reach - d])
                i, j = i + d, j + reach - d
                break
        else:
            if len(x) - i + len(y) - j > REACH:
                return limit + 1
            p, q = " ".join(x[i:]), " ".join(y[j:])
            i, j = len(x), len(y)
        cost += edit_distance(p, q) if p and q else len(p) + len(q) + 1  # with the space between
    return cost


def far_apart(a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs of short texts are over the limit for certain.

    All pairs at once: distances of the first 64 characters of one text and the beginnings of the other, of which
    every way from one to the other passes one. Characters are told apart by their last five bits alone, which can
    only make distances smaller."""
    sizes = np.array([list(map(len, a)), list(map(len, b))]).reshape(2, -1)
    limit = (100 - SIMILARITY) * sizes.max(0) // 100
    out = np.zeros(len(a), bool)
    todo = np.nonzero((limit > 0) & (limit <= 20) & (sizes.min(0) > limit))[0]
    if not len(todo):
        return out
    m, n, limit = np.minimum(sizes[0, todo], 64), sizes[1, todo], limit[todo]
    wide = int((m + limit).max())
    codes = []
    for texts, width in ((a, int(m.max())), (b, wide)):
        cut = "".join(texts[k][:width].ljust(width, "\0") for k in todo)
        codes.append(np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(todo), width) & 31)
    row, one = np.arange(len(todo)), np.uint64(1)
    peq = np.zeros((len(todo), 32), np.uint64)
    for i in range(codes[0].shape[1]):
        peq[row, codes[0][:, i]] |= np.where(i < m, one << np.uint64(i), np.uint64(0))
    pv, mv = np.full(len(todo), ~np.uint64(0)), np.zeros(len(todo), np.uint64)
    score, least, last = m.copy(), m + n, (m - 1).astype(np.uint64)
    for j in range(wide):
        eq = peq[row, codes[1][:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score = score + (ph >> last & one).astype(np.int64) - (mh >> last & one).astype(np.int64)
        inside = (j < n) & (j + 1 >= np.minimum(m - limit, n)) & (j < m + limit)
        least = np.where(inside, np.minimum(least, score), least)
        ph, mh = ph << one | one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    out[todo] = least > limit
    return out


def alike(a: str, b: str) -> bool:
    """Whether the edit distance is within the limit; bounds that decide most pairs come first."""
    n = max(len(a), len(b))
    limit = (100 - SIMILARITY) * n // 100
    if n - min(len(a), len(b)) > limit:
        return False
    x, y = a.split(), b.split()
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q) <= limit:
        return True  # words put in the place of others
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    x, y = x[k:], y[k:]
    while x and y and x[-1] == y[-1]:
        x.pop()
        y.pop()
    a, b = " ".join(x), " ".join(y)
    if not x or not y:
        return not (x or y) or len(a) + len(b) + 1 <= limit  # with the space between
    if max(len(a), len(b)) <= limit or 2 * len(set(x) & set(y)) >= min(len(x), len(y)) and at_most(x, y, limit) <= limit:
        return True
    m = FAR * limit
    if 0 < m < len(a) and min(d for k, d in enumerate(distances(a[:m], b[: m + limit + 1])) if k >= m - limit - 1) > limit:
        return False  # every way passes the end of a's beginning somewhere
    have, want = Counter(a), Counter(b)
    if max((have - want).total(), (want - have).total()) > limit:
        return False  # each edit changes one character on either side
    return edit_distance(a, b) <= limit


#: A posting: a key of a line, and what the filters need.
POSTING = np.dtype([("key", "<i8"), ("node", "<i8"), ("size", "<i4"), ("s0", "<i8"), ("s1", "<i8"), ("times", "<i8")])


def crowded(distinct: DataFrame) -> DataFrame:
    """(key): keys of over LIST lines of one batch, as often as they are met."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n > LIST])], ["key"])

    return arrow_map(distinct.select("keys"), run, "key long")


def postings(distinct: DataFrame, filled: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Each line under each of its keys: (key, node, size, s0, s1, times) for keys that pass the filter `filled`, and
    (bucket, packed) for the others, with the postings of one batch and bucket of keys in one cell."""
    spark, columns = distinct.sparkSession, ["line", "size", "s0", "s1", "times", "keys"]
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def these(batch: pa.RecordBatch, passing: bool) -> np.ndarray:
        keys = batch.column("keys").flatten().to_numpy()
        full = np.zeros(len(keys), bool)
        full[may_hold(filled.value, keys.view(np.uint64))] = True
        at = np.nonzero(full == passing)[0]
        owner = np.repeat(np.arange(batch.num_rows), batch.column("keys").value_lengths().to_numpy())[at]
        out = np.empty(len(at), POSTING)
        out["key"] = keys[at]
        for name, column in zip(POSTING.names[1:], columns):
            out[name] = batch.column(column).to_numpy()[owner]
        return out

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _columns(these(batch, True))], list(POSTING.names))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = these(batch, False)
        bucket = (mixed(found["key"].view(np.uint64), 7) % np.uint64(buckets)).astype(np.int32)
        found, sizes = found[np.argsort(bucket, kind="stable")], np.bincount(bucket, minlength=buckets)
        ends, there = np.cumsum(sizes), np.nonzero(sizes)[0]
        cells = [found[ends[k] - sizes[k] : ends[k]].tobytes() for k in there.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(cells, pa.binary())], ["bucket", "packed"])

    schema = "key long, node long, size int, s0 long, s1 long, times long"
    return arrow_map(distinct.select(columns), rows, schema), arrow_map(distinct.select(columns), packed, "bucket int, packed binary")


def _columns(found: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(found[c]) for c in POSTING.names]


def close_by(packed: DataFrame) -> DataFrame:
    """(a, b, key, node, size, s0, s1, times): pairs (a, b) of lines of one short list that pass the filters; postings of long lists, without a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(b"".join(x.as_py() for batch in batches for x in batch.column(1)), POSTING)
        if not len(found):
            return
        # keys of a single line are most of all
        keys = np.ascontiguousarray(found["key"])
        found = found[order := np.argsort(keys, kind="stable")]
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        found = found[np.append(same, False) | np.append(False, same)]
        key, node, size, s0, s1, _ = _columns(found)
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        many = np.diff(np.append(np.nonzero(new)[0], len(key)))
        count = np.repeat(many, many)
        x, a, b = np.nonzero(count <= LIST)[0], [], []
        for step in range(1, LIST):
            x = x[x + step < len(key)]
            x = x[key[x] == key[x + step]]
            if not len(x):
                break
            y = x + step
            fit = _fits(size[x], size[y], s0[x], s0[y], s1[x], s1[y]) & (node[x] != node[y])
            a.append(np.minimum(node[x], node[y])[fit])
            b.append(np.maximum(node[x], node[y])[fit])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
        long = found[count > LIST]
        for lo in range(0, len(pairs), WORDS):
            n = len(pairs[lo : lo + WORDS])
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs[lo : lo + WORDS].T), *(pa.nulls(n, t) for t in types)], names)
        for lo in range(0, len(long), WORDS):
            part = long[lo : lo + WORDS]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), pa.int64()) for _ in "ab"), *map(pa.array, _columns(part))], names)

    names, types = ["a", "b", *POSTING.names], [pa.int32() if c == "size" else pa.int64() for c in POSTING.names]
    return packed.repartition("bucket").mapInArrow(run, "a long, b long, key long, node long, size int, s0 long, s1 long, times long")


def met(lists: DataFrame) -> DataFrame:
    """(a, b): pairs of lines in one list that pass the filters."""
    x, y = (lists.select("key", *[F.col(c).alias(f"{p}_{c}") for c in lists.columns if c != "key"]) for p in "xy")
    return x.join(y, "key").where(f"x_node < y_node AND {FITS}").select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def whole_lines(nodes: DataFrame, distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(line, whole), stored: the normalised text of each of the lines (line); texts come from the first documents."""
    wanted = materialise(distinct.select("line", "doc", "place").join(nodes, "line"))

    def spots(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, place = (batch.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(mixed(mixed(doc, 5) + place, 6).view(np.int64))], ["spot"])

    context = docs.sparkSession.sparkContext
    these_docs = context.broadcast(bloom(wanted.select(F.xxhash64("doc"))))
    these_spots = context.broadcast(bloom(arrow_map(wanted.select("doc", "place"), spots, "spot long")))

    def fetch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = may_hold(these_docs.value, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        docs, texts = batch.column(0).to_numpy()[at], batch.column(2).take(pa.array(at)).to_pylist()
        for part in portions(texts):
            breaks = np.array([t.count("\n") + 1 for t in texts[part]])
            doc = np.repeat(docs[part], breaks)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(breaks) - breaks, breaks)
            spot = mixed(mixed(doc.view(np.uint64), 5) + place.astype(np.uint64), 6)
            wanted_here = may_hold(these_spots.value, spot)
            lines = normalised_lines(apart("\n".join(texts[part]).lower())).split(b"\n")
            for lo in range(0, len(wanted_here), LINES):
                rows = wanted_here[lo : lo + LINES]
                here = [lines[k] for k in rows.tolist()]
                line = np.fromiter(map(xxhash.xxh3_64_intdigest, here), np.uint64, len(here))
                yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(line.view(np.int64)), pa.array([x.decode("utf-8", "replace") for x in here])], ["doc", "line", "whole"])

    rows = docs.where(F.col(text_col).isNotNull()).select(order(id_col), F.xxhash64(order(id_col)), text_col)
    texts = arrow_map(rows, fetch, "doc long, line long, whole string", pieces=True).join(wanted, ["doc", "line"], "left_semi").select("line", "whole").dropDuplicates(["line"])
    texts = materialise(texts)
    release(wanted)
    return texts


def confirmed(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (a, b) of lines whose texts are alike."""
    near = materialise(pairs.distinct())
    texts = whole_lines(near.select(F.explode(F.array("a", "b")).alias("line")).distinct(), distinct, docs, id_col, text_col)
    both = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [not no and alike(x, y) for no, x, y in zip(far_apart(ta, tb).tolist(), ta, tb)]
        return batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    links = materialise(arrow_map(both, compare, "a long, b long"))
    release(near, texts)
    return links


def blocks(members: DataFrame) -> DataFrame:
    """(x, y): the members (key, c, node, ...) of each list in blocks of about BLOCK, every block with each of its list, itself as a null."""
    cut = F.ceil(F.col("c") / BLOCK)
    columns = [c for c in members.columns if c != "c"]
    packed = members.withColumn("block", F.pmod(F.xxhash64("node"), cut)).groupBy("key", "block", cut.alias("n")).agg(F.collect_list(F.struct(*columns)).alias("m"))
    several = packed.where("n > 1")
    x, y = several.select("key", F.col("block").alias("i"), F.col("m").alias("x")), several.select("key", F.col("block").alias("j"), F.col("m").alias("y"))
    own = packed.select(F.col("m").alias("x"), F.lit(None).cast(packed.schema["m"].dataType).alias("y"))
    return own.unionByName(x.join(y, "key").where("i < j").select("x", "y"))


def _fits(xs, ys, x0, y0, x1, y1) -> np.ndarray:
    """FITS for arrays."""
    low, high = np.minimum(xs, ys), np.maximum(xs, ys)
    bits = np.bitwise_count((x0 ^ y0).view(np.uint64)).astype(np.int64) + np.bitwise_count((x1 ^ y1).view(np.uint64))
    limit = np.where(low >= LONG, BITS, np.where(high < LONG, 2 * ((100 - SIMILARITY) * high // 100), SIM_BITS))
    return (100 * (high - low) <= (100 - SIMILARITY) * high) & (bits <= limit)


def _fitting(x: pa.StructArray, y: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks, or of one with itself, whose parts differ and that pass FITS."""
    (xs, x0, x1, xp), (ys, y0, y1, yp) = ([b.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("size", "s0", "s1", "part")] for b in (x, x if y is None else y))
    fit = (xp[:, None] != yp) & _fits(xs[:, None], ys, x0[:, None], y0, x1[:, None], y1)
    return np.nonzero(np.triu(fit, 1) if y is None else fit)


def near_nodes(members: DataFrame) -> DataFrame:
    """(line): the members (key, c, node, size, s0, s1, part) that pass the filters with one of another part in a list of theirs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for x, y in zip(*batch.columns):
            x, y = x.values, y.values
            i, j = _fitting(x, y)
            nodes = np.unique(np.concatenate([x.field("node").to_numpy()[i], (x if y is None else y).field("node").to_numpy()[j]]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64())], ["line"])

    return arrow_map(blocks(members), run, "line long").distinct()


def linked(members: DataFrame) -> DataFrame:
    """(a, b): links between members (key, c, node, size, s0, s1, part, top, keys, whole) that join all parts whose lines are alike.

    A pair is compared in the least list that both are in, unless it was with that list's `top`. Parts that a block's
    links have joined already aren't compared again, so a block gives fewer links than it has parts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for x, y in zip(*batch.columns):
            x, y = x.values, y.values
            i, j = _fitting(x, y)
            key = x.field("key")[0].as_py()
            (xn, xp, xt, xk, xw), (yn, yp, yt, yk, yw) = ([b.field(f).to_pylist() for f in ("node", "part", "top", "keys", "whole")] for b in (x, x if y is None else y))
            xk, yk = [set(k) for k in xk], [set(k) for k in yk]
            pairs = [(p, q) for p, q in zip(i.tolist(), j.tolist()) if not (xt[p] or yt[q]) and min(xk[p] & yk[q]) == key]
            root: dict[int, int] = {}

            def find(p: int) -> int:
                while p in root:
                    p = root[p]
                return p

            links = []
            for at in range(0, len(pairs), LINES):
                todo = [(p, q) for p, q in pairs[at : at + LINES] if find(xp[p]) != find(yp[q])]
                far = far_apart([xw[p] for p, _ in todo], [yw[q] for _, q in todo]).tolist()
                for (p, q), no in zip(todo, far):
                    u, v = find(xp[p]), find(yp[q])
                    if not no and u != v and alike(xw[p], yw[q]):
                        root[max(u, v)] = min(u, v)
                        links.append((xn[p], yn[q]))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in links], pa.int64()), pa.array([q for _, q in links], pa.int64())], ["a", "b"])

    return arrow_map(blocks(members), run, "a long, b long")


def groups(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, component) of the lines that are linked with others.

    Short lists are paired where their postings lie, keys of a single line go there. Of longer ones the members are compared with the list's most frequent line first;
    then, only where a list still holds several components, blocks of its members are compared where they lie: first by the
    filters alone, which leaves the lines whose texts are fetched, then by these. No pair becomes a row but links that join components."""
    filled = distinct.sparkSession.sparkContext.broadcast(bloom(crowded(distinct)))
    posted, packed = postings(distinct, filled)
    posted, near = materialise(posted), materialise(close_by(packed))
    lists = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    short = met(posted.join(lists.where(f"c <= {LIST}").select("key"), "key").drop("times")).union(near.where("a IS NOT NULL").select("a", "b"))
    mine = posted.join(lists.where(f"c > {LIST}").select("key"), "key").unionByName(near.where("a IS NULL").drop("a", "b"))
    mine = materialise(mine)
    often = mine.groupBy("key").agg(F.max("times").alias("times"))
    top = mine.join(often, ["key", "times"]).groupBy("key").agg(F.min("node").alias("node"))
    top = mine.join(top, ["key", "node"]).select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "s0", "s1")])
    members = mine.select("key", *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "s0", "s1")]).join(top, "key")
    star = members.where(f"x_node <> y_node AND {FITS}").select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    links = confirmed(short.union(star), distinct, docs, id_col, text_col)
    if mine.isEmpty():
        return components(links, "a", "b")
    parts = components(links, "a", "b")
    placed = mine.drop("times").join(parts, mine.node == parts.id, "left")
    placed = materialise(placed.select("key", "node", "size", "s0", "s1", F.coalesce("component", "node").alias("part")))
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("c")).where("low <> high").select("key", "c")
    members = placed.join(several, "key")
    texts = whole_lines(near_nodes(members), distinct, docs, id_col, text_col)
    left = materialise(members.join(texts.withColumnRenamed("line", "node"), "node"))
    keys = left.groupBy("node").agg(F.collect_set("key").alias("keys"))
    tops = top.select("key", F.col("x_node").alias("node"), F.lit(True).alias("top"))
    counts = left.groupBy("key").agg(F.count("*").alias("c"))
    left_ = left.drop("c").join(counts, "key").join(keys, "node").join(tops, ["key", "node"], "left").withColumn("top", F.coalesce("top", F.lit(False)))
    more = materialise(linked(left_))
    release(posted, near, mine, placed, texts, left)
    return components(links.union(more), "a", "b")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, places): the lines of each document that go, where there are any."""
    lines = materialise(lines_of(docs, id_col, text_col))
    distinct = lines.where("first").groupBy("line").agg(F.min(F.struct("doc", "text_hash", "place", "size", "s0", "s1", "keys")).alias("held"), F.count("*").alias("times"))
    distinct = materialise(distinct.select("line", "held.*", "times"))
    parts = groups(distinct, docs, id_col, text_col)
    grouped = distinct.join(parts, distinct.line == parts.id).select("line", "doc", "text_hash", "place", "component")
    stays = grouped.groupBy("component").agg(F.min(F.struct("doc", "text_hash", "place", "line")).alias("s")).select("component", F.col("s.line").alias("kept_line"))
    others = grouped.join(stays, "component").select("line", (F.col("line") == F.col("kept_line")).alias("stays"))
    verdict = distinct.join(others, "line", "left").where("times > 1 OR stays IS NOT NULL").select(
        "line", "times", F.when(F.coalesce("stays", F.lit(True)), F.struct("doc", "text_hash")).alias("kept_in")
    )
    verdict = materialise(verdict)
    # lines that make up a HOT-th of all are HOT at most, and are held against theirs without a shuffle
    often = verdict.where(F.col("times") > lines.count() / HOT).select("line", "kept_in")
    rows = lines.where("first").select("doc", "text_hash", "place", "line")
    hot = rows.join(F.broadcast(often), "line")
    rest = rows.join(F.broadcast(often), "line", "left_anti").join(verdict.select("line", "kept_in"), "line")
    goes = hot.union(rest).where(~F.col("kept_in").eqNullSafe(F.struct("doc", "text_hash"))).select("doc", "text_hash", "place")
    goes = goes.union(lines.where("NOT first").select("doc", "text_hash", "place"))
    return goes.groupBy("doc", "text_hash").agg(F.collect_set("place").alias("places"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated lines taken out of the text, and n_lines and n_removed added or replaced."""
    gone = repeated(docs, id_col, text_col).alias("g")
    rows = docs.select(F.struct("*").alias("row"), order(id_col), F.xxhash64(text_col).alias("text_hash")).alias("d")
    joined = rows.join(gone.hint("shuffle_hash"), F.expr("d.doc = g.doc AND d.text_hash = g.text_hash"), "left")
    whole = F.col("d.row").getField(text_col)
    lines = F.split(whole, "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("g.places"), i)), "\n")
    text = F.when(F.col("g.places").isNull(), whole).otherwise(left)
    n = F.when(F.coalesce(whole, F.lit("")) == "", F.lit(0)).otherwise(F.size(lines)).cast("long")
    kept = [(text if c == text_col else F.col("d.row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*kept, n.alias("n_lines"), F.when(F.col("g.places").isNull(), 0).otherwise(F.size("g.places")).cast("long").alias("n_removed"))
