"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A text is cut into words by the vocabulary's pattern. A word is held as part boundaries and, beside
them, the merge rank of each adjacent pair; the smallest rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed. The scan is quadratic, so words of more than
`SHORT` bytes keep the same ranks in a heap over a linked list instead; both give the same merges.

Defined cases: null and empty texts have no ids and decode to the empty text. A special token's string
in a text is that token. Text that isn't valid in UTF-8 cannot occur in a Spark string. Repeated rows
each get their row. Columns of other names than `id_col` and `text_col` are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map

# The pre-tokenization pattern of this vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 48
#: Encoded pieces of one generation; a worker keeps two, so that pieces in use outlive a full cache.
CACHE = 1 << 18
#: Single spaces between other characters, where one word ends and the next begins in any case.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Where a plain split at spaces would cut at others: runs of white space with a space, or U+001C to U+001F,
#: which the two regular expression libraries class differently.
RUNS = re.compile(r"\s \s?| \s|[\x1c-\x1f]")
NONE = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, mapped back to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file, with a bounded cache of encoded words."""

    def __init__(self, path: str, cache: int = CACHE, short: int = SHORT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.token_of = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in ids.items():
            self.token_of[i] = t
        for t, i in self.special.items():
            self.token_of[i] = t.encode()
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        # (left id, right id) -> rank, and the merged id of each rank
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault((ids[a], ids[b]), rank)
            self.made.append(ids[a + b])
        self.words = regex.compile(WORD)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit, self.short = cache, short

    def merge_short(self, parts: list[int]) -> list[int]:
        """Parts and the ranks between them lie in two plain arrays; ranks[i] is that of parts[i] and parts[i + 1]."""
        get, made = self.rank.get, self.made
        ranks = [get(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = new = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((new, parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((parts[i - 1], new), NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for long words: leftmost of the least rank from a heap, stale entries skipped."""
        n = len(parts)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.rank.get
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (rank := get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (rank, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def word_ids(self, word: str) -> list[int]:
        parts = [self.byte_id[b] for b in word.encode("utf-8", "surrogatepass")]
        return self.merge_short(parts) if len(parts) <= self.short else self.merge_long(parts)

    def chunk(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit integers."""
        words = self.words.findall(text)
        if len(words) == 1:
            return self.pack(self.word_ids(text))
        cache, out = self.cache, []
        for w in words:
            if (ids := cache.get(w)) is None:
                if (ids := self.older.get(w)) is None:
                    ids = self.pack(self.word_ids(w))
                self.keep(w, ids)
            out.append(ids)
        return b"".join(out)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= 64:
            if len(self.cache) >= self.limit:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids

    def plain(self, text: str) -> bytes:
        pieces = BETWEEN.split(text) if RUNS.search(text) or text[:1] == " " or text[-1:] == " " else text.split(" ")
        if len(pieces) == 1:
            return self.cached([pieces[0]])
        # a space belongs to the word after it
        return self.cached([pieces[0], *[" " + p for p in pieces[1:]]])

    def cached(self, pieces: list[str]) -> bytes:
        cache = self.cache
        found = [cache.get(p) for p in pieces]
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    piece = pieces[k]
                    if (ids := cache.get(piece)) is None:
                        if (ids := self.older.get(piece)) is None:
                            ids = self.chunk(piece)
                        self.keep(piece, ids)
                    found[k] = ids
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                out.append(self.plain(part))
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The tokens' bytes; sequences that aren't UTF-8 become U+FFFD, as decoders of texts show them."""
        token_of = self.token_of
        raw = b"".join([token_of[i] for i in ids])
        return raw.decode("utf-8", "replace").encode("utf-8")


_open: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary file in a Python worker."""
    if path not in _open:
        _open[path] = Codec(path)
    return _open[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in one binary value."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = codec(vocabulary).encode
        ids = [enc(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
            [id_col, "n_tokens", "ids"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from the rows of encode_documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dec = codec(vocabulary).decode
        texts = [dec(np.frombuffer(x or b"", "<u4").tolist()).decode() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(id_col, "ids"), run, f"{id_col} {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids where asked for): encodes each text and decodes its ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        n, a, b, every = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = c.encode(text)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            if with_ids:
                every.append(ids)
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(every), "<i4"))))
        return pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, pieces=True)
