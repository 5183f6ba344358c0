"""Token ids as length-delimited binary records in shards, with a separate offset index.

A record is: payload length (u64), masked checksum of those eight bytes (u32), payload, masked checksum
of the payload (u32), all little-endian. A payload is one byte (1: an id follows, 0: the id is null), the
document's id (i64) and its token ids, in 16 bits where vocabulary and end id allow it and else in 32 (the
width is in the index). A checksum is CRC-32, turned right by 15 bits plus a constant, so that a checksum
stored among the data isn't its own checksum. The index, a Parquet table beside the shards, has for each
record its shard, its place in it, its byte offset and length and its tokens: readers can shuffle records
by sorting index rows and seeking.

Shards follow each other in ascending document id (nulls first), as do the records in a shard: rows are
dealt by range and sorted, each task writes its own shards under a temporary name and renames them, so a
task that runs twice leaves the same files. Shard files are written with pyarrow's file systems to the
shared folder, by URI. Tokens come from the tokenizers library; its results for parts between single
spaces, where this vocabulary's words end in any case, are kept in a bounded cache.

Defined cases: null and empty texts give a record with the end id alone; repeated ids and rows keep one
record each, in no fixed order among equal ids; an empty table gives no shards and an empty index.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.bpe import BETWEEN, RUNS, byte_symbols
from tessera.llm.common import materialise, shared_dir

SHARD_BYTES = 64 << 20
CACHE = 1_000_000
ODD_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
INDEX = "shard string, record long, byte_offset long, byte_length long, doc_id long, n_tokens long, width int, task int, part int"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at `at` and where the next one begins; both checksums are held against the data."""
    head = bytes(data[at : at + 8])
    n, crc = struct.unpack("<QI", data[at : at + 12])
    if masked(head) != crc:
        raise ValueError(f"the length at byte {at} has a wrong checksum")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) != n or masked(payload) != struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0]:
        raise ValueError(f"the record at byte {at} is cut or has a wrong checksum")
    return payload, at + 16 + n


def plain_spaces(text: str) -> bool:
    """Whether each space stands alone between other characters, so that a split at spaces cuts nowhere else."""
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
        return False
    return text.isascii() and not any(c in text for c in ODD_SPACES) or not RUNS.search(text)


class LibraryEncoder:
    """The tokenizers library, with its results for pieces between single spaces kept up to a bound."""

    def __init__(self, path: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache: dict[str, bytes] = {}
        self.kind = "H" if width == 2 else "I"
        self.model = self.library.model
        self.symbol = [c for c, _ in sorted(byte_symbols().items(), key=lambda x: x[1])]
        self.ends = {c: self.pack(self.library.encode(c, add_special_tokens=False).ids) for c in ",."}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def word(self, piece: str) -> bytes | None:
        """Ids of a piece of letters alone, or with a comma or stop after them, by the library's model alone.

        Letters are one word to the pre-tokenizer and a sign after them another, so there is nothing to split."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return self.pack([t.id for t in self.model.tokenize("".join(map(self.symbol.__getitem__, piece.encode())))])
        if body[-1:] in self.ends and body[:-1].isalpha():
            stem = piece[:-1]
            return (piece[:1] == " " and self.cache.get(stem[1:]) or self.word(stem)) + self.ends[body[-1]]
        return None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ") if plain_spaces(text) else BETWEEN.split(text)
        first, get = pieces.pop(0), self.cache.get
        head = self.word(first)
        if head is None:
            head = self.pack(self.library.encode_batch_fast([first], add_special_tokens=False)[0].ids)
        # all others are kept without the space that belongs to them
        found = list(map(get, pieces))
        if None in found:
            missing = {p for p, ids in zip(pieces, found) if ids is None}
            got = {p: ids for p in missing if (ids := self.word(" " + p)) is not None}
            rest = [p for p in missing if p not in got]
            if rest:
                done = self.library.encode_batch_fast([" " + p for p in rest], add_special_tokens=False)
                got.update((p, self.pack(e.ids)) for p, e in zip(rest, done))
            found = [got[p] if ids is None else ids for p, ids in zip(pieces, found)]
            if len(self.cache) + len(got) > CACHE:
                self.cache.clear()
            self.cache.update((p, ids) for p, ids in got.items() if len(p) <= 64)
        return head + b"".join(found)


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def vocabulary_width(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def write_records(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, frames and writes all documents below `path`; returns the stored index."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    width = vocabulary_width(vocabulary, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := (vocabulary, width)) not in _encoders:
            _encoders[key] = LibraryEncoder(vocabulary, width)
        encode, end = _encoders[key].encode, struct.pack("<H" if width == 2 else "<I", end_id)
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        task, part, out, at, rows = TaskContext.get().partitionId(), 0, None, 0, []

        def close() -> pa.RecordBatch:
            nonlocal out, rows, part, at
            out.close()
            fs.move(temporary, f"{base}/{name}")
            cols = list(zip(*rows))
            made = pa.RecordBatch.from_arrays(
                [pa.array([f"{path}/{name}"] * len(rows)), *(pa.array(c, pa.int64()) for c in cols),
                 *(pa.array([x] * len(rows), pa.int32()) for x in (width, task, part))],
                ["shard", "record", "byte_offset", "byte_length", "doc_id", "n_tokens", "width", "task", "part"],
            )
            out, rows, at, part = None, [], 0, part + 1
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    name = f"shard-{task:06d}-{part:04d}.bin"
                    temporary = f"{base}/_{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                ids = encode(text) + end
                record = frame(struct.pack("<Bq", doc_id is not None, doc_id or 0) + ids)
                out.write(record)
                rows.append((len(rows), at, len(record), doc_id, len(ids) // width))
                at += len(record)
                if at >= SHARD_BYTES:
                    yield close()
        if out is not None:
            yield close()

    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = placed.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return materialise(placed.mapInArrow(write, INDEX))


def tokens(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    there, doc_id = struct.unpack("<Bq", payload[:9])
    return (doc_id if there else None), np.frombuffer(payload[9:], "<u2" if width == 2 else "<u4")


def read_shards(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files alone; of the index only their names are used.

    Each file is read once, by one task. What the files before it hold is added from what was read of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(row["shard"])
                with fs.open_input_stream(at) as f:
                    data = memoryview(f.read())
                before, at, rows = 0, 0, []
                while at < len(data):
                    payload, at = unframe(data, at)
                    doc_id, ids = tokens(payload, row["width"])
                    rows.append((row["task"], row["part"], doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["task", "part", "doc_id", "before", "n_tokens", "ids_crc32"])

    # by number, since the rows say nothing of the files' size and would be put into one task
    files = index.select("shard", "width", "task", "part").distinct().repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    rows = materialise(files.mapInArrow(read, "task long, part long, doc_id long, before long, n_tokens long, ids_crc32 long"))
    above = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are files
    totals = rows.groupBy("task", "part").agg(F.sum("n_tokens").alias("held"))
    first = totals.select("task", "part", F.coalesce(F.sum("held").over(above), F.lit(0)).alias("first"))
    return rows.join(first, ["task", "part"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(index_rows: DataFrame) -> DataFrame:
    """(doc_id, ids) for any rows of the index in their order, by seeking: for shuffled reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            ids, found = [], []
            for row in batch.to_pylist():
                if row["shard"] not in files:
                    fs, at = pafs.FileSystem.from_uri(row["shard"])
                    files[row["shard"]] = fs.open_input_file(at)
                data = files[row["shard"]].read_at(row["byte_length"], row["byte_offset"])
                doc_id, got = tokens(unframe(memoryview(data), 0)[0], row["width"])
                ids.append(doc_id)
                found.append(got.astype("int32").tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])
        for f in files.values():
            f.close()

    return index_rows.select("shard", "byte_offset", "byte_length", "width").mapInArrow(run, "doc_id long, ids array<int>")
