import glob
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from tessera.llm import bpe, token_records
from tessera.llm.queries import vocabulary

PARTS = ["a", " ", "\n", "  ", "\t", "é", "ñ", "1", "²", "½", "Ⅷ", "'s", "'ll", "’", "<|endoftext|>", "<|", "!", ",", ". ", "日本", "🙂", " ", "　", "\x1c", "́", "_", "-", "\r", "\x85", "abc", "THE", "ª"]
EDGES = ["", " ", "a", "ab" * 3000 + "é" * 500, "x " * 50, " lead", "trail ", "a\n b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def texts():
    r = random.Random(7)
    return EDGES + ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(4000)]


def test_codec_equals_library(library):
    c = bpe.Codec(vocabulary())
    for t in texts():
        ids = np.frombuffer(c.encode(t), "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        assert c.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_short_and_long_words_agree():
    c, r = bpe.Codec(vocabulary()), random.Random(3)
    for _ in range(300):
        parts = [c.byte_id[r.choice(b"theinga ")] for _ in range(r.randint(1, 60))]
        assert c.merge_short(list(parts)) == c.merge_long(list(parts))


def test_small_cache_changes_nothing(library):
    c = bpe.Codec(vocabulary(), cache=3)
    assert all(np.frombuffer(c.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for t in texts()[:300])


def test_library_encoder_with_pieces(library):
    c = token_records.LibraryEncoder(vocabulary(), 4)
    for t in texts():
        assert np.frombuffer(c.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def docs(spark):
    rows = [(3, "hello world", 1), (1, None, 2), (2, "", 3), (7, "Ünïcode  text\n", 4), (None, "no id", 5), (7, "Ünïcode  text\n", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")


def test_records_round_trip(spark, library, tmp_path):
    path = f"file://{tmp_path}/shards"
    index = token_records.write_records(docs(spark), vocabulary(), 2, path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_records.read_shards(index).collect())
    want, start = [], 0
    for d in sorted(docs(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        want.append((start, d.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    rows = index.orderBy("byte_length")
    assert sorted((r.doc_id or -1, len(r.ids)) for r in token_records.fetch(rows).collect()) == sorted((w[1] or -1, w[2]) for w in want)


def test_starts_come_from_the_files(spark, tmp_path):
    index = token_records.write_records(docs(spark), vocabulary(), 2, f"file://{tmp_path}/f")
    want = sorted(map(tuple, token_records.read_shards(index).collect()), key=lambda r: r[1])
    false = index.withColumn("n_tokens", index.n_tokens * 7)
    assert sorted(map(tuple, token_records.read_shards(false).collect()), key=lambda r: r[1]) == want


def test_a_shared_folder_has_to_be_named():
    from types import SimpleNamespace as Some

    from tessera.llm.common import shared_dir

    session = Some(conf=Some(get=lambda name, default: default), sparkContext=Some(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_records_notice_damage(spark, tmp_path):
    index = token_records.write_records(docs(spark), vocabulary(), 2, f"file://{tmp_path}/s")
    name = sorted(glob.glob(f"{tmp_path}/s/shard-*"))[0]
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 1
    pafs.LocalFileSystem().open_output_stream(name).write(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        token_records.read_shards(index).collect()


def test_empty_table(spark):
    none = docs(spark).where("doc_id = 99")
    assert token_records.read_shards(token_records.write_records(none, vocabulary(), 2)).count() == 0
    assert bpe.round_trip(none, vocabulary()).count() == 0


def test_encode_and_decode_documents(spark):
    e = bpe.encode_documents(docs(spark), vocabulary())
    assert sorted(r.text for r in bpe.decode_documents(e, vocabulary()).collect()) == sorted(r.text or "" for r in docs(spark).collect())
