"""Very long texts, and extra columns whose names operators use themselves."""

import random

import corpus_pipeline
from tessera.llm import bpe, decontaminate, line_dedup, minhash_dedup, quality_qda, token_records, url_filter
from tessera.llm.queries import vocabulary


def long_text(seed, words=200_000):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(5000)) for _ in range(words))


def test_long_texts_in_dedup_and_decontamination(spark):
    text = long_text(1)
    item = " ".join(text.split()[150_000:150_030])
    docs = spark.createDataFrame([(1, text), (2, text + " one more"), (3, long_text(2)), (4, "short text of its own")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.cluster(docs, size=4).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.pairs(decontaminate.find(docs, items)).collect()) == [1, 2]


def test_long_lines(spark):
    """One line of a hundred thousand words, three times, beside many short ones."""
    line = long_text(3, 100_000)
    rows = [(1, line), (2, "a line of its own stands here\n" + line), (3, "\n".join(f"line number {k} of so many others here" for k in range(3)) + "\n" + line.replace("alpha", "alpa", 1))]
    got = {r.doc_id: (r.n_lines, r.n_removed, len(r.text)) for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, 0, len(line)) and got[2][:2] == (2, 1) and got[2][2] == len("a line of its own stands here") and got[3][1] >= 1


def test_long_texts_are_scored(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab" if i % 2 else "the of and words here are good".split()) for _ in range(80))) for i in range(60)] + [(100, long_text(5)), (101, "x" * 500_000)]
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality_qda.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 62 and all(0 <= x.score <= 1 for x in got)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "hello world of words", "a", 1, "b"), (2, "hello again world", "a", 1, "b")], "doc_id long, text string, start string, n_tokens int, ids string")
    read = token_records.read_shards(token_records.write_records(docs, vocabulary(), 2)).collect()
    assert [(r.doc_id, r.start) for r in sorted(read)] == [(1, 0), (2, sorted(read)[0].n_tokens)]
    assert sorted(r.doc_id for r in bpe.round_trip(docs, vocabulary(), with_ids=True).collect()) == [1, 2]
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    odd = spark.createDataFrame([(1, "so " + item, "x", 2, "y"), (2, "none of it", "x", 2, "y")], "doc_id long, text string, text_hash string, words int, item_id string")
    items = spark.createDataFrame([(9, item, 1)], "item_id long, text string, doc_id int")
    assert [(r.doc_id, r.item_id) for r in decontaminate.pairs(decontaminate.find(odd, items)).collect()] == [(1, 9)]
    left = decontaminate.clean(odd, items).collect()
    assert [(r.doc_id, r.text_hash, r.words, r.item_id) for r in left] == [(2, "x", 2, "y")]


def test_long_urls_and_clashing_columns(spark):
    rows = [(k, f"http://{'a' * 5}.net/{k}", "h", 1.0, True) for k in range(40)] + [(k, f"http://good.org/fr/{k}", "h", 1.0, True) for k in range(40, 80)]
    rows += [(100, "http://long.com/" + "p" * 200_000, "h", 1.0, True), (101, None, "h", 1.0, True), (102, "", "h", 1.0, True)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, score double, accepted boolean")).collect()}
    assert len(got) == 83 and got[0].verdict == "block" and got[40].verdict == "allow" and got[100].host == "long.com" and len(got[100].path) == 200_001
    assert (got[101].host, got[101].path, got[101].rule) == ("", "", None) and all(r.verdict in ("allow", "block") for r in got.values())


def test_stages_on_odd_rows(spark, sf):
    """Base rules reject all three rows; the other stages keep all of them, as they are."""
    rows = [(1, None, "en", None, None), (None, "w " * 80, "en", "s", 160), (3, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [[tuple(r) for r in stage(spark, docs, sf).collect()] for _, stage in corpus_pipeline.STAGES]
    assert kept[0] == [] and all(sorted(k, key=str) == sorted(rows, key=str) for k in kept[1:4])
    assert sorted((r[0] or 0, r[1]) for r in kept[4])[1:] == [(1, 0), (3, 0)] and len(kept[4]) == 3
    assert [stage(spark, docs.where("doc_id = 9"), sf).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
