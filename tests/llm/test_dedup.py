import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import decontaminate, line_dedup, minhash_dedup
from tessera.llm.common import components
from tessera.llm.shingles import shingle_set


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows, size=4, threshold=80):
    sets = {i: frozenset(shingle_set(t, size).tolist()) for i, t in rows}
    posted, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in posted[x]).items():
            if 100 * k >= threshold * (len(s) + len(sets[j]) - k):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            posted[x].append(i)
    return {i: find(parent, i) for i in sets}


def family(seed, n, words=150, edits=(0, 12)):
    """Copies of one text with edits: most pairs lie near the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(*edits)):
            at, kind = r.randrange(len(t)), r.random()
            if kind < 0.6:
                t[at] = r.choice(vocabulary) if kind < 0.5 else "SAME"
            elif kind < 0.8:
                t.insert(at, r.choice(vocabulary))
            else:
                t.pop(at)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    r = random.Random(seed)
    texts = family(seed, 120) + family(seed + 10, 60, 40, (0, 5)) + family(seed + 20, 30, 8, (0, 2)) + ["a b", "A  b", "", " \n"] + ["once more"] * 9
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in minhash_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == brute(rows)


def test_minhash_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e", "x"), (3, "a b c d e", "x"), (3, "a b c d e", "x"), (4, "A B c\td e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, signature string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.cluster(df, size=4).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)], key=str)
    assert minhash_dedup.cluster(df.where("doc_id = 9")).count() == 0


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    parent = {i: i for e in edges for i in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got.get(i, i) == find(parent, i) for i in parent)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


LINE = "the quick brown fox jumps over the lazy dog near the old river bank today"


def test_lines(spark):
    rows = [
        (1, LINE + "\nshort\n\nshort", "k"), (2, LINE.upper() + "!\nand here are some other words indeed", "k"), (3, LINE.replace("lazy", "lzy") + "\n" + LINE, "k"),
        (4, None, "k"), (5, "", "k"), (None, LINE, "k"), (6, LINE, "k"), (6, LINE, "k"), (7, "Page 1 of the big report here\nPage 2 of the big report here", "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, places string").selectExpr("*", "places AS doc", "7 AS n_lines", "1 AS text_hash")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicate(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, rows[0][1], 4, 0), (2, "and here are some other words indeed", 2, 1), (3, "", 2, 2), (4, None, 0, 0), (5, "", 0, 0), (None, "", 1, 1),
        (6, "", 1, 1), (6, "", 1, 1), (7, "Page 1 of the big report here", 2, 1),
    ], key=str)
    assert line_dedup.deduplicate(df.where("doc_id = 99")).count() == 0


def test_near_lines_are_found(spark, sf):
    """At the least nineteen in twenty of what all pairs of lines give."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines: dict[str, int] = Counter()
    for r in docs.collect():
        lines.update(b" ".join(w).decode() for w in line_dedup.normalised(r.text) if len(w) >= line_dedup.LEAST_WORDS)
    keys = sorted(lines, key=len)
    parent = {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 100 * (len(b) - len(a)) > 15 * len(b):
                break
            if line_dedup.alike(a, b):
                parent[find(parent, a)] = find(parent, b)
    want = sum(lines.values()) - len({find(parent, k) for k in keys})
    got = line_dedup.deduplicate(docs).agg({"n_removed": "sum"}).first()[0]
    assert 0.95 * want <= got <= want


def edited(r, words, kind):
    """A line of these words with typos in some of them, or with words added at both ends."""
    w = list(words)
    if kind == "ends":
        return ["qa", *w, "qz"]
    for at in r.sample(range(len(w)), int(kind)):
        c = r.randrange(len(w[at]))
        w[at] = w[at][:c] + "q" + w[at][c + 1 :]
    return w


def test_links_between_different_lines(spark):
    """Edits anywhere in real lines: nineteen in twenty of the links at least, for each length and kind of edit."""
    r = random.Random(5)
    real = [w for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in line_dedup.normalised(x.text)]
    words = [x.decode("utf-8", "replace") for w in real for x in w if len(x) > 1]
    rows, of = [], []
    for sizes in ((5, 5), (6, 8), (9, 12), (13, 16), (17, 40), (41, 90)):
        for kind in ("1", "2", "3", "ends") + (("5",) if sizes[0] > 16 else ()):
            links = 0
            while links < 150:
                w = r.sample(words, r.randint(*sizes))
                a, b = " ".join(w), " ".join(edited(r, w, kind))
                if a != b and line_dedup.alike(a, b):
                    rows += [(2 * len(of), a), (2 * len(of) + 1, b)]
                    of.append((sizes, kind))
                    links += 1
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    found = Counter(of[x.doc_id // 2] for x in got)
    for group in sorted(set(of)):
        print(f"{group}: {found[group]} of 150")
    assert min(found[g] for g in set(of)) >= 0.95 * 150


def test_edit_distance():
    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choices("abc ", k=r.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_alike_equals_distance():
    r = random.Random(2)
    for _ in range(4000):
        a = [r.choice(["ab", "cde", "f", "ghij"]) for _ in range(r.randint(1, 14))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(b)) if b else 0
            (b.insert(at, r.choice(["ab", "x"])) if r.random() < 0.5 else b.pop(at)) if b else None
        x, y = " ".join(a), " ".join(b)
        assert line_dedup.alike(x, y) == (line_dedup.edit_distance(x, y) <= 15 * max(len(x), len(y)) // 100)


def test_counts_allow_all_that_is_alike(spark):
    """The filter inside the join lets all short pairs pass that are alike, and not all of the others."""
    r = random.Random(3)
    for n in (5, 40, 110):
        a = ["".join(r.choices("abcdeé語 ", k=n)) for _ in range(300)]
        b = ["".join(r.choice("xyz") if r.random() < 0.12 else c for c in x) for x in a]
        sizes = [max(len(x), len(y)) for x, y in zip(a, b)]
        p, q = line_dedup.counts_of(a).tolist(), line_dedup.counts_of(b).tolist()
        rows = [(k, len(x), len(y), *p[k], *q[k]) for k, (x, y) in enumerate(zip(a, b))]
        pairs = spark.createDataFrame(rows, "k long, x_size int, y_size int, x_s0 long, x_s1 long, y_s0 long, y_s1 long")
        may = {x.k for x in pairs.where(line_dedup.FITS).collect()}
        assert all(k in may for k in range(300) if line_dedup.edit_distance(a[k], b[k]) <= 15 * sizes[k] // 100)
    one, other = line_dedup.counts_of(["a" * 10, "b" * 10]).tolist()
    assert spark.createDataFrame([(0, 10, 10, *one, *other)], pairs.schema).where(line_dedup.FITS).count() == 0


def test_simhash_passes_lines_that_keep_most_words():
    r = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    passed = Counter()
    for k in range(400):
        a = r.sample(words, 40)
        b = a[: 40 - 4 * (k % 4)] + r.sample(words, 4 * (k % 4))
        n = np.array([40])
        ordered = [line_dedup.ordered(line_dedup.hash_words([x.encode() for x in w]), n, np.zeros(line_dedup.CELLS, np.uint8))[0] for w in (a, b)]
        x, y = (line_dedup.simhash(w, n).view(np.uint64)[0] for w in ordered)
        passed[k % 4] += int(np.bitwise_count(x ^ y).sum()) <= line_dedup.BITS
    assert min(passed[k] for k in range(4)) >= 97


def test_long_lists_lose_no_link(spark):
    """Families of near lines that share their rare words: one line of each stays."""
    r = random.Random(9)
    words = [f"{x}{y}" for x in ("ba", "ke", "lo", "mu", "ni", "to") for y in ("ra", "sel", "vin", "dor", "pag", "zum", "fit")]
    rows = []
    for family_ in range(3):
        base = [r.choice(words) for _ in range(20)]
        for _ in range(60):
            w = list(base)
            w[r.randrange(20)] = r.choice(words) + "x"
            rows.append((len(rows), " ".join(["common", "start", "of", "all", "lines", *w])))
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 0").collect()
    assert sorted(x.doc_id for x in got) == [0, 60, 120]


def test_digits_count_and_columns_may_clash(spark):
    a, b = "In 1999 the price was 10 euros there", "In 2024 the price was 99 euros there"
    docs = spark.createDataFrame([(1, a, "mine", "yours"), (2, b, "mine", "yours"), (3, a + "!", "mine", "yours")], "doc_id long, text string, _doc string, _hash string")
    got = sorted(line_dedup.deduplicate(docs).collect())
    assert [(r.doc_id, r.text, r._doc, r._hash, r.n_removed) for r in got] == [(1, a, "mine", "yours", 0), (2, b, "mine", "yours", 0), (3, "", "mine", "yours", 1)]


def test_texts_without_an_id_are_told_apart(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(None, "before " + item), (None, LINE + "\nand one more line of its own"), (None, LINE + "\nthis is something else again here"), (7, item), (7, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(docs, items).collect()) == sorted([rows[1][1], rows[2][1], "other words"])
    assert sorted(r.n_removed for r in line_dedup.deduplicate(docs.where("text LIKE 'the quick%'")).collect()) == [0, 1]


def test_lines_without_spaces(spark):
    chinese, thai = "今天天气很好我们一起去公园散步吧大家都很高兴", "วันนี้อากาศดีมากเราไปเดินเล่นกัน"
    rows = [(1, chinese + "\n" + thai), (2, chinese.replace("公园", "花园") + "\n其他内容在这里"), (3, thai + "\n好的"), (4, "好的")]
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, rows[0][1]), (2, "其他内容在这里"), (3, "好的"), (4, "好的")]


def test_decontamination_equals_brute_force(spark, sf):
    r = random.Random(6)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "only five words stand here"), (901, "eight words of one short item are here"), (902, "too short"), (903, None)]
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for k in range(40):
        words = r.choice(items[:30])[1].split()
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = "other"
        docs.append((10_000 + k, " ".join(["before"] * r.randint(0, 9) + words + ["after"])))
    docs += [(20_000, "so only five words stand here too"), (20_001, "and eight words of one long item are here now"), (20_002, None), (20_003, "")]
    known = [(i, decontaminate.word_hashes(t)) for i, t in items]
    want = set()
    for d, t in docs:
        h = decontaminate.word_hashes(t)
        have = set(h.tolist())
        for i, g in known:
            if not (rule := decontaminate.rule(len(g))):
                continue
            w, allowed = rule
            if sum(x in have for x in g.tolist()) < w - allowed:
                continue
            for s in range(w - len(g), len(h) - w + 1):
                lo, hi = max(0, s), min(len(h), s + len(g))
                if hi - lo >= w and decontaminate.best(h[lo:hi], g[lo - s : hi - s], w)[0] >= w - allowed:
                    want.add((d, i))
                    break
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.pairs(decontaminate.find(a, b)).collect()}
    assert got == want and (20_000, 900) in got and (20_001, 901) in got
    assert {x.doc_id for x in decontaminate.clean(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find(a, b.where("item_id = -1")).count() == 0
