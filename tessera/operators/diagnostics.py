"""Statistics of rankings, texts and similarities: frequency, concentration, overlap, group means, rank correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import content_words, fold, let, runs, word_tokens
from tessera.functions.vectors import dot, doubles, norm
from tessera.operators.neighbours import _block_pairs, products
from tessera.sources.sinks import stored

#: Ranges of equal width in which values are counted before quantiles are looked for.
RANGES = 4096
#: Ranges in which cosines of all pairs are counted, values of a range that may be sorted, and what two runs' cosines may differ by.
COSINE_RANGES, MANY, SLACK = 1 << 18, 1 << 22, 1e-12


def frequencies(ranked: DataFrame, universe: DataFrame) -> DataFrame:
    """(card_id, freq) over the whole universe; cards that no ranking holds have 0."""
    counts = ranked.groupBy("card_id").agg(F.count("*").alias("freq"))
    return universe.select("card_id").distinct().join(counts, "card_id", "left").select("card_id", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def histogram(freq: DataFrame) -> DataFrame:
    """(freq, n_cards)."""
    return freq.groupBy("freq").agg(F.count("*").alias("n_cards"))


def gini(freq: DataFrame, value: str = "freq") -> DataFrame:
    """One row `gini`: 2 sum(i x_i) / (n sum x) - (n + 1) / n over ascending x, zeros included; 0 without mass.

    Equal values are counted first and share their mean place, so that what is sorted is the distinct values."""
    kinds = freq.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = kinds.withColumn("place_sum", F.col("n") * (upto - F.col("n")) + F.col("n") * (F.col("n") + 1) / 2)
    s = placed.agg(F.sum(F.col("place_sum") * F.col("x")).alias("ix"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("sx"))
    g = 2 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n")
    return s.select(F.round(F.when(F.coalesce("sx", F.lit(0)) == 0, F.lit(0.0)).otherwise(g), 6).alias("gini"))


def ranking_stats(ranked: DataFrame, group: DataFrame, top: int = 10) -> DataFrame:
    """One row: slots, distinct cards, the group's share of slots and the share of the `top` most frequent cards."""
    counts = ranked.groupBy("card_id").agg(F.count("*").alias("freq"))
    marked = counts.join(group.select("card_id").distinct().withColumn("mine", F.lit(1)), "card_id", "left")
    most = counts.orderBy(F.desc("freq"), "card_id").limit(top).agg(F.sum("freq").alias("top_slots"))
    total = marked.agg(F.sum("freq").alias("slots"), F.count("*").alias("unique_cards"), F.sum(F.when(F.col("mine") == 1, F.col("freq")).otherwise(0)).alias("mine"))
    return total.crossJoin(most).select(
        "slots", "unique_cards", F.round(F.col("mine") / F.col("slots"), 6).alias("group_share"), F.round(F.col("top_slots") / F.col("slots"), 6).alias("top_share")
    )


def mean_overlap(ranked: DataFrame, baseline: DataFrame) -> DataFrame:
    """A10: one row: mean over queries of the share of the baseline's cards that are still there."""
    base = baseline.groupBy("query_id").agg(F.count("*").alias("n"))
    both = ranked.select("query_id", "card_id").join(baseline.select("query_id", "card_id"), ["query_id", "card_id"]).groupBy("query_id").agg(F.count("*").alias("c"))
    return base.join(both, "query_id", "left").agg(F.round(F.avg(F.coalesce("c", F.lit(0)) / F.col("n")), 6).alias("mean_overlap"))


def document_statistics(docs: DataFrame, group: str) -> DataFrame:
    """Lengths, words and type-token ratio by group; quartiles by index, the median averaged.

    Quartiles come from counts of each length, so no group is collected."""
    t = docs.select(F.col(group).alias("grp"), F.length("text").alias("chars"), word_tokens(F.lower("text")).alias("w"))
    t = t.select("grp", "chars", F.size("w").alias("words"), F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / F.size("w")).otherwise(0.0).alias("ttr"))
    by_length = t.groupBy("grp", "chars").agg(F.count("*").alias("n"))
    up = Window.partitionBy("grp").orderBy("chars").rowsBetween(Window.unboundedPreceding, 0)
    placed = by_length.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy("grp"))})

    def at(index: str) -> Column:
        return F.min(F.when(F.col("upto") > F.expr(index), F.col("chars")))

    quart = placed.groupBy("grp").agg(
        at("total div 4").alias("chars_p25"), at("(3 * total) div 4").alias("chars_p75"),
        ((at("(total - 1) div 2") + at("total div 2")) / 2).alias("chars_median"),
    )
    basic = t.groupBy("grp").agg(
        F.count("*").alias("n"), F.min("chars").alias("chars_min"), F.max("chars").alias("chars_max"),
        F.round(F.avg("chars"), 4).alias("chars_mean"), F.round(F.avg("words"), 4).alias("words_mean"), F.round(F.avg("ttr"), 6).alias("ttr_mean"),
    )
    return basic.join(quart, "grp")


def repeated_lines(docs: DataFrame, group: Column, least: int = 2) -> DataFrame:
    """(line, n_docs, n_group): lines of several documents; a line counts once a document."""
    lines = docs.select("doc_id", group.alias("mine"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("trim(line) <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n_docs"), F.count_if("mine").alias("n_group")).where(F.col("n_docs") >= least)


def generic_items(items: DataFrame, item: str) -> DataFrame:
    """Items counted more than once, repeats in one card included."""
    return items.groupBy(item).agg(F.count("*").alias("n")).where("n > 1")


def group_cosines(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean cosine of each query to the cards of each group."""
    return scores.join(groups.select("card_id", "grp"), "card_id").groupBy("query_id", "grp").agg(F.round(F.avg("cosine"), 6).alias("mean_cosine"))


def unit_sums(cards: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, total): the sum of the unit vectors of each key; its length squared is the sum of all cosines.

    Means over all pairs need no pairs this way: one pass over the vectors instead of one over their square."""
    v = doubles("vector")
    unit = cards.select(*keys, F.posexplode(F.transform(v, lambda x: x / norm(v))).alias("at", "x"))
    by = unit.groupBy(*keys, "at").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return by.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"))


def query_group_cosines(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """The same as `group_cosines` of (query_id, query_vector) and (card_id, vector, grp), the query's own card left out.

    A mean cosine to a group comes from the sum of its unit vectors, so there is no row for each pair."""
    v = doubles("query_vector")
    q = queries.select("query_id", F.transform(v, lambda x: x / norm(v)).alias("u"))
    u = doubles("vector")
    own = cards.select(F.col("card_id").alias("query_id"), F.col("grp").alias("own"), F.transform(u, lambda x: x / norm(u)).alias("ou"))
    with_own = q.join(own, "query_id", "left")
    both = with_own.crossJoin(unit_sums(cards, ["grp"]))  # a row for each group
    mine = F.col("own").eqNullSafe(F.col("grp")) & F.col("ou").isNotNull()
    n = F.col("n") - F.when(mine, 1).otherwise(0)
    total = dot(F.col("u"), F.col("total")) - F.when(mine, dot(F.col("u"), F.col("ou"))).otherwise(0.0)
    return both.where(n > 0).select("query_id", "grp", F.round(total / n, 6).alias("mean_cosine"))


def group_similarity(cards: DataFrame, group: str) -> DataFrame:
    """(a, b, pairs, mean_cosine) of groups a <= b, a card's similarity to itself left out."""
    s = unit_sums(cards, [group])
    a, b = s.toDF("a", "na", "ta"), s.toDF("b", "nb", "tb")
    both = a.join(b, F.col("a") <= F.col("b"))
    inside = F.col("a") == F.col("b")
    pairs = F.when(inside, F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb"))
    total = dot(F.col("ta"), F.col("tb")) - F.when(inside, F.col("na")).otherwise(0)
    return both.select("a", "b", pairs.alias("pairs"), F.round(F.when(pairs > 0, total / pairs), 6).alias("mean_cosine"))


def centrality(cards: DataFrame) -> DataFrame:
    """(card_id, centrality): mean cosine to all other cards, from the sum of all unit vectors."""
    s = unit_sums(cards.withColumn("one", F.lit(1)), ["one"])
    v = doubles("vector")
    one = cards.select("card_id", F.transform(v, lambda x: x / norm(v)).alias("u")).crossJoin(F.broadcast(s))  # a single row
    return one.select("card_id", F.round((dot(F.col("u"), F.col("total")) - 1) / (F.col("n") - 1), 6).alias("centrality"))


def quantiles(df: DataFrame, value: str, at: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact quantiles with linear interpolation, one column each; nulls don't count, no values give nulls.

    Equal values are counted first. Ranges of equal width are counted next, and only those that hold a wanted place
    are sorted, each by itself: no buffer and no task sees all values."""
    kinds = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    ends = kinds.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES)).otherwise(0)
    placed = kinds.crossJoin(ends).withColumn("part", part)  # `ends` is a single row
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # over the ranges, RANGES + 1 at most
    counts = placed.groupBy("part", "total").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(up))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(g(F.lit(p) * (F.col("total") - 1)).cast("long")) for p in at for g in (F.floor, F.ceil)])))
    places = counts.select("part", (F.col("upto") - F.col("m")).alias("below"), "upto", "total", F.explode(wanted).alias("place")).where("place >= below AND place < upto")
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = placed.select("part", "x", "n").join(places.select("part", "below").distinct(), "part").withColumn("end", F.col("below") + F.sum("n").over(inside))
    hit = (F.col("place") >= F.col("end") - F.col("n")) & (F.col("place") < F.col("end"))
    found = sorted_.join(places.select("part", "place", "total"), "part").where(hit)

    def quantile(p: float) -> Column:
        h = F.lit(p) * (F.col("total") - 1)
        low, high = (F.max(F.when(F.col("place") == g(h).cast("long"), F.col("x"))) for g in (F.floor, F.ceil))
        return F.round(low + (high - low) * F.max(h - F.floor(h)), 6).alias(f"q{round(100 * p)}")

    return found.agg(*map(quantile, at))


def _counted(pairs: DataFrame, ranges: list[tuple[float, float]]) -> list[tuple[int, np.ndarray]]:
    """For each range: how many cosines are below it, and how many in each of its COSINE_RANGES parts."""
    shared, parts = pairs.sparkSession.sparkContext.broadcast(ranges), COSINE_RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, cells = np.zeros(len(shared.value), np.int64), np.zeros((len(shared.value), parts), np.int64)
        for r in products(batches):
            for k, (low, high) in enumerate(shared.value):
                below[k] += np.count_nonzero(r < low)
                x = r if (low, high) == (-np.inf, np.inf) else r[(r >= low) & ((r < high) | (high == np.inf))]
                cells[k] += np.bincount(_part(x, low, high, parts), minlength=parts)
        for k in range(len(shared.value)):
            at = np.nonzero(cells[k])[0]
            n = len(at) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(cells[k][at], below[k]))], ["k", "part", "n"])

    got = pairs.mapInArrow(count, "k int, part int, n long").groupBy("k", "part").agg(F.sum("n").alias("n")).toArrow()
    k, part, n = (got[c].to_numpy() for c in ("k", "part", "n"))
    out = []
    for i in range(len(ranges)):
        cells = np.zeros(COSINE_RANGES, np.int64)
        inside = (k == i) & (part >= 0)
        cells[part[inside]] = n[inside]
        out.append((int(n[(k == i) & (part < 0)].sum()), cells))
    return out


def _ends(low: float, high: float) -> tuple[float, float]:
    return max(low, -1.0), min(high, 1.0)


def _part(x: np.ndarray, low: float, high: float, parts: int) -> np.ndarray:
    """The part of a range that values lie in; what is beyond -1 and 1 counts with the outermost."""
    a, b = _ends(low, high)
    return ((np.clip(x, a, b) - a) * (parts / (b - a))).astype(np.int32).clip(0, parts - 1)


def cosine_quantiles(queries: DataFrame, cards: DataFrame, at: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """`quantiles` of the cosines of each query (query_id, query_vector) to all cards (card_id, vector) but itself.

    Products of blocks are counted by ranges where they are made; then the ranges that hold a wanted place, made narrower
    as long as one has more than MANY values, give their values and how many are below. So there is no row for each pair."""
    spark = queries.sparkSession
    pairs = _block_pairs(queries.where("query_id IS NOT NULL").select("query_id", "query_vector"), cards.where("card_id IS NOT NULL").select("card_id", "vector"), ("query_id",))
    found = _counted(pairs, [(-np.inf, np.inf)])
    total = int(found[0][1].sum())
    wanted = sorted({int(g(p * (total - 1))) for p in at for g in (np.floor, np.ceil)}) if total else []
    ranges, done = [(-np.inf, np.inf)], []
    while ranges:
        narrower = {}
        for (low, high), (below, cells) in zip(ranges, found):
            upto = below + np.cumsum(cells)
            a, b = _ends(low, high)
            edge = lambda k: a + (b - a) * k / COSINE_RANGES
            for k in {int(np.searchsorted(upto, w, "right")) for w in wanted if below <= w < upto[-1]}:
                own = (low if k == 0 else edge(k) - SLACK, high if k == COSINE_RANGES - 1 else edge(k + 1) + SLACK)
                narrower[own] = cells[k]
        done += [own for own, n in narrower.items() if n <= MANY or min(own[1], 1.0) - max(own[0], -1.0) < 8 * SLACK]
        ranges = [own for own in narrower if own not in done]
        found = _counted(pairs, ranges) if ranges else []
    shared = spark.sparkContext.broadcast(sorted(set(done)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(shared.value), np.int64)
        for r in products(batches):
            for k, (low, high) in enumerate(shared.value):
                below[k] += np.count_nonzero(r < low)
                x, n = np.unique(r[(r >= low) & ((r < high) | (high == np.inf))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(np.where(np.isinf(x), np.nan, x), from_pandas=False), pa.array(n.astype(np.int64))], ["k", "x", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(below), dtype=np.int32)), pa.nulls(len(below), pa.float64()), pa.array(below)], ["k", "x", "n"])

    kinds = pairs.mapInArrow(listed, "k int, x double, n long").groupBy("k", "x").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("k").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)  # first what is below
    upto = kinds.withColumn("upto", F.sum("n").over(up)).where("x IS NOT NULL")
    places = spark.createDataFrame([(w,) for w in wanted], "place long")
    hit = upto.join(F.broadcast(places), (F.col("place") >= F.col("upto") - F.col("n")) & (F.col("place") < F.col("upto"))).groupBy("place").agg(F.min("x").alias("x"))

    def quantile(p: float) -> Column:
        h = p * (total - 1)
        low, high = (F.max(F.when(F.col("place") == int(g(h)), F.col("x"))) for g in (np.floor, np.ceil))
        return F.round(low + (high - low) * float(h - np.floor(h)), 6).alias(f"q{round(100 * p)}")

    return hit.agg(*map(quantile, at))


def mean_ranks(df: DataFrame, group: str, x: str, name: str) -> DataFrame:
    """(group, x, name): the mean rank of each distinct value, nulls first; sorts distinct values, not rows."""
    up = Window.partitionBy(group).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(group, x).agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(up))
    return counts.select(F.col(group).alias(f"{name}_g"), F.col(x).alias(f"{name}_x"), (F.col("upto") - (F.col("m") - 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Rank correlation by group, ties with their mean rank; null where one side has a single value.

    Equal pairs are counted before anything is ranked. The mean of a group's ranks is known, (n + 1) / 2, so the
    sums are of small differences."""
    pairs = df.groupBy(group, a, b).agg(F.count("*").alias("n"))
    out = pairs
    for x, name in ((a, "ra"), (b, "rb")):
        ranks = mean_ranks(pairs, group, x, name)
        out = out.join(ranks, F.col(group).eqNullSafe(F.col(f"{name}_g")) & F.col(x).eqNullSafe(F.col(f"{name}_x"))).drop(f"{name}_g", f"{name}_x")
    sizes = pairs.groupBy(F.col(group).alias("sizes_g")).agg(((F.sum("n") + 1) / 2).alias("mid"))
    off = out.join(sizes, F.col(group).eqNullSafe(F.col("sizes_g"))).select(group, "n", (F.col("ra") - F.col("mid")).alias("da"), (F.col("rb") - F.col("mid")).alias("db"))
    total = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y))
    return off.groupBy(group).agg(F.round(F.try_divide(total("da", "db"), F.sqrt(total("da", "da")) * F.sqrt(total("db", "db"))), 6).alias("spearman"))


def union_stats(union: DataFrame) -> DataFrame:
    """One row: size of the union over the queries, cards found by both routes, distinct cards."""
    per = union.groupBy("query_id").agg(F.count("*").alias("size"), F.count_if(F.size("found_by") == 2).alias("both"))
    sizes = per.agg(F.round(F.avg("size"), 6).alias("size_mean"), F.min("size").alias("size_min"), F.max("size").alias("size_max"), F.round(F.avg("both"), 6).alias("both_mean"))
    return sizes.crossJoin(union.agg(F.countDistinct("card_id").alias("unique_cards")))


def compare_runs(old: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """(query_id, common, share, entered, left): what changed between two runs' cards."""
    keys = ["query_id", "card_id"]
    both = old.select(*keys, F.lit(1).alias("o")).join(new.select(*keys, F.lit(1).alias("n")), keys, "full_outer")
    return both.groupBy("query_id").agg(
        F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("common"),
        F.round(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()) / n, 6).alias("share"),
        F.count_if(F.col("o").isNull()).alias("entered"), F.count_if(F.col("n").isNull()).alias("left_out"),
    )


def holders(queries: DataFrame, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(doc_id, *keys, ids): for each document that shares a run with a query, the queries it shares one with.

    `queries` is (query_id, run), `docs` (doc_id, *keys, run). The queries of a run are one list before the join, so a run
    that stands in many of both costs a row for each document, not one for each pair; a document's lists are merged
    where it lies, and a hot run's documents can be split, as they are only streamed past its list."""
    lists = queries.groupBy("run").agg(F.collect_set("query_id").alias("ids"))
    met = docs.join(lists, "run").groupBy("doc_id", *keys).agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    return met


def lexical_overlap(queries: DataFrame, docs: DataFrame, term_words: int = 3) -> DataFrame:
    """(query_id, grp, n_docs): documents of each group that hold some run of so many words of a query.

    An equi-join on the runs takes the place of a comparison of every query with every document."""
    q = queries.select("query_id", F.explode(runs(word_tokens(F.lower("text")), term_words)).alias("run"))
    d = docs.select("doc_id", "grp", F.explode(runs(word_tokens(F.lower("text")), term_words)).alias("run"))
    return holders(q, d, ["grp"]).select("grp", F.explode("ids").alias("query_id")).groupBy("query_id", "grp").agg(F.count("*").alias("n_docs"))


def reused_runs(queries: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, n_docs, n_shared): documents that hold some run of n folded words of a query, and how many of its runs stand in any."""
    q = queries.select("query_id", F.explode(run_hashes("text", n)).alias("r")).select("query_id", "r.*")
    d = docs.select("doc_id", F.explode(run_hashes("text", n)).alias("r")).select("doc_id", "r.*")
    lists = q.groupBy("run", "check").agg(F.collect_set("query_id").alias("ids"))
    met = stored(d.join(lists, ["run", "check"]))
    per = met.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    found = per.select(F.explode("ids").alias("query_id")).groupBy("query_id").agg(F.count("*").alias("n_docs"))
    shared = q.distinct().join(met.select("run", "check").distinct(), ["run", "check"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_shared"))
    return shared.join(found, "query_id", "left").select("query_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "n_shared")


def run_hashes(text: str, n: int) -> Column:
    """The runs of n folded words as (run, check), hashes of 64 and 32 bits: a run is no string of its own, and may come twice."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        words = lambda i: [F.get(w, i + k) for k in range(n)]
        return F.transform(at, lambda i: F.struct(F.xxhash64(*words(i)).alias("run"), F.hash(*words(i)).alias("check")))

    return let(word_tokens(fold(text)), of)


def token_jaccard(queries: DataFrame, docs: DataFrame, longer_than: int = 3) -> DataFrame:
    """(query_id, doc_id, jaccard) of content words, where there is a common one: joined on the words.

    Nearly every pair has a common word, so this is for small sets; similar_sets.similar asks for a least similarity."""
    q = queries.select("query_id", content_words("text", longer_than).alias("w"))
    d = docs.select("doc_id", content_words("text", longer_than).alias("w"))
    qs, ds = q.select("query_id", F.size("w").alias("nq"), F.explode("w").alias("word")), d.select("doc_id", F.size("w").alias("nd"), F.explode("w").alias("word"))
    common = qs.join(ds, "word").groupBy("query_id", "doc_id", "nq", "nd").agg(F.count("*").alias("c"))
    return common.select("query_id", "doc_id", F.round(F.col("c") / (F.col("nq") + F.col("nd") - F.col("c")), 6).alias("jaccard"))


def pool_quality(pool: DataFrame, ranked: DataFrame, gold: DataFrame, weak_after: int = 30, head: int = 5) -> DataFrame:
    """(query_id, pool_size, recall, weak_share, views_hit): gold cards found, weak cards, views with a head card in."""
    best = ranked.groupBy("query_id", "card_id").agg(F.min("rank").alias("best"))
    own = pool.select("query_id", "card_id").join(best, ["query_id", "card_id"], "left").join(gold.select("query_id", "card_id", F.lit(1).alias("g")), ["query_id", "card_id"], "left")
    per = own.groupBy("query_id").agg(F.count("*").alias("pool_size"), F.count("g").alias("found"), F.count_if(F.coalesce("best", F.lit(1 << 30)) > weak_after).alias("weak"))
    views = ranked.where(F.col("rank") <= head).join(pool.select("query_id", "card_id"), ["query_id", "card_id"], "left_semi").groupBy("query_id").agg(F.countDistinct("view").alias("views_hit"))
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    out = per.join(views, "query_id", "left").join(wanted, "query_id", "left")
    return out.select("query_id", "pool_size", F.round(F.col("found") / F.col("n_gold"), 6).alias("recall"), F.round(F.col("weak") / F.col("pool_size"), 6).alias("weak_share"), F.coalesce("views_hit", F.lit(0)).alias("views_hit"))


def pool_spread(pool: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, spread): mean cosine between the cards of a pool, from the sum of their unit vectors; null for one card."""
    s = unit_sums(pool.select("query_id", "card_id").join(cards.select("card_id", "vector"), "card_id"), ["query_id"])
    n = F.col("n")
    return s.select("query_id", F.round(F.try_divide(dot(F.col("total"), F.col("total")) - n, n * (n - 1)), 6).alias("spread"))


def hubs(pool: DataFrame, top: int = 3) -> DataFrame:
    """(card_id, freq) of the cards that most pools hold."""
    return pool.groupBy("card_id").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "card_id").limit(top)


def tag_sets(cards: DataFrame, tags: str, order: str, top: int = 5) -> DataFrame:
    """(tags, n) of the most common tag lists, in the order in which they first come; no list counts as an empty one."""
    lists = cards.select(F.coalesce(tags, F.array().cast("array<string>")).alias(tags), order)
    return lists.groupBy(tags).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(top).drop("first")


def template_counts(cards: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(field, n): cards whose field begins with its template."""
    counts = cards.agg(*[F.count_if(F.startswith(F.col(f), F.lit(p))).alias(f) for f, p in prefixes.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in prefixes])).alias("r")).select("r.*")


def case_study(studied: DataFrame, cards: DataFrame, ranked: DataFrame) -> DataFrame:
    """(card_id, centrality, centrality_rank, freq, best_rank) of the cards `studied`: a stated set against all.

    A rank is one more than the number of cards with a higher mean: sums of counts of the distinct means, which have six digits
    and so are two million at the most."""
    means = centrality(cards)
    mine = means.join(studied.select("card_id").distinct(), "card_id", "left_semi")
    before = Window.orderBy(F.desc("centrality")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = means.groupBy("centrality").agg(F.count("*").alias("n"))
    ranks = kinds.select(F.col("centrality").alias("mean"), (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("centrality_rank"))
    higher = mine.join(ranks, F.col("centrality").eqNullSafe(F.col("mean"))).drop("mean")
    found = ranked.groupBy("card_id").agg(F.count("*").alias("freq"), F.min("rank").alias("best_rank"))
    return higher.join(found, "card_id", "left").select("card_id", "centrality", "centrality_rank", F.coalesce("freq", F.lit(0)).alias("freq"), "best_rank")


def text_shares(text: str, generic: Column, prefixes: Sequence[str]) -> Column:
    """Share of a text's characters in lines that are generic or begin with a structural prefix."""
    lines = F.split(text, "\n")
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    plain = F.filter(lines, lambda x: F.array_contains(generic, x) | F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(x, p)))
    return F.when(total > 0, F.aggregate(plain, F.lit(0), lambda s, x: s + F.length(x)) / total).otherwise(0.0)


def pool_changes(before: DataFrame, after: DataFrame, key: str = "query_id") -> DataFrame:
    """(query, n_before, n_after, n_kept, same): pools of two documents' versions or with and without a guardrail.

    A query without a pool on one side counts as one with an empty pool."""
    a = before.select(key, "card_id").distinct().withColumn("_b", F.lit(1))
    b = after.select(key, "card_id").distinct().withColumn("_a", F.lit(1))
    n = a.join(b, [key, "card_id"], "full_outer").groupBy(key).agg(
        F.count("_b").alias("n_before"), F.count("_a").alias("n_after"), F.count(F.col("_b") + F.col("_a")).alias("n_kept"), F.count("*").alias("_all")
    )
    return n.select(key, "n_before", "n_after", "n_kept", (F.col("n_kept") == F.col("_all")).alias("same"))


def mode_summary(**pools: DataFrame) -> DataFrame:
    """(mode, n_queries, n_picks, n_cards, top_count): how each retrieval mode spreads over the cards.

    `top_count` is how often the most frequent card was picked; counts by mode and card come first, so a frequent card is no hot key."""
    rows = None
    for mode, pool in pools.items():
        mine = pool.select(F.lit(mode).alias("mode"), "query_id", "card_id")
        rows = mine if rows is None else rows.unionByName(mine)
    cards = rows.groupBy("mode", "card_id").agg(F.count("*").alias("n"))
    spread = cards.groupBy("mode").agg(F.sum("n").alias("n_picks"), F.count("*").alias("n_cards"), F.max("n").alias("top_count"))
    return spread.join(rows.groupBy("mode").agg(F.countDistinct("query_id").alias("n_queries")), "mode")
