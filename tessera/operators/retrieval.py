"""Retrieval routes: cosine and tag ranking, the diversity cap, the candidate union and fusion of views.

Queries and cards are DataFrames; every ranking is total, with the card's id as the last key. The query side
is a stated set, so rankings compare it with all cards and keep k rows of each query: Spark limits each
partition's rows of a window before it shuffles them (WindowGroupLimit), and decides by size whether a side
is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import unqualified
from tessera.functions.vectors import dot, doubles, norm
from tessera.operators import rank_sums, tag_classes
from tessera.operators.neighbours import best_cosines

PER_SOURCE, POOL, SCAN = 3, 15, 45
RRF_K = rank_sums.RRF_K


def best(df: DataFrame, keys: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within `keys`; at most k of each."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def cosine_scores(queries: DataFrame, cards: DataFrame, query_keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*query_keys, card_id, cosine), unrounded. Both norms are computed once a vector, not once a pair."""
    q = queries.select(*query_keys, doubles("query_vector").alias("qv")).withColumn("qn", norm(F.col("qv")))
    c = cards.select("card_id", doubles("vector").alias("v")).withColumn("n", norm(F.col("v")))
    return q.crossJoin(c).select(*query_keys, "card_id", (dot(F.col("qv"), F.col("v")) / (F.col("qn") * F.col("n"))).alias("cosine"))


def cosine_rank(queries: DataFrame, cards: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """(query_id, card_id, rank, cosine): ranked unrounded, then rounded to 6 digits.

    `apart` leaves out the card that is the query itself."""
    s = best_cosines(queries, cards, k, apart=apart)
    return best(s, ["query_id"], [F.desc("cosine"), F.asc("card_id")], k).withColumn("cosine", F.round("cosine", 6))


#: Distinct tags of queries up to which overlaps are counted on bit masks: the declared vocabularies have fewer.
TAGS = 256
STRUCTURE_ORDER = ["tension_overlap", "coordinate_overlap"]


def tag_sides(queries: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as (id, coordinates, tensions) with names of their own; a qualifier after a card's tension doesn't count."""
    q = queries.select("query_id", F.col("coordinates").alias("qc"), F.col("tensions").alias("qt"))
    return q, cards.select("card_id", F.col("coordinates").alias("cc"), unqualified("tensions").alias("ct"))


def masked(df: DataFrame, names: dict[str, str], vocabulary: list[str]) -> DataFrame:
    """`df` with its tag arrays put in bit masks of the vocabulary, 63 tags a long."""
    zero = F.lit(0).cast("long")

    def mask(array: str, tags: list[str]) -> Column:
        bits = F.create_map(*[F.lit(x) for k, tag in enumerate(tags) for x in (tag, 1 << k)])
        held = F.filter(array, lambda t: t.isNotNull())
        return F.aggregate(held, zero, lambda m, t: m.bitwiseOR(F.coalesce(F.element_at(bits, t).cast("long"), zero)))

    out = {f"{name}{at // 63}": F.coalesce(mask(array, vocabulary[at : at + 63]), zero) for array, name in names.items() for at in range(0, len(vocabulary), 63)}
    return df.withColumns(out).drop(*names)


def mask_sides(q: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame, int] | None:
    """Both of tag_sides as (id, masks of tensions, masks of coordinates) and the masks a kind; None if there are too many tags.

    Only tags of queries can match. Those of a closed vocabulary fit in bit masks, so a pair costs some bit counts."""
    tags = q.select(F.explode(F.concat(F.coalesce("qc", F.array()), F.coalesce("qt", F.array()))).alias("t")).where("t IS NOT NULL").distinct()
    vocabulary = sorted(r.t for r in tags.limit(TAGS + 1).collect())
    if not 0 < len(vocabulary) <= TAGS:
        return None
    return masked(q, {"qt": "qt", "qc": "qc"}, vocabulary), masked(c, {"ct": "ct", "cc": "cc"}, vocabulary), (len(vocabulary) + 62) // 63


def structure_counts(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """R2: (query_id, card_id, tension_overlap, coordinate_overlap) where there is any (F10): a row for each pair."""
    q, c = tag_sides(queries, cards)
    sides = mask_sides(q, c)
    if sides is None:
        both = q.crossJoin(c).select("query_id", "card_id", F.size(F.array_intersect("qt", "ct")).alias("tension_overlap"), F.size(F.array_intersect("qc", "cc")).alias("coordinate_overlap"))
    else:
        x, y, words = sides[0], sides[1], range(sides[2])
        overlap = lambda k: sum((F.bit_count(F.col(f"q{k}{w}").bitwiseAND(F.col(f"c{k}{w}"))) for w in words), F.lit(0))
        both = x.crossJoin(y).select("query_id", "card_id", overlap("t").alias("tension_overlap"), overlap("c").alias("coordinate_overlap"))
    return both.where("tension_overlap + coordinate_overlap > 0")


def with_matches(pairs: DataFrame, queries: DataFrame, cards: DataFrame) -> DataFrame:
    """`pairs` with their matched tags, sorted."""
    q, c = tag_sides(queries, cards)
    both = pairs.join(q, "query_id").join(c, "card_id")
    matched = {"matched_tensions": F.sort_array(F.array_intersect("qt", "ct")), "matched_coordinates": F.sort_array(F.array_intersect("qc", "cc"))}
    return both.withColumns(matched).select(*pairs.columns, *matched)


def structure_scores(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """R2: overlaps and matched tags of each query and card."""
    return with_matches(structure_counts(queries, cards), queries, cards)


def structure_rank(queries: DataFrame, cards: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """R2: by tension overlap, then coordinate overlap, then id; matched tags are listed for what is kept."""
    queries, cards = queries.where("query_id IS NOT NULL"), cards.where("card_id IS NOT NULL")
    down = [F.desc(o) for o in STRUCTURE_ORDER]
    sides = mask_sides(*tag_sides(queries, cards))
    if sides is None:
        s = structure_counts(queries, cards)
        kept = best(s.where("query_id <> card_id") if apart else s, ["query_id"], [*down, F.asc("card_id")], k)
        return with_matches(kept, queries, cards)
    # equal sets are one class: its first cards, one more than k for the query itself, stand for all of it
    x, y, _ = sides
    q, c = tag_classes.classes(x), tag_classes.classes(y)
    n = k + 1 if apart else k
    pairs = tag_classes.best_pairs(q, c, n).join(c[0].select(*c[1], "first"), c[1])
    pairs = best(pairs, q[1], [*down, F.asc("first")], n, "place").drop("place", "first")
    first = best(y, c[1], [F.asc("card_id")], n, "place").drop("place")
    found = best(pairs.join(first, c[1]), q[1], [*down, F.asc("card_id")], n, "place").select(*q[1], "card_id", *STRUCTURE_ORDER)
    s = x.join(found, q[1])
    s = s.where("query_id <> card_id") if apart else s
    kept = best(s.select("query_id", "card_id", *STRUCTURE_ORDER), ["query_id"], [*down, F.asc("card_id")], k)
    return with_matches(kept, queries, cards)


def overlap_counts(queries: DataFrame, cards: DataFrame, apart: bool = False) -> DataFrame:
    """(query_id, tension_overlap, coordinate_overlap, n): how many cards have each pair of overlaps with a query, by classes of equal sets."""
    if apart:
        queries, cards = queries.where("query_id IS NOT NULL"), cards.where("card_id IS NOT NULL")
    sides = mask_sides(*tag_sides(queries, cards))
    if sides is None:
        s = structure_counts(queries, cards)
        return (s.where("query_id <> card_id") if apart else s).groupBy("query_id", *STRUCTURE_ORDER).agg(F.count("*").alias("n"))
    x, y, words = sides
    q, c = tag_classes.classes(x), tag_classes.classes(y)
    counts = x.join(tag_classes.histogram(q, c), q[1]).select("query_id", *STRUCTURE_ORDER, "n")
    if not apart:
        return counts.groupBy("query_id", *STRUCTURE_ORDER).agg(F.sum("n").alias("n"))
    own = x.join(y, F.col("query_id") == F.col("card_id"))
    overlap = lambda k: sum((F.bit_count(F.col(f"q{k}{w}").bitwiseAND(F.col(f"c{k}{w}"))) for w in range(words)), F.lit(0))
    less = own.select("query_id", overlap("t").cast("int").alias("tension_overlap"), overlap("c").cast("int").alias("coordinate_overlap"), F.lit(-1).cast("long").alias("n"))
    both = counts.unionByName(less.where("tension_overlap + coordinate_overlap > 0"))
    return both.groupBy("query_id", *STRUCTURE_ORDER).agg(F.sum("n").alias("n")).where("n > 0")


def structure_ties(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, matching, tied_at_cutoff): rows beyond rank k with the key of rank k.

    Matches are counted by key before anything is ranked, so no query's cards have to meet in one place."""
    return counted_ties(scores.groupBy("query_id", *STRUCTURE_ORDER).agg(F.count("*").alias("n")), k)


def counted_ties(counts: DataFrame, k: int) -> DataFrame:
    """The same from `overlap_counts`."""
    down = Window.partitionBy("query_id").orderBy(*[F.desc(c) for c in STRUCTURE_ORDER])
    upto = counts.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    cutoff = (F.col("upto") > k) & (F.col("upto") - F.col("n") < k)
    return upto.groupBy("query_id").agg(
        F.sum("n").alias("matching"), F.coalesce(F.sum(F.when(cutoff, F.col("upto") - k)), F.lit(0)).alias("tied_at_cutoff")
    )


def diversity(ranked: DataFrame, cap: int = PER_SOURCE, pool: int = POOL, scan: int = SCAN) -> DataFrame:
    """Rows (query_id, rank, source, ...) of the scan with `accepted`; rows after the pool is full are gone.

    Equals the walk down the ranking that takes a card unless its source has `cap` already: a source's first
    `cap` cards are the takeable ones, and those before the pool is full are taken."""
    own = Window.partitionBy("query_id", "source").orderBy("rank")
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ok = ranked.where(F.col("rank") <= scan).withColumn("ok", F.row_number().over(own) <= cap)
    taken = ok.withColumn("taken", F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0)))
    return taken.where(F.col("taken") < pool).withColumnRenamed("ok", "accepted").drop("taken")


def candidate_union(meaning: DataFrame, structure: DataFrame) -> DataFrame:
    """All cards of either route, with each route's own rank and signals and no common score."""
    m = meaning.select("query_id", "card_id", F.col("rank").alias("meaning_rank"), F.col("cosine").alias("meaning_score"))
    s = structure.select("query_id", "card_id", F.col("rank").alias("structure_rank"), *STRUCTURE_ORDER)
    found = F.array_compact(F.array(F.when(F.col("meaning_rank").isNotNull(), F.lit("MEANING")), F.when(F.col("structure_rank").isNotNull(), F.lit("STRUCTURE"))))
    return m.join(s, ["query_id", "card_id"], "full_outer").withColumn("found_by", found)


def retrieve(queries: DataFrame, cards: DataFrame, k: int = POOL, guarded: bool = False, apart: bool = False) -> DataFrame:
    """All routes of all queries in one frame, a row for each query and card that some route holds.

    `queries` is (query_id, q0, q1, coordinates, tensions) with the vectors of the question alone and of its meaning,
    `cards` (card_id, vector, source, coordinates, tensions). The result is (query_id, card_id, q0_rank, meaning_rank,
    meaning_score, structure_rank, overlaps, in_union): the control route isn't part of the union, U1. `guarded` puts
    the diversity cap on the meaning route, whose accepted cards keep their ranks. A query without a vector or without
    tags has no rows of that route."""

    def by(vector: str, n: int) -> DataFrame:
        return cosine_rank(queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("query_vector")), cards.where("vector IS NOT NULL"), n, apart)

    meaning = by("q1", SCAN if guarded else k)
    if guarded:
        meaning = diversity(meaning.join(cards.select("card_id", "source"), "card_id"), pool=k).where("accepted")
    tagged = structure_rank(queries, cards, k, apart)
    none = {c: F.lit(None).cast(t) for c, t in (("q0_rank", "int"), ("meaning_rank", "int"), ("meaning_score", "double"), ("structure_rank", "int"), *((c, "int") for c in STRUCTURE_ORDER))}
    routes = (
        by("q0", k).select("query_id", "card_id", F.col("rank").alias("q0_rank")),
        meaning.select("query_id", "card_id", F.col("rank").alias("meaning_rank"), F.col("cosine").alias("meaning_score")),
        tagged.select("query_id", "card_id", F.col("rank").alias("structure_rank"), *STRUCTURE_ORDER),
    )
    rows = [r.select("query_id", "card_id", *[F.col(c) if c in r.columns else none[c].alias(c) for c in none]) for r in routes]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("query_id", "card_id").agg(*[F.max(c).alias(c) for c in none])
    return both.withColumn("in_union", F.col("meaning_rank").isNotNull() | F.col("structure_rank").isNotNull())


def union_violations(union: DataFrame, meaning: DataFrame, structure: DataFrame, excluded: DataFrame) -> DataFrame:
    """(query_id, card_id, problem): what the union lacks or has too much, and excluded cards in it."""
    ids = meaning.select("query_id", "card_id").union(structure.select("query_id", "card_id")).distinct()
    have = union.select("query_id", "card_id")
    lacks = ids.join(have, ["query_id", "card_id"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(ids, ["query_id", "card_id"], "left_anti").withColumn("problem", F.lit("unfounded"))
    leak = have.join(excluded.select("card_id"), "card_id", "left_semi").select("query_id", "card_id").withColumn("problem", F.lit("excluded"))
    return lacks.unionByName(extra).unionByName(leak)


def view_ranks(views: DataFrame, cards: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, view, card_id, cosine, rank): the ranking of each view, or its first k cards."""
    keys = ("query_id", "view")
    scores = cosine_scores(views, cards, keys) if k is None else best_cosines(views, cards, k, keys)
    return best(scores, list(keys), [F.desc("cosine"), F.asc("card_id")], k)


def fuse_max(scores: DataFrame, k: int) -> DataFrame:
    """By the best cosine over the views; needs no ranks.

    Of each view, its first k cards are enough: who comes before a card in its best view comes before it here."""
    top = scores.groupBy("query_id", "card_id").agg(F.max("cosine").alias("cosine"))
    return best(top, ["query_id"], [F.desc("cosine"), F.asc("card_id")], k)


def fuse_rrf(ranked: DataFrame, k: int) -> DataFrame:
    """By the sum of 1 / (60 + rank) over the views."""
    total = ranked.groupBy("query_id", "card_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    return best(total.withColumn("score", F.round("score", 12)), ["query_id"], [F.desc("score"), F.asc("card_id")], k)


def rrf(views: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """`fuse_rrf` of the full ranking of each view, from the ranks of the cards within reach; repeated ids and odd vectors take all ranks."""
    even = rank_sums.even(views, cards)
    return fuse_rrf(rank_sums.reciprocal_ranks(views, cards, k) if even else view_ranks(views, cards), k)


def fuse_round_robin(ranked: DataFrame, k: int) -> DataFrame:
    """Views take turns, each with its next card that isn't in yet: by first rank, then by view.

    Ranks up to k are enough: the first view alone has k cards that come before any of a later rank."""
    first = ranked.groupBy("query_id", "card_id").agg(F.min(F.struct("rank", "view")).alias("first"))
    return best(first, ["query_id"], [F.asc("first")], k).select("query_id", "card_id", "rank", F.col("first.rank").alias("view_rank"), F.col("first.view").alias("view"))


def found_by(scores: DataFrame, top: int) -> DataFrame:
    """Competition rank of each card in each view, where it is at most `top`, from (query_id, view, card_id, cosine)."""
    w = Window.partitionBy("query_id", "view").orderBy(F.desc("cosine"))
    return scores.withColumn("competition_rank", F.rank().over(w)).where(F.col("competition_rank") <= top)


def hybrid(core: DataFrame, views: DataFrame, pool: int, cap: int = PER_SOURCE) -> DataFrame:
    """(query_id, card_id, rank): a capped core, filled in turns from the views under one cap for all of them.

    `core` is (query_id, card_id, source, rank), `views` (query_id, view, card_id, source, rank), of which the first three
    pools count. A fold over the turns of a query's views: each takes its first card that isn't in yet and whose source
    has room. What a view has passed over stays out, since pools and sources only fill; so no turn needs to know where
    the one before stopped. A query's lists, three pools a view, are one row."""
    held = F.struct("card_id", "source")
    listed = views.where(F.col("rank") <= 3 * pool).groupBy("query_id", "view").agg(F.array_sort(F.collect_list(F.struct("rank", "card_id", "source"))).alias("cards"))
    turns = listed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("view", F.transform("cards", lambda c: F.struct(c["card_id"], c["source"])).alias("cards")))), lambda v: v["cards"]).alias("turns"))
    start = core.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", held.alias("c")))), lambda x: x["c"]).alias("core"))
    kind = core.select(F.array(held)).schema[0].dataType
    both = start.join(turns, "query_id", "full_outer").select("query_id", F.coalesce("core", F.array().cast(kind)).alias("core"), F.coalesce("turns", F.array().cast(listed.select(F.array(F.transform("cards", lambda c: F.struct(c["card_id"], c["source"])))).schema[0].dataType)).alias("turns"))

    def turn(taken: Column, cards: Column) -> Column:
        def fits(c: Column) -> Column:
            return ~F.exists(taken, lambda t: t["card_id"] == c["card_id"]) & (F.size(F.filter(taken, lambda t: t["source"].eqNullSafe(c["source"]))) < cap)

        return F.when(F.size(taken) < pool, F.concat(taken, F.slice(F.filter(cards, fits), 1, 1).cast(kind))).otherwise(taken)

    filled = F.aggregate(F.flatten(F.array_repeat("turns", pool)), F.col("core"), turn)
    return both.select("query_id", F.posexplode(filled).alias("at", "c")).select("query_id", "c.card_id", (F.col("at") + 1).alias("rank"))


def one_per_source(selected: DataFrame) -> DataFrame:
    """The first card of each source in a selection, with what it replaces."""
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    return selected.withColumns({"place": F.row_number().over(w), "kept": F.first("card_id").over(w)})


def limited(x: str | Column, n: int) -> Column:
    """The first n distinct items."""
    return F.slice(F.array_distinct(F.col(x) if isinstance(x, str) else x), 1, n)


def overlap(a: DataFrame, b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, common, share, jaccard) of two rankings' cards, by key; null shares where one has none."""
    x = a.groupBy(*keys).agg(F.collect_set("card_id").alias("x"))
    y = b.groupBy(*keys).agg(F.collect_set("card_id").alias("y"))
    both = x.join(y, keys, "full_outer")
    common = F.size(F.array_intersect("x", "y"))
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    return both.select(
        *keys, F.when(there, common).alias("common"), F.when(there, F.round(common / n, 6)).alias("share"),
        F.when(there, F.round(common / F.size(F.array_union("x", "y")), 6)).alias("jaccard"),
    )
