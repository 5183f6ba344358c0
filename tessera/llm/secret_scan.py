"""Secrets in texts by a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression yields a Boolean query over trigrams that every match must contain. The index
holds postings (trigram, document) for the rules' trigrams; intersecting them gives the documents in which a
rule can match, and only there its expression is run. Rules without mandatory trigrams scan every text.

Positions come from splitting a text by the same expression that extracts its matches: the lengths of pieces
and matches add up to the offsets, in code points.

Defined cases: null and empty texts have no spans; repeated rows each get their row; a document is known by
its id and a hash of its text, so repeated ids with different texts don't mix; null ids are matched as equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from re import _parser as regular

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`least`: code points that `group` of a match must have, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    query: tuple = field(default=())


# The kinds of secrets and their expressions. `hex` and `access` name the least length in the
# expression, which is the same as dropping shorter matches, since those runs cannot match again inside.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)bearer\x20{1,4}[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)

MOST_STRINGS, MOST_CLASS = 64, 8
Clauses = list[frozenset[frozenset[str]]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _class(items: list) -> set[str] | None:
    """The lower-cased members of a small character class; None for large or negated ones."""
    found: set[str] = set()
    for op, arg in items:
        if op is regular.LITERAL:
            found.add(chr(arg).lower())
        elif op is regular.RANGE and arg[1] - arg[0] < MOST_CLASS:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if 0 < len(found) <= MOST_CLASS else None


def _walk(items) -> tuple[set[str] | None, Clauses]:
    """All strings that a sequence matches, where they are few, and else what each match must contain."""
    run, whole, clauses = {""}, True, []

    def flush() -> None:
        nonlocal run, whole
        if run != {""} and all(len(s) > 2 for s in run):
            clauses.append(frozenset(map(trigrams, run)))
        run, whole = {""}, False

    def extend(strings: set[str] | None, more: Clauses = ()) -> None:
        nonlocal run
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            flush()
            if strings is not None and all(len(s) > 2 for s in strings):
                clauses.append(frozenset(map(trigrams, strings)))
            clauses.extend(more)
        else:
            run = {a + b for a in run for b in strings}

    for op, arg in items:
        if op is regular.LITERAL:
            extend({chr(arg).lower()})
        elif op is regular.IN:
            extend(_class(arg))
        elif op is regular.SUBPATTERN:
            extend(*_walk(arg[3]))
        elif op is regular.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                extend(set().union(*(s for s, _ in parts)))
            else:
                flush()
                each = [[frozenset(map(trigrams, s))] if s is not None and all(len(x) > 2 for x in s) else c for s, c in parts]
                if all(each):
                    clauses.append(frozenset().union(*(max(c, key=lambda k: min(map(len, k))) for c in each)))
        elif op in (regular.MAX_REPEAT, regular.MIN_REPEAT):
            low, high, sub = arg
            strings, more = _walk(sub)
            if strings is not None and low == 0 and high == 1:
                extend(strings | {""})
            elif low == 0:
                flush()
            else:
                extend(strings, more)
                if (low, high) != (1, 1):
                    flush()
        else:
            flush()
    if whole:
        return run, []
    flush()
    return None, clauses


def trigram_query(pattern: str) -> Clauses:
    """Conjunction of clauses; a clause is a choice of trigram sets, of which one must be in the lower-cased text.

    An empty conjunction means that the expression has no mandatory trigrams."""
    strings, clauses = _walk(regular.parse(pattern))
    if strings is not None:
        clauses = [frozenset(map(trigrams, strings))] if all(len(s) > 2 for s in strings) else []
    # a choice that holds all trigrams of another is implied by it
    return [frozenset(a for a in c if not any(b < a for b in c)) for c in clauses if all(c)]


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for c in trigram_query(r.pattern) for choice in c for t in choice})


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def build_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (gram, id, h): one row for each trigram of `grams`, by its place there, that a text contains."""
    low = keyed(docs, id_col, text_col).select("id", "h", F.lower("text").alias("low"))
    return low.select(F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))).alias("gram"), "id", "h")


WORD_BITS = 62


def intersect(index: DataFrame, grams: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, h, rules): the kinds whose queries a document's postings fulfil. Postings are or-ed before the shuffle."""
    place = {g: i for i, g in enumerate(grams)}
    words = range((len(grams) + WORD_BITS - 1) // WORD_BITS)
    bit = lambda w: F.when((F.col("gram") / WORD_BITS).cast("int") == w, F.expr(f"shiftleft(1L, gram % {WORD_BITS})"))
    seen = index.groupBy("id", "h").agg(*[F.coalesce(F.bit_or(bit(w)), F.lit(0).cast("long")).alias(f"m{w}") for w in words])

    def has(choice: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            mask = sum(1 << (place[g] % WORD_BITS) for g in choice if place[g] // WORD_BITS == w)
            if mask:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return out

    def holds(rule: Rule) -> Column | None:
        out = None
        for clause in trigram_query(rule.pattern):
            some = F.lit(False)
            for choice in sorted(clause, key=sorted):
                some = some | has(choice)
            out = some if out is None else out & some
        return out

    may = [F.when(c, F.lit(r.kind)) for r in rules if (c := holds(r)) is not None]
    found = seen.select("id", "h", F.array_compact(F.array(*may)).alias("rules")) if may else seen.select("id", "h", F.array().cast("array<string>").alias("rules"))
    return found.where(F.size("rules") > 0)


def spans(rule: Rule, place: int) -> Column:
    """array<struct<start, place, end, kind>> of a rule's matches in `text`."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    tested = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else matches
    pieces = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(matches))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["0"])
        b = a + F.length(x["1"])
        one = F.array(F.struct(a.alias("start"), F.lit(place).alias("place"), b.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(b.alias("at"), F.when(F.length(x["2"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(pieces.alias("0"), matches.alias("1"), tested.alias("2"))
    return F.aggregate(zipped, start, add, lambda acc: acc["out"])


def joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<base kind>..., base_sha256, spans) of every row of `docs`."""
    grams = vocabulary(rules)
    candidates = intersect(build_index(docs, grams, id_col, text_col), grams, rules)
    texts, found = keyed(docs, id_col, text_col).alias("t"), candidates.alias("c")
    # the candidates' small rows are hashed; the texts are shuffled but not sorted
    rows = texts.join(found.hint("shuffle_hash"), F.expr("t.id <=> c.id AND t.h = c.h"), "left").select("t.id", "t.text", "c.rules")
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")

    def verified(rule: Rule, place: int) -> Column:
        may = F.array_contains("rules", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        return F.when(F.coalesce(may, F.lit(False)) & F.col("text").rlike(rule.pattern), spans(rule, place)).otherwise(none)

    base = [(r, k) for k, r in enumerate(rules) if r.base]
    added = [verified(r, k) for k, r in enumerate(rules) if not r.base]
    rows = rows.select("id", *[verified(r, k).alias(f"s_{r.kind}") for r, k in base], (F.concat(*added) if added else none).alias("added"))
    rows = rows.select("id", "added", *[F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r, _ in base], F.array_sort(F.concat(*[f"s_{r.kind}" for r, _ in base])).alias("base"))
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return rows.select(
        F.col("id").alias(id_col), *[f"n_{r.kind}" for r, _ in base],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", apart))).alias("spans"),
    )
