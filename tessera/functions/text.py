"""Text functions as column expressions: normalisation, sentences, words, n-grams, excerpts, detectors.

All of them run inside the JVM. Patterns carry Java's Unicode flags, since the texts are in many scripts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word character here and in the oracle queries.
WORD = r"[\p{L}\p{N}_]+"
DISPLAY_WORD = r"[\p{L}\p{N}_«»-]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row: inside a lambda, a plain expression is computed for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(x: str | Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def normalize_breaks(x: str | Column) -> Column:
    """Dashes broken over a line are joined, then white space collapses."""
    return collapse(F.regexp_replace(_c(x), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "-"))


def typography(x: str | Column) -> Column:
    """Three hyphens are a dash, then two are a short one; quotes are unescaped."""
    return F.replace(F.replace(F.replace(_c(x), F.lit("---"), F.lit("—")), F.lit("--"), F.lit("–")), F.lit("\\'"), F.lit("'"))


def text_or_null(x: str | Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def clean_list(x: str | Column) -> Column:
    """Trimmed, non-empty items; null stays null and an empty list stays empty."""
    return F.filter(F.transform(_c(x), lambda i: F.trim(i)), lambda i: i != "")


def word_tokens(x: str | Column) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(WORD), F.lit(0))


def fold(x: str | Column) -> Column:
    """Lower case, with ё as е."""
    return F.translate(F.lower(_c(x)), "ё", "е")


def token_norm(x: str | Column) -> Column:
    """Folded word tokens with single spaces between them."""
    return F.array_join(word_tokens(fold(x)), " ")


def move_norm(x: str | Column) -> Column:
    """Collapsed, lower case, without final stops."""
    return F.lower(F.regexp_replace(collapse(x), r"\.+$", ""))


def sentences(x: str | Column) -> Column:
    """Parts that follow white space after . ! ? or …"""
    return F.filter(F.split(F.trim(_c(x)), r"(?<=[.!?…])\s+"), lambda s: s != "")


def sentence_count(x: str | Column) -> Column:
    return F.size(sentences(x))


def word_count(x: str | Column, display: bool = False) -> Column:
    """Runs of word characters; `display` counts hyphens and quotation marks as such."""
    return F.size(F.regexp_extract_all(_c(x), F.lit(DISPLAY_WORD if display else WORD), F.lit(0)))


def content_words(x: str | Column, longer_than: int = 3) -> Column:
    """Distinct folded words of more than so many letters."""
    return F.array_distinct(F.filter(word_tokens(fold(x)), lambda w: F.length(w) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def retold(detail: str | Column, card: str | Column, threshold: float = 0.6) -> Column:
    """Sentences of `detail` whose content words are nearly those of some sentence of `card`."""
    theirs = F.transform(sentences(card), lambda s: content_words(s))
    same = lambda s, ts: let(content_words(s), lambda w: F.exists(ts, lambda t: jaccard(w, t) >= threshold))
    return let(theirs, lambda ts: F.filter(sentences(detail), lambda s: same(s, ts)))


def ngrams(x: str | Column, n: int) -> Column:
    """Distinct sequences of n folded words; none in shorter texts."""
    return runs(word_tokens(fold(x)), n)


def runs(words: Column, n: int) -> Column:
    """Distinct sequences of n items, joined by spaces."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.array_distinct(let(words, of))


def verbatim_excerpt(quote: str | Column, excerpt: str | Column, least: int = 8, most: int = 45) -> Column:
    """Whether `excerpt` is a proper part of `quote`, word for word, of a fitting length."""
    n = word_count(excerpt, display=True)
    return F.contains(_c(quote), _c(excerpt)) & (F.length(_c(excerpt)) < F.length(_c(quote))) & n.between(least, most)


def lead_excerpt(quote: str | Column, most: int = 40) -> Column:
    """X11: whole sentences from the start, up to `most` words; null if not even the first fits."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(acc: Column, s: Column) -> Column:
        n = acc["n"] + word_count(s, display=True)
        stop = acc["over"] | (n > most)
        text = F.when(stop, acc["text"]).when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(" "), s))
        return F.struct(text.alias("text"), F.when(stop, acc["n"]).otherwise(n).alias("n"), stop.alias("over"))

    return F.nullif(F.aggregate(sentences(quote), start, step, lambda acc: acc["text"]), F.lit(""))


def quote_titles(x: str | Column, titles: Sequence[str]) -> Column:
    """Given titles in guillemets, unless they stand in some already."""
    out = _c(x)
    for t in titles:
        safe = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in t)
        out = F.regexp_replace(out, rf"(?U)(?<![«\w]){safe}(?![»\w])", f"«{t}»")
    return out


def stem_hits(words: Column, text: str | Column, stem: int = 4) -> Column:
    """The words whose first letters begin some token of `text`."""
    begins = lambda w, ts: let(F.substring(fold(w), 1, stem), lambda s: F.exists(ts, lambda t: F.startswith(t, s)))
    return let(word_tokens(fold(text)), lambda ts: F.filter(words, lambda w: begins(w, ts)))


def strip_qualifier(x: Column, qualifier: str = " (potential)") -> Column:
    """A tension without its qualifier suffix."""
    return F.when(x.endswith(qualifier), F.substring(x, F.lit(1), F.length(x) - len(qualifier))).otherwise(x)


def unqualified(x: str | Column) -> Column:
    """Of an array, without the repeats that this makes; the first of equals stays."""
    return F.array_distinct(F.transform(_c(x), lambda t: strip_qualifier(t)))


def option(table: Column, key: Column, default: Column) -> Column:
    """Lookup in a map with a default."""
    return F.coalesce(F.element_at(table, key), default)


def message_for(error: str | Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The message of the first pattern that an error text matches."""
    out = F.lit(default)
    for pattern, message in reversed(rules):
        out = F.when(_c(error).rlike(pattern), F.lit(message)).otherwise(out)
    return out


def cut(x: str | Column, n: int) -> Column:
    """At most n characters, with an ellipsis where some were cut."""
    return F.when(F.length(_c(x)) > n, F.concat(F.rtrim(F.substring(_c(x), 1, n - 1)), F.lit("…"))).otherwise(_c(x))


def contains_any(x: str | Column, markers: Sequence[str]) -> Column:
    """whether one of the markers occurs; null has none."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(_c(x), F.lit(m))
    return F.coalesce(out, F.lit(False))


def missing(x: str | Column, kind: str = "string", may_be_empty: bool = False) -> Column:
    """null, blank, or an empty list unless that is a decision."""
    c = _c(x)
    if kind == "string":
        return c.isNull() | (F.trim(c) == "")
    return c.isNull() if may_be_empty else c.isNull() | (F.size(c) == 0)


#: Escapes as RE2 has them: bounds of words of ASCII alone, white space without the vertical tab.
ASCII = {"b": r"(?-iu:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", "s": r"[\t\n\f\r ]"}


def hits(x: str | Column, patterns: Sequence[str], ascii: bool = False) -> Column:
    """The patterns that match, ignoring case in all scripts, in the order given.

    With `ascii`, \\b and \\s stand for ASCII characters and the dot for all but line feeds, as in RE2."""
    java = lambda p: "(?iud)" + re.sub(r"\\(.)", lambda m: ASCII.get(m[1], m[0]), p) if ascii else "(?iu)" + p
    return F.array_compact(F.array(*[F.when(_c(x).rlike(java(p)), F.lit(p)) for p in patterns]))


def hits_beyond(x: str | Column, ground: str | Column, patterns: Sequence[str]) -> Column:
    """the patterns that match `x` but not the text it must rest on."""
    return F.array_compact(F.array(*[F.when(_c(x).rlike("(?iu)" + p) & ~F.coalesce(_c(ground), F.lit("")).rlike("(?iu)" + p), F.lit(p)) for p in patterns]))


def ambiguous_second_question(x: str | Column, opening: str) -> Column:
    """F16: whether the second of two questions begins with a word that points back."""
    parts = F.split(F.trim(_c(x)), r"(?<=\?)\s+")
    return F.coalesce(F.get(parts, F.lit(1)).rlike("(?iu)^(?:" + opening + r")(?!\p{L})"), F.lit(False))
