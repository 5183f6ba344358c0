"""URL filter: host and path rules, then the log-likelihood ratio of two character models.

Rules decide where they fit. Their own verdicts, over all URLs, are the accepted and rejected texts from which
two variable-order Markov models of characters are counted; other URLs are judged by the difference of their
log-likelihoods, divided by the length, against a threshold calibrated on URLs that the counts leave out.

Characters fall into `SYMBOLS` classes (letters, digits as one, signs, everything else), and contexts have up
to ORDER of them: a model can have SYMBOLS ** (ORDER + 1) cells at most, whatever the corpus, which bounds what
is fetched and broadcast. Counts cover every URL that a rule fits outside the calibration fold.

Defined cases: null URLs and those without `://` have an empty host and path and fit no rule; null and empty ones,
with nothing to score, are allowed, all others get the models' verdict; repeated rows each get their row. Where rules of one verdict fit no URL there is no model
and every other URL is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map

#: (host, path, verdict); a rule fits its host and all subdomains of it.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = "./-_?=&#:%+"
#: Class 0 stands before a URL and for its end, 1 for digits, 2 for all other characters.
SYMBOLS = 3 + len(LETTERS) + len(SIGNS)
ORDER = 3
#: Contexts seen less often than this use the next shorter one alone.
LEAST = 3
FOLDS = 5
BINS = 200
_CLASS = np.full(256, 2, np.int64)
_CLASS[48:58] = 1
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 3 + _i
for _i, _c in enumerate(SIGNS):
    _CLASS[ord(_c)] = 3 + len(LETTERS) + _i


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z alone, and path of a URL; both empty without `://`."""
    there = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), LETTERS.upper(), LETTERS)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.when(there, host).otherwise(empty), F.when(there, path).otherwise(empty)


def ruled(pages: DataFrame, rules: tuple = RULES, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_verdict (both null where none fits); the longest rule wins."""
    host, path = parts(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    name = verdict = F.lit(None).cast("string")
    # the longest is tested last, and so decides
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return out.withColumns({"rule": name, "rule_verdict": verdict})


def grams(url: str | None) -> np.ndarray:
    """For each character and the end of a URL, the code of it and the ORDER classes before it."""
    if not url:
        return np.zeros(0, np.int64)
    c = np.concatenate([np.zeros(ORDER, np.int64), _CLASS[np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8)], np.zeros(1, np.int64)])
    code = np.zeros(len(c) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code * SYMBOLS + c[k : len(c) - ORDER + k]
    return code


def count(urls: DataFrame) -> DataFrame:
    """(accepted, gram, n) over rows (url, accepted): summed in each batch, then by Spark."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        accepted = np.array(batch.column(1).to_pylist(), bool)
        codes = [grams(u) for u in batch.column(0).to_pylist()]
        both = np.concatenate([c * 2 + a for c, a in zip(codes, accepted)] or [np.zeros(0, np.int64)])
        key, n = np.unique(both, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key % 2 == 1), pa.array(key // 2), pa.array(n.astype(np.int64))], ["accepted", "gram", "n"])

    return arrow_map(urls, run, "accepted boolean, gram long, n long").groupBy("accepted", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Ratio:
    """`code` ascending, and beside it the difference of log probabilities of its last character after the others.

    Codes that neither model has seen take the shorter context's value, down to the order 0 table."""

    codes: list[np.ndarray]
    values: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    threshold: float = 0.0

    def score(self, url: str | None) -> float | None:
        code = grams(url)
        if not len(code):
            return None
        out, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        for order in range(ORDER, -1, -1):
            short = code % SYMBOLS ** (order + 1)
            at = np.minimum(np.searchsorted(self.codes[order], short), len(self.codes[order]) - 1)
            hit = open_ & (self.codes[order][at] == short)
            out[hit] += self.values[order][at[hit]]
            open_ &= ~hit
            if order and len(self.contexts[order]):
                # a known context without this character: what both sides leave for shorter contexts
                at = np.minimum(np.searchsorted(self.contexts[order], short // SYMBOLS), len(self.contexts[order]) - 1)
                left = open_ & (self.contexts[order][at] == short // SYMBOLS)
                out[left] += self.escapes[order][at[left]]
        return float(out.sum() / len(code))


def ratio(counts: dict[bool, tuple[np.ndarray, np.ndarray]]) -> Ratio | None:
    """Both models, interpolated by Witten and Bell's rule from order 0 up; None if one has nothing to count."""
    if any(len(counts[side][0]) == 0 for side in (True, False)):
        return None
    probability: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {}
    every = [np.unique(np.concatenate([counts[s][0] % SYMBOLS ** (o + 1) for s in (True, False)])) for o in range(ORDER + 1)]
    every[0] = np.arange(SYMBOLS)
    known_contexts = [np.unique(e // SYMBOLS) for e in every]
    escapes = [np.zeros(len(c)) for c in known_contexts]
    for side in (True, False):
        code, n = counts[side]
        below = np.full(SYMBOLS, 1 / SYMBOLS)
        tables = []
        for order in range(ORDER + 1):
            known, back = np.unique(code % SYMBOLS ** (order + 1), return_inverse=True)
            times = np.bincount(back, n)
            context, where = np.unique(known // SYMBOLS, return_inverse=True)
            total, kinds = np.bincount(where, times), np.bincount(where)
            often = total >= LEAST
            escapes[order][np.searchsorted(known_contexts[order], context[often])] += (1 if side else -1) * np.log(kinds[often] / (total[often] + kinds[often]))
            ask = every[order]
            at = np.minimum(np.searchsorted(known, ask), len(known) - 1)
            mine = np.where(known[at] == ask, times[at], 0)
            at = np.minimum(np.searchsorted(context, ask // SYMBOLS), len(context) - 1)
            enough = (context[at] == ask // SYMBOLS) & (total[at] >= LEAST)
            if order == 0:
                lower = below[ask]
            else:
                lower = tables[-1][1][np.searchsorted(every[order - 1], ask % SYMBOLS**order)]
            mixed = (mine + kinds[at] * lower) / (total[at] + kinds[at])
            tables.append((ask, np.where(enough, mixed, lower)))
        probability[side] = tables
    values = [np.log(probability[True][o][1]) - np.log(probability[False][o][1]) for o in range(ORDER + 1)]
    return Ratio(every, values, known_contexts, escapes)


def scored(urls: DataFrame, model: Ratio | None, columns: list[str]) -> DataFrame:
    """Adds `score` to rows whose last column is the URL; null without a model or a URL."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = [model.score(u) if model else None for u in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*columns, "score"])

    schema = ", ".join(f"`{c}` {urls.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(urls.select(*columns), run, schema + ", score double")


def train(pages: DataFrame, rules: tuple = RULES, url_col: str = "url") -> Ratio | None:
    """Counts and calibrates on all URLs that a rule fits; the calibration fold is a fifth of them by hash."""
    known = ruled(pages.select(url_col), rules, url_col).where("rule IS NOT NULL")
    known = known.select(F.col(url_col).alias("url"), (F.col("rule_verdict") == "allow").alias("accepted"), F.pmod(F.xxhash64(url_col), F.lit(FOLDS)).alias("fold"))
    got = count(known.where("fold <> 0").select("url", "accepted")).toPandas()  # 2 SYMBOLS ** (ORDER + 1) rows at most
    counts = {s: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(float)) for s in (True, False) for g in [got[got["accepted"] == s]]}
    model = ratio(counts)
    if model is None:
        return None
    held = scored(known.where("fold = 0").select("accepted", "url"), model, ["accepted", "url"])
    bins = held.where("score IS NOT NULL").groupBy("accepted", F.round(F.col("score") * BINS).cast("int").alias("bin")).count().toPandas()
    table = bins.pivot_table(index="bin", columns="accepted", values="count", fill_value=0).sort_index()
    if list(table.columns) == [False, True]:
        # least mean of both error rates, at the middle of the scores that reach it
        wrong = table[True].cumsum() / table[True].sum() + 1 - table[False].cumsum() / table[False].sum()
        best = wrong.index[np.isclose(wrong, wrong.min())]
        after = [b for b in table.index if b > best[-1]]
        model.threshold = (best[0] + (after[0] if after else best[-1] + 1)) / 2 / BINS
    return model


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; `score` is null where a rule decides."""
    model = train(pages, rules, url_col)
    rows = ruled(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules, "url")
    rows = rows.select("id", "host", "path", "rule", "rule_verdict", F.when(F.col("rule").isNull(), F.col("url")).alias("url"))
    columns = ["id", "host", "path", "rule", "rule_verdict", "url"]
    out = scored(rows, model, columns)
    own = F.when(F.col("score") < (model.threshold if model else 0.0), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
