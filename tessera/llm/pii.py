"""Personal data, plain and disguised, with spans in the source text.

Base detectors run on the text as it is. Texts that hold a disguise are then rewritten by transducers, escaped signs
and homoglyphs first, then spelled digits and at/dot words, which carry for each character they write the span
of source characters it stands for. The same detectors run on the rewritten text; what they find there is
mapped back to the source and added where no base span covers it: a disguised address that holds a plain one is
found beside it.

Defined cases: null and empty texts have no spans; rows stay as they are, repeated ones included; offsets
count code points, ends exclusive; scans are linear in the text, also for very long runs of one character.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, place of the kind in KINDS

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match always ends at the end of a run of digits, so the next can only begin where a run begins.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
NEAR_IP = re.compile(r"[0-9]\.[0-9]")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, and signs that look like @ . - +
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
}
#: Characters without width, which a disguise slips between others.
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}


def _single(c: str) -> str | None:
    """The ASCII character that `c` is a form or look-alike of."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and "\x20" <= plain < "\x7f" else None


SINGLE = {c: to for i in range(128, 0x20000) if not 0xD800 <= i < 0xE000 and (to := _single(c := chr(i)))}
ODD_SET = frozenset({*SINGLE, *INVISIBLE})
ODD = re.compile("[" + "".join(map(re.escape, sorted({*SINGLE, *INVISIBLE}))) + "]")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
WORD_RUN = re.compile(rf"(?i)(?:(?:\+|(?<!\w)plus)\s{{0,2}})?(?<!\w)(?:{_WORDS})(?:[\s,.-]{{1,4}}(?:{_WORDS}))*(?!\w)")
WORD_ONE = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})(?!\w)")
AT = re.compile(
    r"(?i)\s{0,4}[\[({<]\s{0,4}(?:at|@|ät|arroba|arobase)\s{0,4}[\])}>]\s{0,4}"
    r"|[\s_*-]{1,4}(?:at|arroba|arobase)[\s_*-]{1,4}(?=[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:[\s_*-]{0,4}[\[({<]\s{0,4}(?:dot|punkt|point|punto)\s{0,4}[\])}>]|[\s_*-]{1,4}(?:dot|punkt|point|punto)[\s_*-])[\s_*-]{0,4}[a-z0-9]+)"
)
DOT = re.compile(r"(?i)\s{0,4}[\[({<]\s{0,4}(?:dot|\.|punkt|point|punto)\s{0,4}[\])}>]\s{0,4}|(?<=[a-z0-9])[\s_*-]{1,4}(?:dot|punkt|point|punto)[\s_*-]{1,4}(?=[a-z0-9])")
#: Disguises without brackets have one of these as a token between spaces, signs or brackets.
DIGIT_TOKENS, DOT_TOKENS = frozenset(w.encode() for w in DIGIT_WORDS), frozenset((b"dot", b"punkt", b"point", b"punto"))
TOKENS = DIGIT_TOKENS | DOT_TOKENS
APART = bytes.maketrans(b",.;:-+()[]{}<>_*", b" " * 16)
#: The signs @ and . as URL escapes and character references.
ENCODED = re.compile(r"(?i)(%40|&#0{0,4}64;|&#x0{0,4}40;|&commat;)|%2e|&#0{0,4}46;|&#x0{0,4}2e;|&period;")
BRACKETS = re.compile(r"(?i)[\[({<]\s{0,4}(?:at|@|ät|arroba|arobase|\.)\s{0,4}[\])}>]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d += d - 9 if d > 4 else d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the run before it, not beyond the end of the match before."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def detect(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += ((a, b, 0) for a, b in emails(text))
    if NEAR_IP.search(text):
        found += ((a, b, 1) for a, b in ips(text))
    found += ((a, b, 2) for a, b in cards(text))
    if "+" in text:
        found += ((a, b, 3) for a, b in phones(text))
    return sorted(found, key=lambda s: (s[0], s[2]))


class Traced:
    """A text whose characters know the source span they stand for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write) -> None:
        """Replaces each match by what `write` says: (text, spans of the match that its characters stand for)."""
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            out.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            for c, (x, y) in write(m):
                out.append(c)
                starts.append(self.starts[x])
                ends.append(self.ends[y - 1])
            at = b
        out.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(out), starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def homoglyph(m: re.Match) -> list:
    return [(SINGLE[m[0]], m.span())] if m[0] in SINGLE else []


def decoded(m: re.Match) -> list:
    return [("@" if m[1] else ".", m.span())]


def spelled(m: re.Match) -> list:
    plus = [("+", (m.start(), m.start() + 1))] if m[0][0] == "+" or m[0][:4].lower() == "plus" else []
    return plus + [(str(DIGIT_WORDS[w[0].lower()]), w.span()) for w in WORD_ONE.finditer(m.string, *m.span())]


def telling(tokens: list[bytes]) -> bool:
    """Whether there is a word for a dot, or a spelled digit beside another or beside digits."""
    for k, t in enumerate(tokens):
        if t in DOT_TOKENS or t in DIGIT_TOKENS and any(x in DIGIT_TOKENS or x.isdigit() for x in tokens[max(0, k - 1) : k] + tokens[k + 1 : k + 2]):
            return True
    return False


def plainly(text: str) -> Traced | None:
    """The text without its disguises; None where it has none."""
    odd = not text.isascii() and not ODD_SET.isdisjoint(text)
    escaped = ("%" in text or "&" in text) and ENCODED.search(text)
    if not odd and not escaped:
        tokens = text.lower().encode("utf-8", "surrogatepass").translate(APART).split()
        if not BRACKETS.search(text) and (TOKENS.isdisjoint(tokens) or not telling(tokens)):
            return None
    t = Traced(text)
    if escaped:
        t.rewrite(ENCODED, decoded)
    if odd:
        t.rewrite(ODD, homoglyph)
    t.rewrite(WORD_RUN, spelled)
    t.rewrite(AT, lambda m: [("@", m.span())])
    t.rewrite(DOT, lambda m: [(".", m.span())])
    return t if t.text != text else None


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start and kind."""
    if not text:
        return [], []
    base = detect(text)
    if (t := plainly(text)) is None:
        return base, base
    more = []
    for a, b, kind in detect(t.text):
        a, b = t.source(a, b)
        if not any(x <= a and b <= y for x, y, _ in base):
            more.append((a, b, kind))
    return base, sorted({*base, *more}, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; counts are of base spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            base, every = scan(text)
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5]), pa.array(cols[6], pa.int64())],
            [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return arrow_map(docs.select(id_col, text_col), run, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each found span, overlapping ones merged, replaced by its kind in angle brackets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text in batch.column(1).to_pylist():
            out, at = [], 0
            for a, b, k in scan(text)[1]:
                if a >= at:
                    out += [text[at:a], f"<{KINDS[k]}>"]
                at = max(at, b)
            texts.append(text if text is None else "".join([*out, text[at:]]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, text_col])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} {kind}, {text_col} string")
