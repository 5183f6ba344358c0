"""HTML pages as sequences of leaf blocks with features of their ancestors and texts.

A tolerant reader, linear in the page's length: comments, quoted attributes, raw elements, implied end tags. A leaf
block is the text between two borders of block elements; inline elements and `<br>` don't end it. Character references
are decoded, white space becomes one space. Unclosed quotes, tags and elements end where browsers or common sense end
them; a `<` that begins no tag is text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

# The element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noembed noframes iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open element of the first kind, up to the nearest of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words that often stand in what surrounds an article; features, weighed by the model.
CUES = frozenset("advertisement sponsored cookie cookies consent privacy terms login subscribe newsletter share related comments comment reply copyright rights reserved menu search posted follow read next previous".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+))?+|=)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<[!?/][^>]*+>")
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in (*RAW, "textarea", "title")}


class Block(NamedTuple):
    text: str
    features: frozenset
    parent: tuple  # numbers of the enclosing block elements, nearest first, two at most
    main: bool | None


class _Element:
    __slots__ = ("tag", "tokens", "inherited", "number", "main", "up")

    def __init__(self, tag: str, tokens: frozenset, up: _Element | None, number: int, main: bool | None, known):
        self.tag, self.tokens, self.number = tag, tokens, number
        self.main = up.main if up is not None and main is None else main
        own = {f"in:{tag}", *(f"has:{t}" for t in tokens)}
        before = up.inherited if up is not None else frozenset()
        if known is not None:
            own = {f for f in own if f in known}
        self.inherited = before if own <= before else before | own
        self.up = up


def _tokens(attributes: str) -> tuple[frozenset, bool | None]:
    found, main = set(), None
    for name, a, b, c in _NAMES.findall(attributes):
        value = a or b or c
        if name.lower() == "data-main":
            main = value == "1"
        else:
            found.update(t.lower() for t in _TOKEN.findall(value[:200]) if len(t) > 1)
    return frozenset(found), main


def bucket(n: float, *limits: float) -> int:
    return sum(n > x for x in limits)


class Reader:
    """Reads one page. `known`: features that a model has weights for; others of the ancestors aren't kept."""

    def __init__(self, known=None):
        self.known, self.blocks, self.title = known, [], ""
        self.stack: list[_Element] = [_Element("html", frozenset(), None, 0, None, known)]
        self.open, self.number = Counter(), 0
        self.inline: Counter = Counter()
        self.pieces: list[str] = []
        self.linked, self.length = 0, 0

    def text(self, raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            self.length += len(raw)
            if self.inline["a"]:
                self.linked += len(raw)

    def border(self) -> None:
        """Ends a block, and the inline elements that are open in it."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(self.block(text))
            self.pieces.clear()
        self.linked, self.length = 0, 0

    def block(self, text: str) -> Block:
        near = self.stack[-1]
        up = near.up
        words = text[:400].lower().split()
        share = self.linked / max(self.length, 1)
        own = {f"own:{near.tag}", f"words:{bucket(text.count(' ') + 1, 2, 5, 10, 25, 60)}", f"links:{bucket(share, 0, 0.3, 0.7)}", f"stop:{text[-1] in '.!?…:;,'}"}
        own.update(f"near:{t}" for t in near.tokens)
        if up is not None:
            own.add(f"up:{up.tag}")
            own.update(f"near:{t}" for t in up.tokens)
        own.update(f"cue:{w}" for w in map(lambda w: w.strip(".,:!?"), words[:12]) if w in CUES)
        if "©" in text[:200]:
            own.add("cue:©")
        if self.title and (text in self.title or self.title in text):
            own.add("title")
        features = near.inherited | (own if self.known is None else own & self.known)
        return Block(text, features, (near.number, up.number if up is not None else -1), near.main)

    def pop(self, count: int) -> None:
        for _ in range(count):
            self.open[self.stack.pop().tag] -= 1

    def up_to(self, tags: set[str], until: set[str]) -> int:
        """How many elements to close so that the nearest of `tags` is closed; 0 if one of `until` comes first."""
        if not any(self.open[t] for t in tags):
            return 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return len(self.stack) - k
            if self.stack[k].tag in until:
                return 0
        return 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.pieces.append(" ")
            elif tag not in VOID:
                self.inline[tag] += 1
            return
        self.border()
        self.inline.clear()
        if self.stack[-1].tag == "p":
            self.pop(1)
        if tag in ENDS:
            self.pop(self.up_to(*ENDS[tag]))
        if tag in VOID or tag in ("html", "body", "head"):
            return
        self.number += 1
        tokens, main = _tokens(attributes) if attributes else (frozenset(), None)
        self.stack.append(_Element(tag, tokens, self.stack[-1], self.number, main, self.known))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.pieces.append(" ")
            elif self.inline[tag]:
                self.inline[tag] -= 1
            return
        self.border()
        self.inline.clear()
        if self.open[tag]:
            self.pop(self.up_to({tag}, set()))

    def read(self, html: str) -> list[Block]:
        at, last, loose = 0, html.rfind(">"), False
        while (here := html.find("<", at)) >= 0 and (here < last or html.startswith("<!--", here)):
            if html.startswith("<!--", here):
                self.text(html[at:here])
                end = html.find("-->", here + 2)  # <!--> is a comment as well
                at = end + 3 if end >= 0 else len(html)
                continue
            found = (_LOOSE if loose else _TAG).match(html, here)
            if found is None and not loose and html[here + 1 : here + 2].isalpha():
                loose, found = True, _LOOSE.match(html, here)
            if found is None:
                other = _OTHER.match(html, here)
                self.text(html[at:here] if other else html[at : here + 1])
                at = other.end() if other else here + 1
                continue
            self.text(html[at:here])
            closing, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
            at = found.end()
            if closing:
                self.end(tag)
                continue
            if tag not in _END:
                self.start(tag, attributes)
                continue
            over = _END[tag].search(html, at)
            inner = html[at : over.start() if over else len(html)]
            if tag == "title" and not self.title:
                self.title = " ".join(unescape(inner).split())
            elif tag == "textarea":
                self.start(tag, attributes)
                self.text(inner)
                self.end(tag)
            at = html.find(">", over.start()) + 1 if over else len(html)
            if not at:
                at = len(html)
        self.text(html[at:])
        self.border()
        return self.blocks
