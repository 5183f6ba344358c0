"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

Each block (html_blocks) has binary features of its ancestors' tags and class, id and role words, and of its text; two
neighbouring blocks have a transition that depends on whether they share their element, its parent, or neither. The
field is trained by full-batch gradient steps with forward and backward sums over labelled pages, and pages are decoded
by Viterbi. Blocks labelled as main, joined by line breaks, are the text.

Labelled pages are HTML whose elements carry data-main="1" or "0" (it holds for what is inside, until another one);
`html_pages.labelled` composes PAGES of them from layouts; `train` takes any others, so many that they fit the driver.

Defined cases: null or empty html, and pages without a main block, give an empty text; every row of `pages` gives a
row, repeated ids included; other columns are not read. Pages are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map
from tessera.llm.html_blocks import Block, Reader
from tessera.llm.html_pages import labelled

#: Composed labelled pages that the model is trained on, steps of training, their length, and the weight of the squared weights.
PAGES, STEPS, RATE, PENALTY = 500, 120, 0.15, 0.01
#: How a block stands to the one before: in the same element, in the same parent, elsewhere.
NEAR = 3


class Field(NamedTuple):
    weights: dict[str, float]  # of a feature for the label main
    moves: list[list[list[float]]]  # [nearness][label before][label]


def nearness(a: Block, b: Block) -> int:
    return 0 if a.parent[0] == b.parent[0] else 1 if a.parent[1] == b.parent[1] else 2


def decode(blocks: list[Block], field: Field) -> list[bool]:
    """The likeliest labels (Viterbi); ties go to not main."""
    if not blocks:
        return []
    get = field.weights.get
    bias = get("bias", 0.0)
    other, main, back = 0.0, bias + sum(get(f, 0.0) for f in sorted(blocks[0].features)), []
    for a, b in zip(blocks, blocks[1:]):
        m = field.moves[nearness(a, b)]
        to_other, to_main = (other + m[0][0], main + m[1][0]), (other + m[0][1], main + m[1][1])
        back.append((to_other[1] > to_other[0], to_main[1] > to_main[0]))
        other, main = max(to_other), max(to_main) + bias + sum(get(f, 0.0) for f in sorted(b.features))
    out = [main > other]
    for one in reversed(back):
        out.append(one[out[-1]])
    return out[::-1]


def train(pages: Iterable[str], steps: int = STEPS) -> Field:
    """A field from labelled pages. Features of two blocks or one are left out."""
    read = [b for p in pages if (b := Reader().read(p))]
    counts: dict[str, int] = {}
    for blocks in read:
        for b in blocks:
            for f in b.features:
                counts[f] = counts.get(f, 0) + 1
    names = ["bias", *sorted(f for f, n in counts.items() if n > 2)]
    ids = {f: i for i, f in enumerate(names)}
    n, longest = len(read), max(map(len, read), default=0)
    flat, owner = [], []
    truth, near, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for p, blocks in enumerate(read):
        for t, b in enumerate(blocks):
            mine = [0, *(ids[f] for f in sorted(b.features) if f in ids)]
            flat += mine
            owner += [p * longest + t] * len(mine)
            truth[p, t], there[p, t] = bool(b.main), True
            near[p, t] = nearness(blocks[t - 1], b) if t else 0
    flat, owner = np.array(flat, np.int64), np.array(owner, np.int64)
    w, moves = np.zeros(len(names)), np.zeros((NEAR, 2, 2))
    momentum, scale = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(owner, w[flat], n * longest).reshape(n, longest)
        chance, pairs = marginals(emit, moves, near, there)
        miss = np.where(there, truth - chance[:, :, 1], 0.0).ravel()
        gradient = [np.bincount(flat, miss[owner], len(names)) - PENALTY * w, -PENALTY * moves]
        for k in range(NEAR):
            at = there[:, 1:] & (near[:, 1:] == k)
            for a in range(2):
                for b in range(2):
                    gradient[1][k, a, b] += ((truth[:, :-1] == a) & (truth[:, 1:] == b) & at).sum() - pairs[:, :, a, b][at].sum()
        for i, x in enumerate((w, moves)):  # Adam
            momentum[i] = 0.9 * momentum[i] + 0.1 * gradient[i]
            scale[i] = 0.99 * scale[i] + 0.01 * gradient[i] ** 2
            x += RATE * (momentum[i] / (1 - 0.9**step)) / (np.sqrt(scale[i] / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, w.tolist())), moves.tolist())


def marginals(emit: np.ndarray, moves: np.ndarray, near: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of labels [page, block, label] and of neighbouring labels [page, block - 1, before, label] by forward and backward sums, scaled at each block."""
    n, longest = there.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(moves)[near]
    forward, backward = np.zeros((n, longest, 2)), np.ones((n, longest, 2))
    for t in range(longest):
        f = e[:, t] if t == 0 else np.einsum("pa,pab->pb", forward[:, t - 1], m[:, t]) * e[:, t]
        forward[:, t] = np.where(there[:, t, None], f / f.sum(axis=1, keepdims=True), 0.5)
    for t in range(longest - 2, -1, -1):
        b = np.einsum("pab,pb->pa", m[:, t + 1], e[:, t + 1] * backward[:, t + 1])
        backward[:, t] = np.where(there[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    chance = forward * backward
    chance /= chance.sum(axis=2, keepdims=True)
    pairs = forward[:, :-1, :, None] * m[:, 1:] * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
    return chance, pairs / np.maximum(pairs.sum(axis=(2, 3), keepdims=True), 1e-300)


@lru_cache(maxsize=1)
def model() -> Field:
    return train(labelled(PAGES))


def main_text(html: str | None, field: Field) -> str:
    blocks = Reader(field.weights.keys()).read(html or "")
    return "\n".join(b.text for b, main in zip(blocks, decode(blocks, field)) if main)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html)."""
    field = field or model()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html.as_py(), field) for html in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
