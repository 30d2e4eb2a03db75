"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between tags that are not inline. A block's
features are the tags and class words of its ancestors and its text (length, link share,
punctuation, place). The field has one weight per feature and one per pair of neighbouring
labels; it is trained by stochastic gradient ascent on labelled pages, in which an element
with ``data-main`` marks its blocks as main text, and each page is decoded by Viterbi.

Character references are decoded, white space in a block becomes one space, and the blocks
kept are joined in page order by one space.

Defined results: a null or empty page, or one without main blocks, has the empty text;
unclosed tags end with their parent; comments, scripts, styles, titles and form fields have
no blocks; repeated rows get equal texts; long pages are read whole; other columns are
ignored.
"""

from __future__ import annotations

import html as references
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.html_pages import labelled_pages

EPOCHS = 12
RATE = 0.3
RIDGE = 1e-4
#: Paths through the DOM that a task remembers before it starts afresh.
MEMORY = 50_000

_INLINE = frozenset("a b i em strong span u s small sub sup code mark abbr cite q time font kbd var samp del ins tt big wbr img bdi bdo data dfn".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(script|style|title|textarea)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.DOTALL | re.IGNORECASE,
)
#: Elements whose text is left out until they close; they are walked like any other.
_SILENT = frozenset("select noscript template svg iframe".split())
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_MAIN = re.compile(r"\bdata-main\b")
_LOWER = re.compile(r"[a-z]+")


class Paths:
    """Features of DOM paths, shared by all pages of a task."""

    def __init__(self):
        self.known: dict = {}

    def child(self, path: frozenset, tag: str, attributes: str) -> frozenset:
        key = (path, tag, attributes)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            own = {f"in:{tag}"}
            for values in _NAMES.findall(attributes):
                own.update(f"class:{w}" for w in _LOWER.findall("".join(values).lower()))
            if _HIDDEN.search(attributes):
                own.add("class:hidden")
            if _MAIN.search(attributes):
                own.add("*main")
            found = self.known[key] = path | own
        return found


def blocks(page: str | None, paths: Paths) -> list[tuple[frozenset, str, str, float]]:
    """(features of the path, innermost block tag, text, share of linked characters) of every leaf block."""
    page = page or ""
    out: list[tuple[frozenset, str, str, float]] = []
    stack: list[tuple[str, frozenset]] = [("", frozenset())]
    parts: list[str] = []
    linked = links = 0
    silent = 0  # place in the stack of the outermost open element whose text is left out

    def close() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = references.unescape(text)
            text = " ".join(text.split())
            if text:
                at = (silent or len(stack)) - 1
                while at and stack[at][0] in _INLINE:
                    at -= 1
                out.append((stack[at][1], stack[at][0], text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at and not silent:
            parts.append(page[at : token.start()])
            if links:
                linked += token.start() - at
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if not silent:
                parts.append(" ")
            continue
        inline = tag in _INLINE
        if not inline and not silent and tag not in _SILENT:
            close()
        if token[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if k < silent:
                        if not inline:
                            close()
                        silent = 0
                    elif k == silent:
                        silent = 0
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
                if inline and stack[k][0] not in _INLINE:
                    break
            continue
        if tag in _VOID:
            continue
        if silent or tag in _SILENT:
            if not token[4].endswith("/"):
                silent = silent or len(stack)
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
            continue
        if not inline:  # an open paragraph ends here, an open item ends at the next one
            k = len(stack) - 1
            while k and (stack[k][0] in _INLINE or stack[k][0] in ("p", tag if tag in ("li", "td", "tr", "dt", "dd", "option") else "p")):
                if stack[k][0] not in _INLINE:
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                k -= 1
        if not token[4].endswith("/"):
            stack.append((tag, paths.child(stack[-1][1], tag, token[4]) if not inline else stack[-1][1]))
            links += tag == "a"
    if at < len(page) and not silent:
        parts.append(page[at:])
    close()
    return out


def features(found: list[tuple[frozenset, str, str, float]]) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    for k, (path, tag, text, linked) in enumerate(found):
        n = text.count(" ") + 1
        own = [f for f in path if f[0] != "*"]
        own += [
            f"leaf:{tag}", f"words:{min(6, n.bit_length())}", f"links:{math.ceil(linked * 3)}",
            "end:stop" if text[-1] in ".!?…\"”" else "end:none",
        ]
        if "©" in text:
            own.append("text:copyright")
        if k == 0:
            own.append("place:first")
        if k == len(found) - 1:
            own.append("place:last")
        out.append(own)
    return out


class Field:
    """Weights of a two-label chain; label 1 is main text."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.step = np.zeros((2, 2))
        self.bias = 0.0

    def emissions(self, page: list[list[str]]) -> list[float]:
        """Score of label 1 over label 0 of each block."""
        weight = self.weight
        return [self.bias + sum(weight.get(f, 0.0) for f in block) for block in page]

    def marginals(self, scores: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Chance of label 1 of each block, and of each pair of neighbouring labels summed over the page."""
        n = len(scores)
        local = np.array([[0.0, s] for s in scores])
        forward, backward = np.empty((n, 2)), np.zeros((n, 2))
        forward[0] = local[0]
        for k in range(1, n):
            forward[k] = local[k] + np.logaddexp(forward[k - 1][0] + self.step[0], forward[k - 1][1] + self.step[1])
        for k in range(n - 2, -1, -1):
            after = local[k + 1] + backward[k + 1]
            backward[k] = np.logaddexp(self.step[:, 0] + after[0], self.step[:, 1] + after[1])
        total = np.logaddexp(*forward[-1])
        pairs = np.zeros((2, 2))
        if n > 1:
            joint = forward[:-1, :, None] + self.step + (local[1:] + backward[1:])[:, None, :] - total
            pairs = np.exp(joint).sum(axis=0)
        return np.exp(forward[:, 1] + backward[:, 1] - total), pairs

    def viterbi(self, scores: list[float]) -> list[int]:
        (a, b), (c, d) = self.step.tolist()
        low, high, back = 0.0, 0.0, []
        for k, score in enumerate(scores):
            if k:
                from_low, from_high = low + b, high + d
                stay_low, stay_high = low + a, high + c
                back.append((int(stay_high > stay_low), int(from_high > from_low)))
                low, high = max(stay_low, stay_high), max(from_low, from_high) + score
            else:
                low, high = 0.0, score
        if not scores:
            return []
        label = int(high > low)
        labels = [label]
        for came in reversed(back):
            label = came[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[str], epochs: int = EPOCHS, seed: int = 3) -> Field:
        """Stochastic gradient ascent on the conditional log-likelihood of labelled pages."""
        paths, examples = Paths(), []
        for page in pages:
            found = blocks(page, paths)
            if found:
                examples.append((features(found), np.array([float("*main" in path) for path, *_ in found])))
        order = random.Random(seed)
        for epoch in range(epochs):
            order.shuffle(examples)
            rate = RATE / (1 + 0.3 * epoch)
            for page, labels in examples:
                chance, pairs = self.marginals(self.emissions(page))
                off = labels - chance
                for block, x in zip(page, (rate * off).tolist(), strict=True):
                    for f in block:
                        old = self.weight.get(f, 0.0)
                        self.weight[f] = old + x - rate * RIDGE * old
                self.bias += rate * float(off.sum()) * 0.1
                seen = np.zeros((2, 2))
                np.add.at(seen, (labels[:-1].astype(int), labels[1:].astype(int)), 1)
                self.step += 0.1 * rate * (seen - pairs)
        return self

    def text(self, page: str | None, paths: Paths) -> str:
        found = blocks(page, paths)
        labels = self.viterbi(self.emissions(features(found)))
        return " ".join(text for (_, _, text, _), label in zip(found, labels, strict=True) if label)


def main_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; ``labelled`` are the pages to learn from."""
    field = pages.sparkSession.sparkContext.broadcast(Field().fit(labelled_pages() if labelled is None else labelled))

    def extract(batches):
        paths = Paths()
        for batch in batches:
            texts = [field.value.text(p, paths) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
