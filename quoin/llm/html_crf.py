"""Main text of web pages by a conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks: runs of text between block-level tags. A
linear-chain CRF with the labels boilerplate and content scores each block by
features of its ancestor tags and of its text, and each step by the pair of
labels; Viterbi decoding gives the best labelling, and the content blocks are the
page's text.

Training pages are those that mark their main text by an ``article`` or ``main``
element: blocks inside are content. These tags are hidden from the features, so
the model must work without them. At most ``train_pages`` pages are used (the
least hashes of the html, equal pages counted once); decoding covers all pages and all of their blocks.

Semantics
  * One row per row of the input, repeated ones included. A null html has null
    text and 0 blocks; an empty one, or one without text, "" and 0 blocks.
  * Broken markup never fails: unclosed tags end with their parent, stray end tags
    are skipped, an unclosed comment or script runs to the end of the page.
  * Ties of Viterbi go to content. Without training pages nothing can be learned:
    all blocks are content. Extra columns are not looked at; an empty table gives
    no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, HASH_BITS, EPOCHS = 400, 13, 8
MARKED = {"article", "main"}
HIDDEN = {"script", "style", "noscript", "template", "head", "textarea", "svg"}
INLINE = set("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks_of(page: str) -> list[tuple[str, tuple[str, ...], float, bool]]:
    """(text, ancestor tags with classes, share of link text, inside a marked element) of each leaf block."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    path: tuple[str, ...] = ()
    hidden = marked = links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, path, min(1.0, linked / max(1, len(text))), marked > 0))
        parts, linked = [], 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group(0)
            if not hidden and not (text[0] == "<" and len(text) > 1):
                if not parts:
                    path = tuple(x for _, f in stack for x in f)
                text = entities.unescape(text)
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if m.group(1):
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if k >= 0:
                gone = [t for t, _ in stack[k:]]
                del stack[k:]
                hidden -= sum(t in HIDDEN for t in gone)
                marked -= sum(t in MARKED for t in gone)
                links -= sum(t == "a" for t in gone)
        elif tag not in VOID and not m.group(3).endswith("/"):
            if tag in ("script", "style"):
                end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            # a p or li that isn't closed ends with the next one
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
            names = " ".join("".join(x) for x in ATTR.findall(m.group(3))).lower().split()
            own = (() if tag in MARKED else (tag,)) + tuple("." + x for x in names)
            stack.append((tag, own))
            hidden += tag in HIDDEN
            marked += tag in MARKED
            links += tag == "a"
    flush()
    return out


def features(blocks: list, bits: int = HASH_BITS) -> list[np.ndarray]:
    """Hashed features of each block of a page."""
    mask, out = (1 << bits) - 1, []
    n = len(blocks)
    for k, (text, path, link, _) in enumerate(blocks):
        words = text.count(" ") + 1
        size = len(text)
        names = {"bias", f"words{words.bit_length()}", f"link{int(link * 4)}", f"end{text[-1] in '.!?'}", f"digits{int(10 * sum(c.isdigit() for c in text) / size)}", f"upper{text[:1].isupper()}", f"mean{min(12, size // words)}", f"first{k < 3}", f"last{n - k}" if n - k < 3 else "inner", f"copy{'©' in text}"}
        names.update("in:" + t for t in path)
        names.update(f"near:{'>'.join(path[-j:])}" for j in (1, 2))
        names.add(f"leaf:{path[-1] if path else ''}|{min(6, words.bit_length())}")
        out.append(np.fromiter({zlib.crc32(x.encode()) & mask for x in names}, np.int64))
    return out


class Field:
    """Weights of a linear-chain CRF with two labels, 1 for content."""

    def __init__(self, bits: int = HASH_BITS):
        self.state, self.step = np.zeros((1 << bits, 2)), np.zeros((2, 2))

    def scores(self, page: list[np.ndarray]) -> np.ndarray:
        return np.array([self.state[f].sum(0) for f in page]) if page else np.zeros((0, 2))

    def marginals(self, s: np.ndarray):
        """(log of the sum over labellings, P(label) by block, summed P(label pair))."""
        n = len(s)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = s[0]
        for i in range(1, n):
            a[i] = s[i] + np.logaddexp(a[i - 1, 0] + self.step[0], a[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            x = self.step + s[i + 1] + b[i + 1]
            b[i] = np.logaddexp(x[:, 0], x[:, 1])
        z = np.logaddexp(*a[-1])
        pairs = np.exp(a[:-1, :, None] + self.step + (s + b)[1:, None, :] - z).sum(0) if n > 1 else np.zeros((2, 2))
        return z, np.exp(a + b - z), pairs

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return np.zeros(0, np.int64)
        back, v = np.zeros((n, 2), np.int64), s[0]
        for i in range(1, n):
            x = v[:, None] + self.step
            back[i] = np.where(x[1] >= x[0], 1, 0)
            v = s[i] + x.max(0)
        out = np.empty(n, np.int64)
        out[-1] = int(v[1] >= v[0])
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def fit(self, pages: list[tuple[list[np.ndarray], np.ndarray]], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 1) -> Field:
        """Maximum likelihood by AdaGrad, a page at a time."""
        seen_state, seen_step = np.full_like(self.state, 1e-2), np.full_like(self.step, 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(pages)):
                feats, y = pages[k]
                _, p, pairs = self.marginals(self.scores(feats))
                want = np.zeros((2, 2))
                np.add.at(want, (y[:-1], y[1:]), 1)
                g = (np.eye(2)[y] - p) / len(y)
                at = np.concatenate(feats)
                whole = np.repeat(g, [len(f) for f in feats], 0)
                used, inverse = np.unique(at, return_inverse=True)
                grad = np.zeros((len(used), 2))
                np.add.at(grad, inverse, whole)
                grad -= 1e-4 * self.state[used]
                seen_state[used] += grad**2
                self.state[used] += rate * grad / np.sqrt(seen_state[used])
                grad = (want - pairs) / len(y) - 1e-4 * self.step
                seen_step += grad**2
                self.step += rate * grad / np.sqrt(seen_step)
        return self


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Field:
    """A field of at most ``train_pages`` pages that mark their main text."""
    marked = pages.filter(F.lower("html").rlike("<(article|main)[ >]")).select(F.xxhash64("html").alias("h"), "html")
    # hashes are uniform: so many lie below this bound that next to no others are read, however many tasks there are
    n, share = marked.count(), 1.0
    if n > 2 * train_pages:
        share = (train_pages + 8 * train_pages**0.5 + 8) / n
    while True:
        few = marked if share >= 1 else marked.filter(F.col("h") < int(-(2**63) + share * 2**64))
        # equal pages count once
        rows = few.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(train_pages).collect()
        if len(rows) >= train_pages or share >= 1:
            break
        share *= 4
    field = Field()
    samples = []
    for row in rows:
        blocks = blocks_of(row.html)
        if blocks:
            samples.append((features(blocks), np.array([int(b[3]) for b in blocks])))
    if not samples:
        field.state[zlib.crc32(b"bias") & ((1 << HASH_BITS) - 1), 1] = 1.0
    return field.fit(samples)


def extractor(field: Field):
    def run(batches):
        for batch in batches:
            n, kept, texts = [], [], []
            for page in batch.column("html").to_pylist():
                blocks = blocks_of(page) if page else []
                labels = field.viterbi(field.scores(features(blocks)))
                n.append(len(blocks))
                kept.append(int(labels.sum()))
                texts.append(None if page is None else "\n".join(b[0] for b, y in zip(blocks, labels) if y))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "n_blocks": pa.array(n, pa.int32()), "n_content": pa.array(kept, pa.int32()), "text": pa.array(texts, pa.string())})

    return run


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, n_blocks, n_content, text: see the module's docstring."""
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return clean.mapInArrow(extractor(field), "page_id long, n_blocks int, n_content int, text string")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
