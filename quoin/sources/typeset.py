"""Positioned words out of plain texts: a deterministic typesetter.

Texts are set in lines of 80 characters of 6 points, 50 lines a page, the first
line of a document in a larger size. Every page gets a head line with the
document's source and a foot line with its number. Each text is set by itself,
some thousands of words at once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS, LINES = 80, 50
MOST = 1 << 20  # characters set at once, or one longer text
WORDS = "array<struct<page_no:int,s:string,x:double,y:double,w:double,size:double>>"


class Set:
    """The words of some texts in order: their rows' numbers, the lines they fall on and their places."""

    def __init__(self, rows: list[int], texts: list[list[str]]):
        self.rows, self.words = np.array(rows, np.int64), [w for ws in texts for w in ws]
        counts = np.array([len(ws) for ws in texts], np.int64)
        self.ends = np.cumsum(np.r_[0, counts]).astype(np.int64)
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        before = np.cumsum(np.r_[0, self.length + 1])[:-1]
        cum = before - np.repeat(before[self.ends[:-1]], counts) if len(self.words) else before
        self.doc = np.repeat(np.arange(len(rows)), counts)
        self.tok = np.arange(len(self.words)) - np.repeat(self.ends[:-1], counts)
        self.line, at = cum // COLUMNS, cum % COLUMNS
        self.page = self.line // LINES
        self.x, self.y, self.w = 56 + 6.0 * at, 780 - 14.0 * (self.line % LINES), 6.0 * self.length
        self.size = np.where(self.line == 0, 22.0, 11.0)

    def starts(self, what: np.ndarray) -> np.ndarray:
        """Where a document's line or page begins."""
        return np.flatnonzero(np.r_[True, (self.doc[1:] != self.doc[:-1]) | (what[1:] != what[:-1])]) if len(self.words) else np.zeros(0, np.int64)


def typeset(batch: pa.RecordBatch) -> Iterator[Set]:
    """The texts of a batch, set; those without words are left out."""
    rows, texts, held = [], [], 0
    for k, text in enumerate(batch.column("text").to_pylist()):
        words = [w for w in text.replace("\n", " ").split(" ") if w]
        if words:
            if rows and held + len(text) > MOST:
                yield Set(rows, texts)
                rows, texts, held = [], [], 0
            rows.append(k)
            texts.append(words)
            held += len(text)
    if rows:
        yield Set(rows, texts)


def _mapped(docs: DataFrame, make, schema: str, spread: bool = True, then=None) -> DataFrame:
    """What ``make`` gives of each set of texts, after the document's id; null ids and texts have none.

    ``then`` may make other batches out of each, in the same task. The texts are spread over all parts first, as a file of few row groups would be set by few tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sources = batch.column("source").to_pylist()
            for t in typeset(batch):
                doc, columns = make(t, [sources[k] for k in t.rows.tolist()])
                made = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(t.rows[doc])), **columns})
                yield from [made] if then is None else then(made)

    found = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", "source")
    return (found.repartition(_parts(docs), "doc_id") if spread else found).mapInArrow(run, f"doc_id {kind}, {schema}")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ints(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int32))


def tokens(docs: DataFrame) -> DataFrame:
    """The table of positioned words and the lines they fall on, without head and foot lines."""

    def make(t: Set, sources: list):
        return t.doc, {"page_no": _ints(t.page), "tok_no": _ints(t.tok), "s": pa.array(t.words, pa.string()), "x": t.x, "y": t.y, "w": t.w, "size": t.size, "line": _ints(t.line)}

    return _mapped(docs, make, "page_no int, tok_no int, s string, x double, y double, w double, size double, line int")


def framed_lines(docs: DataFrame) -> DataFrame:
    """The lines with each page's head and foot line, their order on the page, and whether a line is one of the two at either edge.

    They are shuffled once, by document; all that follows keeps this partitioning.
    """

    def make(t: Set, sources: list):
        start = t.starts(t.line)
        texts = [" ".join(t.words[a:b]) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(t.words)])]
        first = np.flatnonzero(np.r_[True, (t.doc[start[1:]] != t.doc[start[:-1]]) | (t.page[start[1:]] != t.page[start[:-1]])])
        end = np.r_[first[1:], len(start)]
        p = np.arange(len(first))
        own, head, foot = np.arange(len(start)) + 2 * np.repeat(p, end - first) + 1, first + 2 * p, end + 2 * p + 1
        n = len(start) + 2 * len(first)

        def column(of_own, of_head, of_foot, kind):
            out = np.empty(n, kind)
            out[own], out[head], out[foot] = of_own, of_head, of_foot
            return out

        page, doc = t.page[start], t.doc[start]
        made = np.array(texts, object), np.array([sources[d] or "" for d in doc[first].tolist()], object), np.array([f"Page {k + 1}" for k in page[first].tolist()], object)
        at = np.arange(n) - np.repeat(head, foot - head + 1)
        edge = (at < 2) | (at >= np.repeat(foot - head - 1, foot - head + 1))
        both = lambda a: column(a, a[first], a[first], np.int64)
        return both(doc), {
            "page_no": _ints(both(page)), "line": _ints(column(t.line[start], -1, 2**31 - 1, np.int64)), "y": column(t.y[start], 810.0, 30.0, np.float64),
            "size": column(t.size[start], 8.0, 8.0, np.float64), "text": pa.array(column(*made, object), pa.string()), "edge": edge,
        }

    return _mapped(docs, make, "page_no int, line int, y double, size double, text string, edge boolean", spread=False).repartition(_parts(docs), "doc_id")


def _lists(fields: dict, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(_ints(ends), pa.StructArray.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in fields.values()], list(fields)))


def pages(docs: DataFrame, then=None, schema: str = f"words {WORDS}") -> DataFrame:
    """doc_id and words: the positioned words of each document in an array, without head and foot lines; or what ``then`` makes of them."""

    def make(t: Set, sources: list):
        words = {"page_no": _ints(t.page), "s": pa.array(t.words, pa.string()), "x": t.x, "y": t.y, "w": t.w, "size": t.size}
        return np.arange(len(t.rows)), {"words": _lists(words, t.ends)}

    return _mapped(docs, make, schema, then=then)


def framed_pages(docs: DataFrame, then=None, schema: str = f"words {WORDS}") -> DataFrame:
    """doc_id and words: all words of the pages in an array for each document, those of head and foot lines too; or what ``then`` makes of them."""

    def make(t: Set, sources: list):
        first = t.starts(t.page)
        end = np.r_[first[1:], len(t.words)]
        p = np.arange(len(first))
        own, marks = np.arange(len(t.words)) + 3 * np.repeat(p, end - first), end + 3 * p
        n = len(t.words) + 3 * len(first)
        page, doc = t.page[first], t.doc[first]
        said = [(sources[d] or "", "Page", str(k + 1)) for d, k in zip(doc.tolist(), page.tolist())]

        def column(of_own, of_marks, kind):
            out = np.empty(n, kind)
            out[own] = of_own
            for k, v in enumerate(of_marks):
                out[marks + k] = v
            return out

        s = column(np.array(t.words, object), [np.array([x[k] for x in said], object) for k in range(3)], object)
        words = {
            "page_no": _ints(column(t.page, [page] * 3, np.int64)), "s": pa.array(s, pa.string()), "x": column(t.x, (56.0, 280.0, 306.0), np.float64), "y": column(t.y, (810.0, 30.0, 30.0), np.float64),
            "w": column(t.w, [6.0 * np.array([len(x[k]) for x in said]) for k in range(3)], np.float64), "size": column(t.size, (8.0,) * 3, np.float64),
        }
        held = np.bincount(doc, minlength=len(t.rows))
        return np.arange(len(t.rows)), {"words": _lists(words, t.ends + 3 * np.cumsum(np.r_[0, held]))}

    return _mapped(docs, make, schema, then=then)
