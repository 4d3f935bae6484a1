"""Words of documents to Markdown, many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.page import Word, convert, documents, in_order, line_starts
from ..operators.rulings import lattices, segments

RESULTS, LINES = "md string, n_pages int", "page_no int, y double, n_words long, x double, size double, text string"
WORD = ("page_no", "s", "x", "y", "w", "size")
RULE = ("page_no", "axis", "pos", "a1", "a2")
MOST = 200_000  # words laid out at once, or one document of more


def held(lists: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each row's items begin and end, and the items' fields, of a column of lists of structs."""
    ends = np.cumsum(np.r_[0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]).astype(np.int64)
    items = lists.flatten()
    return ends, [items.field(k) for k in names]


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` items, or of one row."""
    n, a = len(ends) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def numbers(c: pa.Array) -> np.ndarray:
    return c.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def ruled(words: list[tuple], rules: list[tuple], n: int) -> str:
    """The Markdown of a document that has rulings."""
    pages: list[list[Word]] = [[] for _ in range(n)]
    segs: list[list[tuple]] = [[] for _ in range(n)]
    for k, *word in words:
        pages[k].append(Word(*word))
    for k, *rule in rules:
        if 0 <= k < n:
            segs[k].append(tuple(rule))
    found: list[list[tuple[float, str]]] = [[] for _ in range(n)]
    for k in range(n):
        if segs[k]:
            pages[k], found[k] = lattices(pages[k], segs[k])
    return convert(pages, found)


def lay_out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, md, n_pages of documents with their words, in order by page, and, if there are any, their rulings; those without words have none."""
    ends, (page, s, *places) = held(batch.column("words"), WORD)
    page, places = page.to_numpy(zero_copy_only=False), [numbers(c) for c in places]
    # words without geometry can't be placed
    placed = np.logical_and.reduce([v == v for v in places]) & (pa.compute.binary_length(s).fill_null(0).to_numpy(zero_copy_only=False) > 0)
    rule_ends, rules = held(batch.column("rules"), RULE) if "rules" in batch.schema.names else (np.zeros(len(batch) + 1, np.int64), [])
    rows = np.arange(len(batch))
    for a, b in slices(ends, MOST):
        i, j = int(ends[a]), int(ends[b])
        kept = np.flatnonzero(placed[i:j]) + i
        some = np.flatnonzero(np.diff(ends[a : b + 1]) > 0) + a
        n_pages = (np.maximum.reduceat(page[i:j], ends[some] - i) + 1).astype(np.int64) if len(some) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(some)), np.diff(ends[a : b + 1])[some - a])[kept - i]
        text, own = s.take(pa.array(kept)).to_pylist(), [v[kept] for v in places]
        lined = rule_ends[some + 1] > rule_ends[some]
        md: list[str | None] = [None] * len(some)
        plain = np.flatnonzero(~lined)
        if len(plain) == len(some):
            md = documents(len(some), doc, page[kept], text, *own, n_pages.tolist())
        else:
            if len(plain):
                at = np.flatnonzero(~lined[doc])
                nth = np.cumsum(~lined) - 1
                for k, x in zip(plain.tolist(), documents(len(plain), nth[doc[at]], page[kept][at], [text[t] for t in at.tolist()], *[v[at] for v in own], n_pages[plain].tolist())):
                    md[k] = x
            cut = np.searchsorted(doc, np.arange(len(some) + 1))
            every = list(zip(page[kept].tolist(), text, *(v.tolist() for v in own)))
            for k in np.flatnonzero(lined).tolist():
                r0, r1 = int(rule_ends[some[k]]), int(rule_ends[some[k] + 1])
                md[k] = ruled(every[cut[k] : cut[k + 1]], list(zip(*(c.slice(r0, r1 - r0).to_pylist() for c in rules))), int(n_pages[k]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(rows[some])), "md": pa.array(md, pa.string()), "n_pages": pa.array(n_pages, pa.int32())})


def laid_out(docs: DataFrame, words: Column, rules: Column | None = None) -> DataFrame:
    """doc_id, md, n_pages of documents with arrays of words, in order by page, and of rulings."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"), *([] if rules is None else [rules.alias("rules")]))
    return found.mapInArrow(lambda batches: (x for batch in batches for x in lay_out(batch)), f"doc_id long, {RESULTS}")


def markdown(words: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """doc_id, md, n_pages of tables of words and, if there are any, of vector paths."""
    docs = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "tok_no", "s", "x", "y", "w", "size"))).alias("ws"))
    if paths is None:
        return laid_out(docs, F.col("ws"))
    found = paths.select("doc_id", F.transform(segments(), lambda t: F.struct(F.col("page_no"), *[t[k].alias(k) for k in RULE[1:]])).alias("rs"))
    rules = found.groupBy("doc_id").agg(F.flatten(F.collect_list("rs")).alias("rs"))
    return laid_out(docs.join(rules, "doc_id", "left"), F.col("ws"), F.col("rs"))


def fold_lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id and LINES of the lines that the words of documents form: the anchored fold from the top of each page; a line's words as they come."""
    ends, (page, s, *places) = held(batch.column("words"), WORD)
    page, places = page.to_numpy(zero_copy_only=False).astype(np.int64), [numbers(c) for c in places]
    for a, b in slices(ends, MOST):
        i, j = int(ends[a]), int(ends[b])
        if i == j:
            continue
        doc, own = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1])), page[i:j]
        text, (x, y, _, size), at = s.slice(i, j - i).to_pylist(), (v[i:j] for v in places), np.arange(j - i)
        whole = doc * (own.max() + 1) + own
        order = in_order(whole, y, x)
        if order is not None:
            whole, doc, own, x, y, size, at = (v[order] for v in (whole, doc, own, x, y, size, at))
        starts = line_starts(whole, y, size)
        count = np.diff(np.r_[starts, j - i])
        if (np.diff(at) < 0).any():
            at = at[np.lexsort((at, np.repeat(np.arange(len(starts)), count)))]
            text = [text[k] for k in at.tolist()]
        lines = [" ".join(text[u:v]) for u, v in zip(starts.tolist(), (starts + count).tolist())]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(doc[starts])), "page_no": pa.array(own[starts].astype(np.int32)), "y": y[starts], "n_words": count.astype(np.int64),
            "x": np.minimum.reduceat(x, starts), "size": np.maximum.reduceat(size, starts), "text": pa.array(lines, pa.string()),
        })


def token_savings(results: DataFrame) -> DataFrame:
    """What the texts cost in tokens against images of their pages."""
    sums = results.filter("md is not null").agg(F.coalesce(F.sum(F.length("md").cast("long")), F.lit(0)).alias("chars"), F.coalesce(F.sum("n_pages"), F.lit(0)).cast("long").alias("pages"))
    out, image = F.expr("chars div 4"), F.col("pages") * 1600
    saved = F.greatest(F.lit(0).cast("long"), image - out)
    return sums.select("chars", "pages", out.alias("text_tokens"), image.alias("image_tokens"), saved.alias("saved"), F.when(image == 0, F.lit(0).cast("long")).otherwise(F.floor(saved * 100 / image)).alias("percent"))
