"""Glyphs to words: an ordered fold over the glyphs of a page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLYPH = ("ch", "raw_size", "l", "r", "b", "t", "ma", "mb", "rot")
WORDS = "doc_id string, page_no int, tok_no int, s string, x double, y double, w double, size double"


def upright(rot: int, left: float, right: float, bottom: float, top: float) -> tuple[float, float, float, float]:
    """(left, right, y, height) of a box as it lies on the page turned upright."""
    if rot == 90:
        return bottom, top, -left, right - left
    if rot == 180:
        return -right, -left, -top, top - bottom
    if rot == 270:
        return -top, -bottom, left, right - left
    return left, right, bottom, top - bottom


def fold(glyphs: list[dict]) -> list[tuple[str, float, float, float, float]]:
    """(s, x, y, w, size) of the words, in the order of the glyphs."""
    out: list = []
    cur: list | None = None

    def flush() -> None:
        nonlocal cur
        if cur is not None:
            s, x, y, right, size = cur
            out.append((s, x, y, right - x, size))
        cur = None

    for g in glyphs:
        ch, rot, raw = g["ch"], g["rot"] or 0, g["raw_size"] or 0.0
        blank = ch is None or ch.isspace() or ord(ch[0]) < 32 or 127 <= ord(ch[0]) < 160
        if rot == 0 and raw < 2:
            # tiny spaces still end words; other tiny glyphs are hidden text
            if ch is not None and ch.isspace():
                flush()
            continue
        if blank or any(g[k] is None for k in ("l", "r", "b", "t")):
            flush()
            continue
        left, right, y, height = upright(rot, g["l"], g["r"], g["b"], g["t"])
        size = raw if raw >= 2 else height
        if size < 2:
            continue
        if rot == 0 and height > 1.25 * size and g["ma"] is not None and g["mb"] is not None and abs(g["mb"]) > 0.2 * abs(g["ma"]):
            continue
        if cur is not None and (left - cur[3] > 0.3 * cur[4] or abs(y - cur[2]) > 0.6 * cur[4]):
            flush()
        if cur is None:
            cur = [ch, left, y, right, size]
        else:
            cur = [cur[0] + ch, cur[1], cur[2], right, max(cur[4], size)]
    flush()
    return out


def words_of(glyphs: DataFrame) -> DataFrame:
    """The words of a table of glyphs, page by page; one task folds many pages, one after the other."""

    def run(batches):
        for batch in batches:
            held = batch.column("gs")
            ends = np.cumsum(np.r_[0, held.value_lengths().to_numpy(zero_copy_only=False)]).tolist()
            items = held.flatten()
            every = [dict(zip(GLYPH, v)) for v in zip(*(items.field(k).to_pylist() for k in GLYPH))]
            rows, toks, words = [], [], []
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                found = fold(every[a:b])
                rows += [k] * len(found)
                toks += range(len(found))
                words += found
            at, cols = pa.array(rows, pa.int64()), list(zip(*words)) if words else [()] * 5
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(at), "page_no": batch.column("page_no").take(at), "tok_no": pa.array(toks, pa.int32()), "s": pa.array(cols[0], pa.string()), **{k: pa.array(c, pa.float64()) for k, c in zip(("x", "y", "w", "size"), cols[1:])}})

    pages = glyphs.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_no").cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("glyph_no", *GLYPH))).alias("gs"))
    return pages.mapInArrow(run, WORDS)
