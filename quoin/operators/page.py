"""Layout of one document's words to Markdown: the steps that are sequential by nature.

Plain functions on tuples, run by one group-map per document. Coordinates grow
upwards; ties of sizes are broken by what comes first, ties of position by order.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import ceil, floor

import numpy as np

from ..functions.text import py_cell_norm, py_clean, py_heading_like, py_is_bullet, py_is_page_number, py_ordered, py_strip_bullet


@dataclass(slots=True)
class Word:
    s: str
    x: float
    y: float
    w: float
    size: float

    @property
    def right(self) -> float:
        return self.x + self.w


class Line:
    """A line of words in order; ``words`` may be a function that makes them when they are asked for."""

    __slots__ = ("_words", "cells", "cell_x", "text", "x", "y", "size")

    def __init__(self, words, cells: list[str], cell_x: list[float], text: str, x: float, y: float, size: float):
        self._words, self.cells, self.cell_x, self.text, self.x, self.y, self.size = words, cells, cell_x, text, x, y, size

    @property
    def words(self) -> list[Word]:
        if not isinstance(self._words, list):
            self._words = self._words()
        return self._words


def half_points(size: float) -> int:
    return floor(2 * size + 0.5)


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2] if values else 0.0


def raw_lines(words: list[Word]) -> list[list[Word]]:
    """Words by baseline: a line holds all within half a size of its first word."""
    out: list[list[Word]] = []
    for t in sorted(words, key=lambda t: (-t.y, t.x)):
        if out and abs(t.y - out[-1][0].y) <= max(0.5 * t.size, 3):
            out[-1].append(t)
        else:
            out.append([t])
    return out


def cells_of(words: list[Word]) -> tuple[str, list[str], list[float]]:
    cells, xs, last = [], [], None
    for t in words:
        size = (last.size if last.size > 0 else max(t.size, 11)) if last else 0
        if last is None or t.x - last.right > 1.4 * size:
            cells.append([t.s])
            xs.append(t.x)
        else:
            cells[-1].append(t.s)
        last = t
    joined = [" ".join(c).strip() for c in cells]
    return text_of(joined), joined, xs


def text_of(cells: list[str]) -> str:
    text = "\t".join(cells)
    if "\t" in text or "  " in text:
        text = re.sub(" +", " ", re.sub("[ \t]*\t[ \t]*", "\t", text))
    return text.strip()


def make_line(words: list[Word]) -> Line:
    words = sorted(words, key=lambda t: t.x)
    text, cells, xs = cells_of(words)
    return Line(words, cells, xs, text, words[0].x, max(t.y for t in words), max(t.size for t in words))


def gutter(raw: list[list[Word]], low: float, high: float) -> float | None:
    """The x between two columns of text, if most lines leave it free."""
    width, mids, multi, wide_lines = high - low, [], 0, 0
    least = max(14, 0.03 * width)
    for line in raw:
        ws = sorted(line, key=lambda t: t.x)
        if len(ws) < 2:
            continue
        multi += 1
        best, at, wide = 0.0, None, 0
        for a, b in zip(ws, ws[1:]):
            gap, mid = b.x - a.right, (a.right + b.x) / 2
            wide += gap > 1.4 * max(a.size, 11)
            if low + 0.3 * width < mid < low + 0.7 * width and gap > best:
                best, at = gap, mid
        if at is not None and best >= least - 6:
            mids.append(at)
            wide_lines += wide >= 2
    if len(mids) < 6 or len(mids) < 0.4 * multi or wide_lines / len(mids) >= 0.75:
        return None
    middle = upper_median(mids)
    near = [m for m in mids if abs(m - middle) <= 0.06 * width]
    if len(near) < 6 or len(near) < 0.4 * multi:
        return None
    return sum(near) / len(near)


def columnize(raw: list[list[Word]], g: float, least: float) -> list[list[Line]]:
    """Reading order of a page of two columns: groups of lines."""
    groups: list[list[Line]] = []
    full: list[Line] = []
    sides: tuple[list[Line], list[Line]] = ([], [])

    def flush_full() -> None:
        if full:
            groups.append(full[:])
            full.clear()

    def flush_sides() -> None:
        for side in sides:
            if side:
                groups.append(side[:])
                side.clear()

    for line in raw:
        left = [t for t in line if t.x < g and t.right <= g + 8]
        right = [t for t in line if t.x >= g - 8 and t.right > g]
        cross = any(t.x < g - 8 and t.right > g + 8 for t in line)
        if left and right and not cross and min(t.x for t in right) - max(t.right for t in left) >= least - 16:
            flush_full()
            sides[0].append(make_line(left))
            sides[1].append(make_line(right))
        elif cross or (left and right) or not (left or right):
            flush_sides()
            full.append(make_line(line))
        else:
            flush_full()
            sides[0 if left else 1].append(make_line(line))
    flush_full()
    flush_sides()
    return groups


def edges(n: int) -> list[int]:
    """The numbers of the two first and the two last of n lines."""
    return list(range(n)) if n <= 4 else [0, 1, n - 2, n - 1]


def furniture(pages: list[list[str]]) -> tuple[set[str], set[str]]:
    """Texts of the pages' head and foot lines that are repeated as they are, or with their digits masked."""
    exact, masked = Counter(), Counter()
    for texts in pages:
        for text in texts:
            if text:
                exact[text] += 1
                masked[re.sub("[0-9]+", "#", text)] += 1
    return {t for t, n in exact.items() if n >= 2}, {t for t, n in masked.items() if n >= 3 and sum(c.isalpha() for c in t) >= 4}


def is_noise(line: Line, found: tuple[set[str], set[str]]) -> bool:
    return py_is_page_number(line.text) or line.text in found[0] or (bool(found[1]) and re.sub("[0-9]+", "#", line.text) in found[1])


def body_size(lines: list[Line]) -> float:
    counts, first = Counter(), {}
    for line in lines:
        q = half_points(line.size)
        counts[q] += 1
        first.setdefault(q, line.size)
    return first[max(counts, key=lambda q: counts[q])] if counts else 11.0


def heading_levels(lines: list[Line], body: float) -> dict[int, int]:
    sizes = sorted({half_points(x.size) for x in lines if half_points(x.size) >= half_points(body) + 2}, reverse=True)
    return {q: min(k + 1, 3) for k, q in enumerate(sizes)}


# --- tables ------------------------------------------------------------------------------------


def clusters(points: list[tuple[int, float]], tol: float, moving: bool = True) -> list[tuple[float, set[int]]]:
    """Greedy clusters of (row, x): the first within ``tol`` of its centre takes a point."""
    out: list[list] = []
    for row, x in points:
        for c in out:
            if abs(c[0] - x) <= tol:
                if moving:
                    c[0] = (c[0] * c[1] + x) / (c[1] + 1)
                c[1] += 1
                c[2].add(row)
                break
        else:
            out.append([x, 1, {row}])
    return [(c[0], c[2]) for c in out]


def is_aligned(rows: list[Line]) -> bool:
    found = clusters([(i, x) for i, r in enumerate(rows) for x in r.cell_x], 10)
    return sum(len(c) >= 0.6 * len(rows) for _, c in found) >= 2


def has_substance(rows: list[Line]) -> bool:
    filled = [c for r in rows for c in r.cells if c]
    return bool(filled) and sum(len(c) >= 3 for c in filled) >= 0.3 * len(filled)


def is_label_layout(rows: list[Line]) -> bool:
    two = [r for r in rows if len(r.cells) == 2]
    if not two or len(two) < 0.8 * len(rows):
        return False
    label = lambda s: py_ordered(s + " x") is not None or (s.startswith("(") and s.endswith(")") and len(s.encode()) <= 5) or s.endswith(":")
    return sum(label(r.cells[0].strip()) for r in two) >= 0.8 * len(two)


def segments(rows: list[Line]) -> list[list[Line]]:
    """Rows cut where their cells stop lining up with the three before; short pieces join the next."""
    pieces: list[list[Line]] = []
    recent: list[list[float]] = []
    for r in rows:
        if len(r.cells) >= 2:
            known = [x for xs in recent[-3:] for x in xs]
            share = sum(any(abs(x - k) <= 10 for k in known) for x in r.cell_x) / len(r.cell_x)
            if pieces and known and share < 0.6:
                pieces.append([])
                recent = []
        if not pieces:
            pieces.append([])
        pieces[-1].append(r)
        recent.append(r.cell_x)
    out: list[list[Line]] = []
    held: list[Line] = []
    for p in pieces:
        held += p
        if len(p) >= 5:
            out.append(held)
            held = []
    if held:
        if out:
            out[-1] += held
        else:
            out.append(held)
    return out


def columns_of(rows: list[Line]) -> list[tuple[float, float]]:
    """(start, gutter before it) of the columns: runs of bins that few rows cover lie between them."""
    words = [t for r in rows for t in r.words]
    if not words:
        return []
    low, high = min(t.x for t in words), max(t.right for t in words)
    width = high - low
    if width <= 0:
        return [(low, 0.0)]
    step = max(width / 240, 1.5)
    n = ceil(width / step) + 1
    cover = [0] * n
    for r in rows:
        next_ = 0  # words are in order, so what is before is counted
        for t in r.words:
            end = min(n - 1, int((t.x + t.w - low) / step)) + 1
            for k in range(max(next_, int((t.x - low) / step)), end):
                cover[k] += 1
            next_ = max(next_, end)
    limit, least = int(0.3 * len(rows)), max(2, floor(3 / step + 0.5))
    out, run, started = [], 0, False
    for k, c in enumerate(cover):
        if c <= limit:
            run += 1
            continue
        if not started or run >= least:
            out.append((low + k * step, run * step if started else 0.0))
        started, run = True, 0
    return out


def block_cuts(rows: list[Line], cols: list[tuple[float, float]]) -> list[float]:
    gaps = [g for _, g in cols[1:] if g > 0]
    if len(gaps) < 3:
        return []
    least = max(2.5 * upper_median(gaps), 18)
    filled = [r for r in rows if r.cell_x]
    out = []
    for x, g in cols[1:]:
        if g >= least:
            both = sum(sum(c < x for c in r.cell_x) >= 2 and sum(c >= x for c in r.cell_x) >= 2 for r in filled)
            if filled and both >= 0.5 * len(filled):
                out.append(x)
    return out


def repeat_period(matrix: list[list[str]], n: int) -> int | None:
    """The number of columns after which a wide table repeats its headings."""
    top = [[py_cell_norm(c) for c in r] for r in matrix[:4]]
    for p in range(3, n // 2 + 1):
        if n % p:
            continue
        for row in top:
            if sum(bool(c) for c in row) < 1.5 * p:
                continue
            pairs = [(row[i], row[i + b * p]) for b in range(1, n // p) for i in range(p)]
            pairs = [(a, b) for a, b in pairs if a or b]
            if len(pairs) >= p and sum(a == b for a, b in pairs) >= 0.8 * len(pairs):
                return p
    return None


def pipe_rows(matrix: list[list[str]]) -> str:
    out = []
    for k, row in enumerate(matrix):
        out.append("| " + " | ".join(row) + " |")
        if k == 0:
            out.append("| " + " | ".join(["---"] * len(row)) + " |")
    return "\n".join(out)


def table_text(rows: list[Line], depth: int = 0) -> str:
    """The Markdown of a table region; tables side by side come one after the other."""
    cols = columns_of(rows)
    if depth < 2:
        cuts = block_cuts(rows, cols)
        if cuts:
            edges = [float("-inf"), *cuts, float("inf")]
            out: list[str] = []
            for a, b in zip(edges, edges[1:]):
                part = [[t for t in r.words if a <= t.x < b] for r in rows]
                part = [make_line(p) for p in part if p]
                if len(part) >= 2 and any(len(p.cells) >= 2 for p in part):
                    out.append(table_text(part, depth + 1))
                elif part:
                    out.append("\n\n".join(py_clean(p.text) for p in part))
            if len(out) > 1:
                return "\n\n".join(out)
    starts = [x for x, _ in cols]
    if len(starts) < 2:
        found = clusters([(i, x) for i, r in enumerate(rows) for x in r.cell_x], 12)
        strong = [c for c in found if len(c[1]) >= max(0.25 * len(rows), 2)]
        starts = [c[0] for c in (strong if len(strong) >= 2 else found)]
    kept: list[float] = []
    for x in sorted(starts):
        if not kept or x - kept[-1] > 12:
            kept.append(x)
    starts = kept
    n = max(1, len(starts))

    def column(x: float) -> int:
        return max((k for k, c in enumerate(starts) if x >= c - 12), default=0)

    gaps = [a.y - b.y for a, b in zip(rows, rows[1:]) if a.y - b.y > 0]
    middle = upper_median(gaps)
    logical: list[list[Word]] = []
    for k, r in enumerate(rows):
        goes_on = k > 0 and middle > 0 and rows[k - 1].y - r.y < 0.7 * middle and all(column(t.x) != 0 for t in r.words)
        if goes_on:
            logical[-1] += r.words
        else:
            logical.append(list(r.words))
    matrix = []
    for words in logical:
        cells: list[list[str]] = [[] for _ in range(n)]
        base: list[list[Word]] = []
        for t in sorted(words, key=lambda t: -t.y):
            if base and abs(t.y - base[-1][0].y) <= max(0.6 * t.size, 3):
                base[-1].append(t)
            else:
                base.append([t])
        for line in base:
            at, last = 0, None
            for t in sorted(line, key=lambda t: t.x):
                # a word close to the one before stays in its cell, whatever column it reaches
                if last is None or t.x - last.right >= 0.5 * max(last.size, t.size):
                    at = column(t.x)
                cells[at].append(t.s)
                last = t
        matrix.append([py_clean(" ".join(c)) for c in cells])
    period = repeat_period(matrix, n)
    if period:
        out = []
        for a in range(0, n, period):
            part = [r[a : a + period] for r in matrix if any(r[a : a + period])]
            if part:
                out.append(pipe_rows(part))
        return "\n\n".join(out)
    return pipe_rows(matrix)


# --- blocks ------------------------------------------------------------------------------------


def join_lines(texts: list[str]) -> str:
    out = ""
    for t in texts:
        if not out:
            out = t
        elif out.endswith("-"):
            soft = len(out) > 1 and out[-2].isalpha() and t[:1].islower()
            out = (out[:-1] if soft else out) + t
        else:
            out += " " + t
    return out


def classify(groups: list[list[Line]], body: float, levels: dict[int, int]) -> list[tuple[float, str]]:
    """(greatest y of the group, block) in reading order: tables, headings, lists, paragraphs."""
    out: list[tuple[float, str]] = []
    for group in groups:
        if not group:
            continue
        top = max(x.y for x in group)
        gaps = [a.y - b.y for a, b in zip(group, group[1:]) if a.y - b.y > 0]
        middle = upper_median(gaps)
        limit = 1.5 * middle if len(group) >= 5 and middle > 0 else 1.6 * body
        para: list[str] = []
        last_y: float | None = None

        def flush() -> None:
            nonlocal last_y
            text = py_clean(join_lines(para))
            if text:
                out.append((top, text))
            para.clear()
            last_y = None

        k, tried = 0, -1
        while k < len(group):
            line = group[k]
            if len(line.cells) >= 2 and tried != k:
                end, last = k, line.y + 1
                while end < len(group):
                    nxt = group[end]
                    gap = last - nxt.y
                    if len(nxt.cells) >= 2 or (end > k and 0 <= gap < 2.2 * nxt.size and nxt.x > line.x + 8):
                        last = nxt.y
                        end += 1
                    else:
                        break
                region = group[k:end]
                kinds = []
                for seg in segments(region) if len(region) >= 2 else []:
                    worthy = len(seg) >= 2 and is_aligned(seg) and has_substance(seg)
                    kinds.append((0 if not worthy else 1 if is_label_layout(seg) else 2, seg))
                if any(kind for kind, _ in kinds):
                    flush()
                    for kind, seg in kinds:
                        found = [table_text(seg)] if kind == 2 else [py_clean(r.text) for r in seg]
                        out += [(top, b) for b in found]
                    k = end
                    continue
                tried = k  # no table here: the line is read again as text
            q = half_points(line.size)
            if q in levels and q >= half_points(body) + 2 and len(line.text.split()) <= 12 and py_heading_like(line.text) and 10 * sum(half_points(t.size) == q for t in line.words) >= 7 * len(line.words):
                flush()
                out.append((top, "#" * levels[q] + " " + py_clean(line.text)))
                k += 1
                continue
            if py_is_bullet(line.text) or py_ordered(line.text):
                flush()
                end = k
                while end < len(group) and (py_is_bullet(group[end].text) or py_ordered(group[end].text)):
                    end += 1
                left = min(x.x for x in group[k:end])
                items = []
                for x in group[k:end]:
                    indent = "  " * max(0, floor((x.x - left) / 14 + 0.5))
                    number = py_ordered(x.text)
                    items.append(f"{indent}{number[0]}. {py_clean(x.text[number[1]:])}" if number else f"{indent}- {py_clean(py_strip_bullet(x.text))}")
                out.append((top, "\n".join(items)))
                k = end
                continue
            if last_y is not None and last_y - line.y > limit:
                flush()
            para.append(line.text.replace("\t", " "))
            last_y = line.y
            k += 1
        flush()
    return out


def cut_references(blocks: list[str]) -> list[str]:
    for i, b in enumerate(blocks):
        if i > 0.5 * len(blocks) and b.lstrip("#").strip().lower() in ("references", "bibliography"):
            return blocks[:i]
    return blocks


def grouped_lines(words: list[Word], raw: list[list[Word]]) -> list[list[Line]]:
    """The lines of a page in reading order, by column where it has two."""
    if not raw:
        return []
    low, high = min(t.x for t in words), max(t.right for t in words)
    g = gutter(raw, low, high)
    return [[make_line(x) for x in raw]] if g is None else columnize(raw, g, max(14, 0.03 * (high - low)))


def assemble(edge_texts: list[list[str]], pages: list[list[list[Line]]], lattices: list[list[tuple[float, str]]] | None = None) -> str:
    """The Markdown of a document out of its pages' edge lines and groups of lines; ruled tables, (top, Markdown) by page, are put in by their height."""
    found = furniture(edge_texts)
    grouped = [[[x for x in group if not is_noise(x, found)] for group in groups] for groups in pages]
    every = [x for page in grouped for group in page for x in group]
    body = body_size(every)
    levels = heading_levels(every, body)
    blocks: list[str] = []
    for k, page in enumerate(grouped):
        ruled = sorted((lattices or [[]] * len(pages))[k], key=lambda t: -t[0])
        for group in page:
            if not group:
                continue
            top = max(x.y for x in group)
            while ruled and ruled[0][0] >= top:
                blocks.append(ruled.pop(0)[1])
            blocks += [b for _, b in classify([group], body, levels)]
        blocks += [md for _, md in ruled]
    return "\n\n".join(cut_references(blocks)).strip() + "\n"


def convert(pages: list[list[Word]], lattices: list[list[tuple[float, str]]] | None = None) -> str:
    """The Markdown of a document's pages of words."""
    raw = [raw_lines(p) for p in pages]
    return assemble([[make_line(lines[k]).text for k in edges(len(lines))] for lines in raw], [grouped_lines(p, r) for p, r in zip(pages, raw)], lattices)


# --- many pages at once ------------------------------------------------------------------------


def in_order(page: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """The order of words by page, from the top and from the left, ties as they come; null if it is theirs."""
    same = page[1:] == page[:-1]
    if ((page[1:] > page[:-1]) | (same & ((y[1:] < y[:-1]) | ((y[1:] == y[:-1]) & (x[1:] >= x[:-1]))))).all():
        return None
    return np.lexsort((x, -y, page))


def line_starts(page: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the lines of ordered words begin: the fold of ``raw_lines``, over runs of words of equal height and size."""
    n = len(page)
    if not n:
        return np.zeros(0, np.int64)
    runs = np.flatnonzero(np.r_[True, (page[1:] != page[:-1]) | (y[1:] != y[:-1]) | (size[1:] != size[:-1])])
    out, last, anchor = [], None, 0.0
    for at, p, h, tol in zip(runs.tolist(), page[runs].tolist(), y[runs].tolist(), np.maximum(0.5 * size[runs], 3).tolist()):
        if p != last or not abs(h - anchor) <= tol:
            out.append(at)
            last, anchor = p, h
    return np.array(out, np.int64)


def documents(n: int, doc: np.ndarray, page_no: np.ndarray, s: list[str], x: np.ndarray, y: np.ndarray, w: np.ndarray, size: np.ndarray, n_pages: list[int]) -> list[str]:
    """The Markdown of n documents, as ``convert`` gives it, out of all their words: the number of the document, the page, and the place.

    What holds for each word is reckoned for all words at once; only pages that may have two columns are looked at word by word.
    """
    first = np.cumsum([0, *n_pages])
    page = first[doc] + page_no
    order = in_order(page, y, x)
    if order is not None:
        page, x, y, w, size = page[order], x[order], y[order], w[order], size[order]
        s = [s[i] for i in order.tolist()]
    starts = line_starts(page, y, size)
    total = len(page)
    ends = np.r_[starts[1:], total] if total else starts
    line = np.repeat(np.arange(len(starts)), ends - starts)
    raw = None
    back = (line[1:] == line[:-1]) & (x[1:] < x[:-1])
    if back.any():  # words of other heights in a line
        raw = np.lexsort((x, line))
        x, y, w, size = x[raw], y[raw], w[raw], size[raw]
        s = [s[i] for i in raw.tolist()]
    right = x + w
    gap, inner = x[1:] - right[:-1], line[1:] == line[:-1]
    wide = inner & (gap > 1.4 * np.where(size[:-1] > 0, size[:-1], np.maximum(size[1:], 11)))
    # pages of which six lines have a gap in the middle that may be a gutter
    slow = set()
    if total:
        at = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        low, high = np.minimum.reduceat(x, at), np.maximum.reduceat(right, at)
        nth = np.cumsum(np.r_[0, page[1:] != page[:-1]])
        width = (high - low)[nth][1:]
        mid = (right[:-1] + x[1:]) / 2
        free = inner & (mid > low[nth][1:] + 0.3 * width) & (mid < low[nth][1:] + 0.7 * width) & (gap >= np.maximum(14, 0.03 * width) - 6)
        counts = np.bincount(page[starts[np.unique(line[1:][free])]])
        slow = set(np.flatnonzero(counts >= 6).tolist())
    tops, most = (np.maximum.reduceat(a, starts).tolist() if total else [] for a in (y, size))
    cuts = (np.flatnonzero(wide) + 1).tolist()
    at_cuts = x[cuts].tolist()
    by_page: list[list[Line]] = [[] for _ in range(int(first[-1]))]
    c, k = 0, 0
    for a, b, p, left in zip(starts.tolist(), ends.tolist(), page[starts].tolist(), x[starts].tolist()):
        here, cell_x = [a], [left]
        while c < len(cuts) and cuts[c] < b:
            here.append(cuts[c])
            cell_x.append(at_cuts[c])
            c += 1
        cells = [" ".join(s[i:j]).strip() for i, j in zip(here, [*here[1:], b])]
        make = lambda a=a, b=b: [Word(*t) for t in zip(s[a:b], *(v[a:b].tolist() for v in (x, y, w, size)))]
        by_page[p].append(Line(make, cells, cell_x, text_of(cells), left, tops[k], most[k]))
        k += 1
    out = []
    for i in range(n):
        own = by_page[first[i] : first[i + 1]]
        texts = [[lines[k].text for k in edges(len(lines))] for lines in own]
        groups = []
        for p, lines in enumerate(own, int(first[i])):
            if p in slow:
                words = [t for x in lines for t in x.words]
                groups.append(grouped_lines(words, [x.words for x in lines]))
            else:
                groups.append([lines] if lines else [])
        out.append(assemble(texts, groups))
    return out
