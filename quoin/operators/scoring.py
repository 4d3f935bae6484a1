"""Scores of conversions: tables, noise, text, speed, and the leaderboard."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, letters_only, py_table_norm
from ..sources.tables import py_pipe_tables

WEIGHTS = {"text": 0.35, "structure": 0.25, "order": 0.20, "tables": 0.15, "noise": 0.05}


def bigrams(s: Column) -> Column:
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Similarity of two normalised cells: the share of bigrams that they have in common."""
    x, y = bigrams(a), bigrams(b)
    count = lambda xs, v: F.size(F.filter(xs, lambda z: z == v))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v)))
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when((a == "") | (b == "") | (total == 0), 0.0).otherwise(2.0 * both / total)


def py_dice(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if a and b and total else 0.0


def row_similarity(a: list[str], b: list[str]) -> float:
    """Best alignment of two rows of cells, in order, cells left out at no cost."""
    if not len(a) and not len(b):
        return 1.0
    dp = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = max(dp[i][j + 1], dp[i + 1][j], dp[i][j] + py_dice(x, y))
    return 2 * dp[-1][-1] / (len(a) + len(b))


class Cells:
    """Normalised cells by number, with the bigrams of each as a set of bits: those that it has once, twice and so on."""

    def __init__(self):
        self.raw: dict[str | None, int] = {None: 0}
        self.texts, self.by_text = [""], {}

    def number(self, cell: str | None) -> int:
        """Equal cells have one number; a null one has 0 and is like none."""
        k = self.raw.get(cell)
        if k is None:
            text = py_table_norm(cell)
            k = self.by_text.get(text)
            if k is None:
                k = self.by_text[text] = len(self.texts)
                self.texts.append(text)
            self.raw[cell] = k
        return k

    def close(self) -> None:
        known: dict[tuple[str, int], int] = {}
        rows, bits = [], []
        for k, s in enumerate(self.texts):
            held: dict[str, int] = {}
            for i in range(len(s) - 1):
                g = s[i : i + 2]
                nth = held[g] = held.get(g, 0) + 1
                rows.append(k)
                bits.append(known.setdefault((g, nth), len(known)))
        has = np.zeros((len(self.texts), 64 * max(1, -(-len(known) // 64))), bool)
        has[rows, bits] = True
        self.bits, self.size = np.packbits(has, axis=1).view(np.uint64), np.maximum(np.array([len(s) for s in self.texts]) - 1, 0)

    def dice(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``py_dice`` of cells by number."""
        both = np.zeros(len(a), np.int64)
        for word in self.bits.T:
            both += np.bitwise_count(word[a] & word[b])
        found = np.where(a == b, 1.0, 2.0 * both / np.maximum(self.size[a] + self.size[b], 1))
        return np.where((a == 0) | (b == 0), 0.0, found)


def _row_similarities(cells: Cells, truth: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``row_similarity`` of pairs of rows: ``truth`` and ``found`` have the cells' numbers and where each row begins."""
    (x, x_at), (y, y_at) = truth, found
    m, n = np.diff(x_at)[a], np.diff(y_at)[b]
    out = np.zeros(len(a))
    shape = m * (n.max(initial=0) + 1) + n
    for kind in np.unique(shape):
        at = np.flatnonzero(shape == kind)
        rows, cols, i, j = int(m[at[0]]), int(n[at[0]]), x_at[a[at]], y_at[b[at]]
        if not rows or not cols:
            out[at] = float(rows == cols)
            continue
        above = [np.zeros(len(at))] * (cols + 1)
        for r in range(rows):
            done = [above[0]]
            for c in range(cols):
                done.append(np.maximum(np.maximum(above[c + 1], done[c]), above[c] + cells.dice(x[i + r], y[j + c])))
            above = done
        out[at] = 2 * above[-1] / (rows + cols)
    return out


def _score(grids: list[list[list[str]]], tables: list[list[list[list[str]]]]) -> np.ndarray:
    """The score of each grid against the tables beside it: the mean similarity at the best start of any table."""
    cells = Cells()
    sides = []
    for rows in ([r for g in grids for r in g], [r for ts in tables for t in ts for r in t]):
        sides.append((np.array([cells.number(c) for r in rows for c in r or ()], np.int64), np.cumsum([0, *(len(r or ()) for r in rows)])))
    cells.close()
    first = np.cumsum([0, *map(len, grids)])
    doc = np.array([d for d, ts in enumerate(tables) for _ in ts], np.int64)
    held = np.array([len(t) for ts in tables for t in ts], np.int64)
    begin, n = np.cumsum(np.r_[0, held]), np.diff(first)
    asked, at, slot = [], [], []
    pairs = held * (n.max(initial=0) + 1) + n[doc] if len(doc) else held
    for kind in np.unique(pairs):
        which = np.flatnonzero(pairs == kind)
        j, i = np.tril_indices(int(held[which[0]]), 0, int(n[doc[which[0]]]))
        asked.append((first[doc[which]][:, None] + i).ravel())
        at.append((begin[which][:, None] + j).ravel())
        slot.append((begin[which][:, None] + j - i).ravel())
    out = np.zeros(len(grids))
    if asked:
        asked, at, slot = (np.concatenate(v) for v in (asked, at, slot))
        sims = _row_similarities(cells, *sides, asked, at)
        by_start = np.bincount(slot, sims, minlength=int(begin[-1]))
        of = np.repeat(doc, held)
        np.maximum.at(out, of, by_start / np.maximum(n[of], 1))
    return out


def _scores(batches, most: int = 20_000):
    """Scores of rows of converter, id, md and grid, some thousands of cells at once."""
    for batch in batches:
        grids, texts = batch.column("grid").to_pylist(), batch.column("md").to_pylist()
        out, part, count = [], ([], []), 0
        for grid, text in zip(grids, texts):
            part[0].append([r or [] for r in grid or []])
            part[1].append(py_pipe_tables(text or ""))
            count += sum(map(len, part[0][-1])) + sum(len(r) for t in part[1][-1] for r in t)
            if count > most:
                out.append(_score(*part))
                part, count = ([], []), 0
        out.append(_score(*part))
        yield pa.RecordBatch.from_pydict({"converter": batch.column("converter"), "id": batch.column("id"), "score": np.concatenate(out)})


def table_scores(labels: DataFrame, results: DataFrame) -> DataFrame:
    """converter, id, score of grids (id, grid) against all tables of conversions (converter, id, md).

    A table's score is that of its best start: the mean over the grid's rows of their
    similarity with the table's row at that distance. Conversions without tables score 0.
    """
    asked = results.join(labels.select("id", "grid"), "id").select("converter", "id", "md", "grid")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    return asked.mapInArrow(_scores, f"converter {kinds['converter']}, id {kinds['id']}, score double")


def table_leaderboard(scores: DataFrame) -> DataFrame:
    """converter, tables, mean_score, rank; equal means by name."""
    from pyspark.sql import Window

    g = scores.groupBy("converter").agg(F.count("*").alias("tables"), F.avg("score").alias("mean_score"))
    # one row for each converter: few, whatever the number of tables
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("mean_score", 4).desc(), "converter")))


def composite(dims: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.coalesce(dims.get(name, F.lit(None).cast("double")), F.lit(0.0))
    return half_up(total, 2)


def clamped(x: Column) -> Column:
    """A judged figure as a whole number from 0 to 10; what is no number counts 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.greatest(half_up(x), F.lit(0.0)), F.lit(10.0)))


def matcher(letters: list[tuple[int, str]]):
    """Texts of letters to the passages that they hold: one pass over each, whatever the number of passages."""

    def run(batches):
        import ahocorasick

        by: dict[str, list[int]] = {}
        for item, passage in letters:
            by.setdefault(passage, []).append(item)
        tree = ahocorasick.Automaton()
        for passage, items in by.items():
            tree.add_word(passage, items)
        tree.make_automaton()
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("_letters").to_pylist()):
                items = {i for _, xs in tree.iter(text) for i in xs}
                docs += [doc] * len(items)
                found += sorted(items)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(found, pa.int64()), "doc_id": pa.array(docs, pa.int64())})

    return run


def survival(docs: DataFrame, passages: DataFrame, most: int = 16 << 20) -> DataFrame:
    """item_id, doc_id of passages whose letters a document's letters hold in order without a break.

    The passages go to all executors in slices of at most ``most`` letters (or of one longer passage), each slice over all documents.
    """
    a = docs.select(F.col("doc_id").cast("long"), letters_only(F.col("text")).alias("_letters")).filter("_letters <> ''")
    b = passages.select(F.col("item_id").cast("long"), letters_only(F.col("text")).alias("_passage")).filter("_passage <> ''")
    schema = "item_id long, doc_id long"
    out, part, held = None, [], 0

    def add() -> None:
        nonlocal out
        found = a.mapInArrow(matcher(part), schema)
        out = found if out is None else out.unionByName(found)

    for row in b.toLocalIterator():
        if part and held + len(row["_passage"]) > most:
            add()
            part, held = [], 0
        part.append((row["item_id"], row["_passage"]))
        held += len(row["_passage"])
    if part:
        add()
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def broken_words(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_words, n_broken: words of two or more letters that a dictionary (column word) lacks."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0)).alias("word"))
    listed = known.select("word").distinct().withColumn("_known", F.lit(1))
    return found.join(listed, "word", "left").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(F.col("_known").isNull()).alias("n_broken"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Speed by converter and document out of single runs (converter, doc, ms, pages, ok)."""
    ms = F.col("ms")
    g = runs.groupBy("converter", "doc").agg(
        F.bool_and("ok").alias("ok"), F.count("*").alias("iterations"), F.percentile(ms, 0.5).alias("median_ms"), F.min("ms").alias("min_ms"),
        F.expr("percentile_disc(0.95) within group (order by ms)").alias("p95_ms"), F.max("pages").alias("pages"),
    )
    return g.withColumn("pages_per_sec", F.when(F.col("median_ms") > 0, F.col("pages") / (F.col("median_ms") / 1000)))


def leaderboard(stats: DataFrame) -> DataFrame:
    """One row by converter, with its rank: quality first, then speed; means are rounded as they are shown, and ranked so.

    ``stats`` has what ``run_stats`` gives, composite, in_process and judged figures by dimension (columns named dim_...).
    """
    from pyspark.sql import Window

    ok = lambda c: F.when(F.col("ok"), F.col(c))
    shown = lambda x, digits: half_up(F.round(x, 9), digits)
    dims = [c for c in stats.columns if c.startswith("dim_")]
    g = stats.groupBy("converter").agg(
        F.count("*").alias("docs"), F.count_if(~F.col("ok")).alias("failures"), shown(F.avg(ok("median_ms")), 1).alias("mean_ms"),
        shown(F.avg(ok("pages_per_sec")), 1).alias("mean_pages_per_sec"), shown(F.max(ok("p95_ms")), 1).alias("max_p95_ms"), shown(F.avg("composite"), 2).alias("quality"),
        F.bool_or("in_process").alias("in_process"), *[shown(F.avg(F.when(F.col("composite").isNotNull(), F.col(c))), 1).alias(c) for c in dims],
    )
    # one row for each converter: few, whatever the number of documents
    w = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("quality", F.lit(-1.0)).desc(), F.col("mean_ms").asc_nulls_last(), "converter")
    return g.withColumn("rank", F.row_number().over(w))


def gates(board: DataFrame, real_board: DataFrame, target: str) -> DataFrame:
    """name, pass, indicative: what the target must reach; ``real_board`` is of documents of many pages.

    Without a row of the target there is one gate, "graded", and it fails. Quality counts only if the target is judged, pages a second
    only if it has real rows. It must be as fast as all others that are no in-process converters. Speed is only indicative of an in-process target.
    """
    mine, real = F.col("converter") == target, F.col("real")
    both = board.withColumn("real", F.lit(False)).unionByName(real_board.withColumn("real", F.lit(True)))
    t = lambda c: F.max(F.when(mine & ~real, F.col(c))).alias(c)
    found = both.agg(
        F.count_if(mine & ~real).alias("there"), t("quality"), t("rank"), t("mean_ms"), t("in_process"),
        F.max(F.when(mine & real, F.col("mean_pages_per_sec"))).alias("pages"), F.min(F.when(~mine & ~real & ~F.col("in_process"), F.col("mean_ms"))).alias("others"),
    )
    there = F.col("there") > 0
    gate = lambda name, when, passed, soft: F.when(when, F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("pass"), F.coalesce(soft, F.lit(False)).alias("indicative")))
    no, soft = F.lit(False), F.col("in_process")
    every = F.array(
        gate("graded", ~there, no, no), gate("first on quality", there & F.col("quality").isNotNull(), F.col("rank") == 1, no), gate("median below 25 ms", there, F.col("mean_ms") < 25, soft),
        gate("300 pages a second", there & F.col("pages").isNotNull(), F.col("pages") >= 300, soft), gate("fastest of the spawned", there, F.col("others").isNull() | (F.col("mean_ms") <= F.col("others")), soft),
    )
    return found.select(F.inline(F.array_compact(every)))


def rendered_board(board: DataFrame, dims: dict[str, str]) -> DataFrame:
    """line_no, line of the leaderboard as a Markdown table; ``dims`` has the columns of the judged figures by their headings."""
    def cell(c: str):
        return F.coalesce(F.regexp_replace(F.col(c).cast("decimal(20,2)").cast("string"), r"\.?0+$", ""), F.lit("—"))

    head = ["#", "Converter", "Quality /10", *dims, "med ms", "pages/s", "fails"]
    name = F.concat("converter", F.when(F.col("in_process"), F.lit(" *")).otherwise(F.lit("")))
    cells = [F.col("rank").cast("string"), name, F.concat(F.lit("**"), cell("quality"), F.lit("**")), *map(cell, dims.values()), cell("mean_ms"), cell("mean_pages_per_sec"), F.col("failures").cast("string")]
    rows = board.select((F.col("rank") + 1).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    tops = [(0, "| " + " | ".join(head) + " |"), (1, "| " + " | ".join(["---"] * len(head)) + " |")]
    return board.sparkSession.createDataFrame(tops, "line_no int, line string").unionByName(rows)


def ranking_line(board: DataFrame) -> DataFrame:
    """line: the judged converters with their quality, best first."""
    shown = F.regexp_replace(F.col("quality").cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
    judged = board.filter("quality is not null").select("rank", F.concat("converter", F.lit(" "), shown).alias("v"))
    return judged.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda t: t["v"]), " > ").alias("line"))


def extracted_json(reply: Column) -> Column:
    """The JSON text of a judge's reply: from its first to its last brace, within a fenced block if there is one; null if there is none."""
    fenced = r"(?is)```(?:json)?\s*(.*?)```"
    body = F.when(reply.rlike(fenced), F.regexp_extract(reply, fenced, 1)).otherwise(reply)
    start, end = F.locate("{", body), F.length(body) - F.locate("}", F.reverse(body)) + 1
    return F.when((start > 0) & (F.locate("}", body) > 0) & (end >= start), body.substr(start, end - start + 1))


def judged(replies: DataFrame, dims: list[str]) -> DataFrame:
    """The input's columns (of which reply) with json and each dimension, clamped; what is no number counts 0, a reply without JSON is null."""
    found = replies.withColumn("json", extracted_json(F.col("reply")))
    value = lambda d: F.expr(f"try_cast(get_json_object(json, '$.{d}') as double)")
    return found.withColumns({d: F.when(F.col("json").isNotNull(), clamped(value(d))) for d in dims})


def completeness(source: Column, candidate: Column) -> Column:
    """What share of the source's characters a conversion has, in whole percent; 0 for an empty source."""
    return F.when(F.coalesce(source, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(half_up(candidate / source * 100).cast("long"))


def cached(asked: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """asked (reference, candidate) with its key and the cached result, null where it must be judged."""
    key = F.sha2(F.concat_ws(" ", F.lit(version), F.lit(model), "reference", "candidate"), 256)
    return asked.withColumn("key", key).join(cache.select("key", "result"), "key", "left")
