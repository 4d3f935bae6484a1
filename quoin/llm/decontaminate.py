"""Benchmark decontamination by a positional inverted index.

The training documents are cut into blocks. For each block one row of an index
table holds the sorted positions of every term that occurs in the test items
(delta-coded, compressed); other terms cannot take part in a match. Document
frequencies over all blocks order the terms of an item by rarity. A block then
answers all items alone, without a shuffle: lists are shifted by the term's
offset in the item and intersected from the rarest term on.

Semantics
  * A token is a run of letters and digits, lower-cased (``tokens``).
  * Phrase match: a document holds ``phrase`` successive tokens of an item, or
    the whole item if that is shorter. ``phrase_tokens`` is the length of the
    longest common run, 0 if there is none.
  * Proximity match: the ``anchors`` rarest distinct terms of an item (least
    document frequency, then the term; each at its first offset) all lie in one
    document, each at most ``slack`` tokens from the place that the item's
    layout gives it relative to the rarest. ``proximity_hits`` counts the
    positions of the rarest for which that holds. Only terms that some document
    has can be anchors; items of fewer such terms than ``anchors`` have no
    proximity match.
  * One row per (doc_id, item_id) with a match of either kind; of several rows of
    a document the largest figures count. Documents and items without an id,
    text or tokens have no rows; extra columns aren't looked at; repeated items
    of an id count as one if they are equal, else as several items.

The terms and items of the test set are broadcast. ``term_limit`` bounds that: a
larger test set is answered in slices of that many terms and ``ITEM_TOKENS`` times
as many tokens (or of one longer item), each over all documents. A block tries
only the items of which it has all terms of a window or all anchors. Positions
have 64 bits, so that items and blocks may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import written

PHRASE, ANCHORS, SLACK = 8, 4, 16
BLOCK_TOKENS, TERM_LIMIT, ITEM_TOKENS = 1_000_000, 500_000, 4
INDEX = "gap long, block_docs binary, starts binary, terms array<int>, doc_freq array<int>, postings array<binary>"
FOUND = "doc_id long, item_id long, phrase_tokens int, proximity_hits int"


def pack(x: np.ndarray) -> bytes:
    """Ascending int64 as deltas, their bytes transposed, compressed."""
    delta = np.diff(x, prepend=np.int64(0)).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel(), dtype=np.int64)


class Postings(dict):
    """The position lists of a block, unpacked when asked for."""

    def __init__(self, terms: list[int], packed: list[bytes]):
        super().__init__()
        self.packed = dict(zip(terms, packed))

    def get(self, term: int, default=None):
        if term not in self:
            if term not in self.packed:
                return default
            self[term] = unpack(self.packed[term])
        return self[term]


def indexer(shared, gap: int, block_tokens: int):
    """Documents to index rows. Positions are those in a block, whose documents lie ``gap`` apart."""

    def run(batches):
        known = shared.value["known"]
        for batch in tokens.bounded(batches):
            ids, offsets, _ = tokens.encode(batch.column("text"), known)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in tokens.slices(offsets, block_tokens):
                part, off = ids[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                per = np.diff(off)
                owner = np.repeat(np.arange(b - a, dtype=np.int64), per)
                at = np.flatnonzero(part >= 0)
                term = part[at]
                place = at + owner[at] * gap
                order = np.argsort(term.astype(np.uint16) if len(known) < 65536 else term, kind="stable")
                term, place, who = term[order], place[order], owner[at][order]
                cuts = np.flatnonzero(np.diff(term, prepend=-1))
                ends = np.append(cuts[1:], len(term))
                fresh = np.ones(len(term), bool)
                fresh[1:] = (term[1:] != term[:-1]) | (who[1:] != who[:-1])
                freq = np.add.reduceat(fresh, cuts, dtype=np.int32) if len(cuts) else []
                yield pa.RecordBatch.from_pydict(
                    {
                        "gap": pa.array([gap], pa.int64()),
                        "block_docs": [docs[a:b].tobytes()],
                        "starts": [(off[:-1] + np.arange(b - a) * gap).astype(np.int64).tobytes()],
                        "terms": pa.array([term[cuts].tolist()], pa.list_(pa.int32())),
                        "doc_freq": pa.array([list(map(int, freq))], pa.list_(pa.int32())),
                        "postings": pa.array([[pack(place[i:j]) for i, j in zip(cuts, ends)]], pa.list_(pa.binary())),
                    }
                )

    return run


def among(wanted: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in the sorted list."""
    if not len(sorted_list):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_list, wanted)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == wanted


def phrase_runs(item: np.ndarray, rank: np.ndarray, lists: dict[int, np.ndarray], phrase: int):
    """(start in the block, length) of each common run of at least ``phrase`` tokens."""
    n = min(phrase, len(item))
    none = np.zeros(0, np.int64)
    held: dict[int, list[np.ndarray]] = {}
    seeds: dict[int, list[int]] = {}
    for w in range(len(item) - n + 1):
        seeds.setdefault(w + int(np.argmin(rank[item[w : w + n]])), []).append(w)
    for o, windows in seeds.items():
        diagonal = lists.get(int(item[o]), none) - o
        if not len(diagonal):
            continue
        for w in windows:
            left = diagonal
            for p in sorted(range(w, w + n), key=lambda p: rank[item[p]]):
                if p != o:
                    left = left[among(left + p, lists.get(int(item[p]), none))]
                    if not len(left):
                        break
            if len(left):
                held.setdefault(w, []).append(left)
    if not held:
        return none, none
    d = np.concatenate([x for w in held for x in held[w]]).astype(np.int64)
    w = np.concatenate([np.full(len(x), w) for w in held for x in held[w]])
    order = np.lexsort((w, d))
    d, w = d[order], w[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1] + 1)
    cut = np.flatnonzero(first)
    length = np.diff(np.append(cut, len(d))) + n - 1
    return (d[cut] + w[cut]).astype(np.int64), length


def anchors_of(item: np.ndarray, rank: np.ndarray, anchors: int, usable: np.ndarray) -> list[tuple[int, int]]:
    """(term, first offset) of the rarest usable terms of an item; none if it has too few."""
    first: dict[int, int] = {}
    for o, t in enumerate(item.tolist()):
        if usable[t]:
            first.setdefault(t, o)
    return [(t, first[t]) for t in sorted(first, key=lambda t: rank[t])[:anchors]] if len(first) >= anchors else []


def proximity(item: np.ndarray, rank: np.ndarray, lists: dict[int, np.ndarray], anchors: int, slack: int, usable: np.ndarray):
    """Positions of the item's rarest term with all other anchors near their places."""
    chosen = anchors_of(item, rank, anchors, usable)
    if not chosen:
        return np.zeros(0, np.int64)
    (lead, begin), *rest = chosen
    left = lists.get(lead, np.zeros(0, np.int64)) - begin
    for t, o in rest:
        if not len(left):
            break
        other = lists.get(t, np.zeros(0, np.int64)) - o
        at = np.searchsorted(other, left - slack)
        near = at < len(other)
        near[near] = other[at[near]] <= left[near] + slack
        left = left[near]
    return left + begin


def answerer(shared, phrase: int, anchors: int, slack: int):
    """Index rows to the matches of their documents."""
    ready: list = []

    def run(batches):
        if not ready:
            items, rank, usable = (shared.value[k] for k in ("items", "rank", "usable"))
            flat = np.concatenate([x for _, x in items])
            size = np.array([len(x) for _, x in items])
            ends = np.cumsum(size)
            n = np.repeat(np.minimum(phrase, size), size)
            start = np.flatnonzero(np.arange(len(flat)) + n <= np.repeat(ends, size))
            lead = [[t for t, _ in anchors_of(x, rank, anchors, usable)] for _, x in items]
            near = np.array([i for i, x in enumerate(lead) if x], np.int64)
            ready.append((items, rank, usable, flat, start, n[start], np.repeat(np.arange(len(items)), size)[start], near, np.array([lead[i] for i in near], np.int64).reshape(len(near), anchors)))
        items, rank, usable, flat, start, n, owner, near, lead = ready[0]
        for batch in batches:
            for row in batch.to_pylist():
                docs = np.frombuffer(row["block_docs"], np.int64)
                starts = np.frombuffer(row["starts"], np.int64)
                lists = Postings(row["terms"], row["postings"])
                present = np.zeros(len(rank), bool)
                present[row["terms"]] = True
                held = np.concatenate(([0], np.cumsum(present[flat])))
                some = np.union1d(owner[held[start + n] - held[start] == n], near[present[lead].all(1)])
                best: dict[tuple[int, int], list[int]] = {}
                for item_id, item in (items[i] for i in some):
                    at, length = phrase_runs(item, rank, lists, phrase)
                    for d, k in zip(np.searchsorted(starts, at, "right") - 1, length):
                        x = best.setdefault((int(d), item_id), [0, 0])
                        x[0] = max(x[0], int(k))
                    hits: dict[int, int] = {}
                    for d in np.searchsorted(starts, proximity(item, rank, lists, anchors, slack, usable), "right") - 1:
                        hits[int(d)] = hits.get(int(d), 0) + 1
                    for d, k in hits.items():
                        x = best.setdefault((d, item_id), [0, 0])
                        x[1] = max(x[1], k)
                if best:
                    keys = list(best)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([int(docs[d]) for d, _ in keys], pa.int64()),
                            "item_id": pa.array([i for _, i in keys], pa.int64()),
                            "phrase_tokens": pa.array([best[k][0] for k in keys], pa.int32()),
                            "proximity_hits": pa.array([best[k][1] for k in keys], pa.int32()),
                        }
                    )

    return run


def matches(docs: DataFrame, bench: DataFrame, phrase: int = PHRASE, anchors: int = ANCHORS, slack: int = SLACK, block_tokens: int = BLOCK_TOKENS, term_limit: int = TERM_LIMIT) -> DataFrame:
    """doc_id, item_id, phrase_tokens, proximity_hits: see the module's docstring."""
    spark = docs.sparkSession
    clean = docs.select(F.col("doc_id").cast("long"), F.col("text")).filter("doc_id is not null and text is not null")
    rows = bench.select(F.col("item_id").cast("long"), F.col("text")).filter("item_id is not null and text is not null").distinct()
    result, part, terms, held = None, [], {}, 0
    # the items stream through the driver; no more than a slice of them is held
    for row in rows.toLocalIterator():
        ids, _, words = tokens.encode(pa.array([row.text]))
        if len(ids):
            if terms and (len(terms) + len(words) > term_limit or held + len(ids) > ITEM_TOKENS * term_limit):
                result = _joined(result, _slice(clean, part, terms, phrase, anchors, slack, block_tokens))
                part, terms, held = [], {}, 0
            local = np.array([terms.setdefault(w, len(terms)) for w in words.to_pylist()], np.int32)
            part.append((row.item_id, local[ids]))
            held += len(ids)
    if part or result is None:
        result = _joined(result, _slice(clean, part, terms, phrase, anchors, slack, block_tokens))
    return result.groupBy("doc_id", "item_id").agg(F.max("phrase_tokens").alias("phrase_tokens"), F.max("proximity_hits").alias("proximity_hits"))


def _joined(a, b):
    return b if a is None else a.unionByName(b)


def _slice(clean: DataFrame, items: list, terms: dict[str, int], phrase: int, anchors: int, slack: int, block_tokens: int) -> DataFrame:
    spark = clean.sparkSession
    if not items:
        return spark.createDataFrame([], FOUND)
    gap = slack + max(len(x) for _, x in items) + 1
    words = np.array(list(terms))
    known = spark.sparkContext.broadcast({"known": pa.array(list(terms), pa.large_string())})
    index = written(clean.mapInArrow(indexer(known, gap, block_tokens), INDEX), "postings")
    pairs = index.select(F.explode(F.arrays_zip("terms", "doc_freq")).alias("x")).groupBy("x.terms").agg(F.sum("x.doc_freq").alias("n"))
    freq = np.zeros(len(terms), np.int64)
    for row in pairs.toLocalIterator():
        freq[row.terms] = row.n
    rank = np.empty(len(terms), np.int64)
    rank[np.lexsort((words, freq))] = np.arange(len(terms))
    test = spark.sparkContext.broadcast({"items": items, "rank": rank, "usable": freq > 0})
    return index.mapInArrow(answerer(test, phrase, anchors, slack), FOUND)


def clean_documents(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """The documents without a match; those without an id stay."""
    bad = matches(docs, bench, **params).select(F.col("doc_id").alias("_quoin_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_quoin_bad"], "left_anti")


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from documents where doc_id is not null and text is not null),
b as (select row_number() over () as q, item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from (select distinct item_id, text from benchmark) where item_id is not null and text is not null),
bt as (select q, item_id, len(t) as n, unnest(t) as w, generate_subscripts(t, 1) as o from b),
vocab as (select distinct w from bt),
dt as materialized (select r, doc_id, w, p from (select r, doc_id, unnest(t) as w, generate_subscripts(t, 1) as p from d) semi join vocab using (w)),
df as (select w, count(distinct r) as f from dt group by w),
-- all common tokens by diagonal, from which the runs of successive ones
sizes as (select distinct least({PHRASE}, n) as k from bt),
dg as (select r, doc_id, k, p, array_to_string(t[p : p + k - 1], ' ') as g from (select r, doc_id, t, k, unnest(range(1, len(t) - k + 2)) as p from d cross join sizes where len(t) >= k)),
pairs as (
  select bg.q, bg.item_id, bg.n, dg.r, dg.doc_id, bg.o, dg.p - bg.o as diag
  from (select q, item_id, n, o, least({PHRASE}, n) as k, array_to_string(b.t[o : o + least({PHRASE}, n) - 1], ' ') as g from bt join b using (q, item_id) where o + least({PHRASE}, n) - 1 <= n) bg
  join dg on dg.k = bg.k and dg.g = bg.g),
runs as (
  select doc_id, item_id, q, r, diag, count(*) + min(least({PHRASE}, n)) - 1 as len
  from (select *, o - row_number() over (partition by q, r, diag order by o) as g from pairs) group by doc_id, item_id, q, r, diag, g),
phrase as (select doc_id, item_id, max(len) as phrase_tokens from runs group by all),
firsts as (select q, item_id, w, min(o) as o from bt group by all),
ranked as (
  select *, row_number() over (partition by q order by f, w) as k, count(*) over (partition by q) as terms
  from firsts join df using (w)),
lead as (select * from ranked where k = 1 and terms >= {ANCHORS}),
hits as (
  select l.q, l.item_id, x.r, x.doc_id, x.p, a.k
  from lead l join dt x on x.w = l.w
  join ranked a on a.q = l.q and a.k between 2 and {ANCHORS}
  join dt y on y.w = a.w and y.r = x.r and abs((y.p - a.o) - (x.p - l.o)) <= {SLACK}),
near as (
  select doc_id, item_id, max(c) as proximity_hits from (
    select doc_id, item_id, r, count(*) as c from (
      select doc_id, item_id, q, r, p from hits group by all having count(distinct k) = {ANCHORS - 1}) group by all) group by all)
select coalesce(phrase.doc_id, near.doc_id) as doc_id, coalesce(phrase.item_id, near.item_id) as item_id,
  cast(coalesce(phrase_tokens, 0) as int) as phrase_tokens, cast(coalesce(proximity_hits, 0) as int) as proximity_hits
from phrase full join near on phrase.doc_id = near.doc_id and phrase.item_id = near.item_id
"""
