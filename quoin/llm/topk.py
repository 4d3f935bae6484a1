"""Exact top-k search over vectors by the three-phase uniform threshold.

The score of two vectors is their inner product, a sum of m local scores, one
for each block of dimensions. Each block has its own lists, one for a tile of
queries and a slab of items. (1) Each list gives the items of its k best local
scores; the k-th best sum of those items is a safe bound, and an item of a greater
sum must have a local score of at least an m-th of it somewhere. (2) With that
cutoff, sent to the tiles of queries, the lists give all entries that reach it; an
item's entries, and the cutoff for each one it lacks, bound its score from above,
and the k-th best sum of items with all entries bounds the answer from below: what
lies between are the candidates. (3) Their scores are computed exactly and the k
best kept. Local scores are counted from the query's least one of the block, so
that none is negative.

Queries are the vectors whose id is divisible by ``every``; each is compared with
all vectors. Tiles and slabs are of bounded bytes, so tasks grow in number and not
in size; what the lists give is merged in Spark, by query, and can spill.

Semantics
  * Per query the k best other vectors by (score rounded to 6 digits descending,
    id ascending), with ranks from 1; fewer if there are fewer. A vector is no
    answer to itself.
  * Null ids and null vectors take no part. Null, infinite and NaN elements count
    as 0 and vectors shorter than the longest as filled up with 0; empty vectors
    are all 0. Repeated rows are one vector; of several vectors of an id the
    least counts. Extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

K, BLOCKS, DIGITS, EVERY = 10, 2, 6, 50
#: Bytes of the vectors of a tile of queries and of a slab of items, and of the scores that are held at once.
TILE_BYTES, SLAB_BYTES, STEP_BYTES = 2 << 20, 8 << 20, 16 << 20
PACKED = "ids binary, vectors binary, kth binary, floors binary"
CANDIDATES = "q long, x long, low double, high double"


def tiler(width: int, blocks: int):
    """Rows (id, v, kth, floors) of a tile or slab to one packed row."""

    def run(key, table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        dense = _dense(table.column("v").combine_chunks(), width)
        kth = table.column("kth").to_numpy().astype(np.float64)
        floors = table.column("floors").combine_chunks()
        floors = floors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(floors.flatten()) else np.zeros((len(ids), blocks))
        return pa.table({"tile": [key[0].as_py()], "ids": [ids[order].tobytes()], "vectors": [dense[order].tobytes()], "kth": [kth[order].tobytes()], "floors": [floors[order].tobytes()]}).cast(
            pa.schema([("tile", pa.int32()), *((n, pa.binary()) for n in ("ids", "vectors", "kth", "floors"))])
        )

    return run


def _tiles(table: pa.Table, blocks: int):
    """(ids, matrix, k-th sums, floors) of the packed rows."""
    for row in table.select(["ids", "vectors", "kth", "floors"]).to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        yield ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1), np.frombuffer(row["kth"], np.float64), np.frombuffer(row["floors"], np.float64).reshape(len(ids), blocks)


def _steps(queries: pa.Table, items: pa.Table, blocks: int) -> Iterator[tuple]:
    """(query ids, item ids, local scores by block, whether an item is the query itself, k-th sums, floors) by bounded pieces."""
    for x_ids, x, _, _ in _tiles(items, blocks):
        step = max(1, STEP_BYTES // (8 * max(1, len(x_ids))))
        cuts = np.linspace(0, x.shape[1], blocks + 1).astype(int)
        for q_ids, q, kth, floors in _tiles(queries, blocks):
            for a in range(0, len(q_ids), step):
                b = slice(a, a + step)
                local = [q[b, i:j] @ x[:, i:j].T for i, j in zip(cuts, cuts[1:])]
                yield q_ids[b], x_ids, local, x_ids[None, :] == q_ids[b, None], kth[b], floors[b]


def _table(ddl: str, *columns: np.ndarray) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.table({n: pa.array(c, kinds[t]) for c, (n, t) in zip(columns, (x.split() for x in ddl.split(", ")))})


def lists_ddl(blocks: int) -> str:
    return "q long, x long, total double, " + ", ".join(f"low{b} double" for b in range(blocks))


def gatherer(k: int, blocks: int):
    """Phase 1: the items of the k best local scores of each list with their sums, and the least local scores."""

    def run(key, queries: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for q_ids, x_ids, local, own, _, _ in _steps(queries, items, blocks):
            low = [np.where(own, np.inf, s).min(1) for s in local]
            chosen = np.zeros(own.shape, bool)
            for s in local:
                s = np.where(own, -np.inf, s)
                cols = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
                np.put_along_axis(chosen, cols, True, 1)
            i, j = np.nonzero(chosen & ~own)
            out.append((q_ids[i], x_ids[j], sum(s[i, j] for s in local), *(x[i] for x in low)))
        return _table(lists_ddl(blocks), *(np.concatenate(c) for c in zip(*out))) if out else _table(lists_ddl(blocks), *[[]] * (3 + blocks))

    return run


def cutoffs(lists: DataFrame, k: int, blocks: int) -> DataFrame:
    """id, kth (the k-th best sum of the gathered items above the floors, null if there are fewer) and floors (least local score by block) of each query."""
    floors = lists.groupBy("q").agg(*[F.min(f"low{b}").alias(f"low{b}") for b in range(blocks)])
    kth = lists.select("q", "x", "total").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "x"))).filter(F.col("r") == k)
    floor = F.array(*[f"low{b}" for b in range(blocks)])
    return floors.join(kth.select("q", "total"), "q", "left").select(F.col("q").alias("id"), (F.col("total") - sum(F.col(f"low{b}") for b in range(blocks))).alias("kth"), floor.alias("floors"))


def collector(k: int, blocks: int, digits: int):
    """Phase 2: of the entries that reach the cutoff, the items whose upper bound reaches the k-th best sum known."""

    def run(key, queries: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        # rounding may tie scores that differ by less than a last digit
        spare = 10.0**-digits * 1.01
        for q_ids, x_ids, local, own, kth, floors in _steps(queries, items, blocks):
            least = kth - spare
            cut = (least / blocks)[:, None]
            bound, entries = np.zeros(own.shape), np.zeros(own.shape, np.int8)
            spared = np.maximum(cut, 0)
            for b, s in enumerate(local):
                s -= floors[:, b, None]
                enters = s >= cut
                entries += enters
                bound += np.where(enters, s, spared)
            entries[own] = 0
            if len(x_ids) > k:
                known = np.where(entries == blocks, bound, -np.inf)
                least = np.maximum(least, np.partition(known, len(x_ids) - k, axis=1)[:, -k] - spare)
            i, j = np.nonzero((entries > 0) & (bound >= least[:, None]))
            high = bound[i, j]
            out.append((q_ids[i], x_ids[j], high - (blocks - entries[i, j]) * spared[i, 0], high))
        return _table(CANDIDATES, *(np.concatenate(c) for c in zip(*out))) if out else _table(CANDIDATES, *[[]] * 4)

    return run


def _dense(column, width: int) -> np.ndarray:
    """A list column as a matrix, short lists filled up with 0."""
    offsets = column.offsets.to_numpy()
    flat, size = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def resolver(width: int):
    """Phase 3: exact scores of the candidates (query, item, both vectors)."""

    def run(batches):
        for batch in batches:
            score = np.einsum("ij,ij->i", _dense(batch.column("qv"), width), _dense(batch.column("xv"), width))
            yield pa.RecordBatch.from_pydict({"query_id": batch.column("q"), "item_id": batch.column("x"), "score": pa.array(score, pa.float64())})

    return run


def neighbours(vectors: DataFrame, k: int = K, blocks: int = BLOCKS, digits: int = DIGITS, every: int = 1, tile_bytes: int = TILE_BYTES, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """query_id, item_id, score, rank: see the module's docstring."""
    zero = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.when(F.isnan(e) | (F.abs(e) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(e, F.lit(0.0))))
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), zero.alias("v")).filter("id is not null and v is not null")
    clean = written(clean.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    n, width = clean.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, blocks)
    asked = clean.filter(F.pmod("id", F.lit(every)) == 0)
    tiles, slabs = (max(1, -(-rows * 8 * width // size)) for rows, size in ((asked.count(), tile_bytes), (n, slab_bytes)))

    def packed(rows: DataFrame, parts: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("tile")
        return written(rows.select(part, "id", "v", "kth", "floors").groupBy("tile").applyInArrow(tiler(width, blocks), f"tile int, {PACKED}"), name)

    nothing = [F.lit(0.0).alias("kth"), F.array().cast("array<double>").alias("floors")]
    items = packed(clean.select("id", "v", *nothing), slabs, "slabs")
    # every tile of queries meets every slab of items
    spread = items.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("qt"), F.col("tile").alias("slab"), "ids", "vectors", "kth", "floors").groupBy("qt", "slab")

    def queries(rows: DataFrame, name: str):
        return packed(rows, tiles, name).select(F.col("tile").alias("qt"), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), "ids", "vectors", "kth", "floors").groupBy("qt", "slab")

    lists = written(queries(asked.select("id", "v", *nothing), "tiles").cogroup(spread).applyInArrow(gatherer(k, blocks), lists_ddl(blocks)), "lists")
    cut = asked.join(cutoffs(lists, k, blocks), "id").select("id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), "floors")
    entries = written(queries(cut, "cutoffs").cogroup(spread).applyInArrow(collector(k, blocks, digits), CANDIDATES), "entries")
    least = entries.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "x"))).filter(F.col("r") == k).select("q", F.col("low").alias("kth"))
    candidates = entries.join(least, "q", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth") - F.lit(10.0**-digits * 1.01))).select("q", "x")
    pairs = candidates.join(clean.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").join(clean.select(F.col("id").alias("x"), F.col("v").alias("xv")), "x")
    exact = pairs.mapInArrow(resolver(width), "query_id long, item_id long, score double").withColumn("score", F.round("score", digits) + F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 50, among all."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)


ORACLE = f"""
with v as (select vec_id, min(embedding::double[]) as e from embeddings where vec_id is not null and embedding is not null group by vec_id),
s as (select a.vec_id as query_id, b.vec_id as item_id, round(list_inner_product(a.e, b.e), {DIGITS}) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, item_id) as int) as rank from s)
select query_id, item_id, score, rank from r where rank <= {K}
"""
