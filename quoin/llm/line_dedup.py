"""Line dedup over a whole corpus.

Every line is hashed to 128 bits. The hashes are range-partitioned and sorted by
hash, document and position, so equal lines lie together and a window streams
over them and marks the first. What leaves is no text but, for each document, a
compressed bitmap of the lines to keep.

Semantics
  * Lines are the pieces of the text between newlines. Two lines are equal if
    they are equal after trimming and collapsing white space.
  * A blank line is never a duplicate; it is always kept.
  * The first occurrence has the least (doc_id, text, position); a null doc_id
    comes before all others.
  * One row per distinct (doc_id, text): repeated rows are one document. A null
    text gives a row with 0 lines and an empty bitmap; an empty text has 1 blank line.
  * Extra columns of the input are not looked at; an empty table gives none.

Bitmap: run lengths, the first run kept lines, then dropped, kept and so on,
each a little-endian base-128 varint, written as hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, written

BLANK = r"[ \t\r\n\f]+"


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("text"),
        F.xxhash64(F.col("text"), F.lit(1)).alias("text_key"),
    )


def varint(n: Column) -> Column:
    """A number of up to 35 bits as hexadecimal varint."""

    def byte(shift: int, more: bool) -> Column:
        low = F.shiftright(n, shift).bitwiseAND(F.lit(127)) + F.lit(128 if more else 0)
        return F.lpad(F.hex(low), 2, "0")

    out = F.concat(*[byte(7 * k, k < 4) for k in range(5)])
    for k in range(3, -1, -1):
        short = F.concat(*[byte(7 * i, i < k) for i in range(k + 1)])
        out = F.when(n < F.lit(1 << (7 * (k + 1))), short).otherwise(out)
    return out


def bitmap_of(flags: Column) -> Column:
    """The bitmap of an array of booleans, one for each line in order."""

    def runs(f: Column) -> Column:
        turns = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: (i == 0) | (F.get(f, i) != F.get(f, i - 1)))
        sizes = let(turns, lambda t: F.transform(t, lambda x, i: (F.coalesce(F.get(t, i + 1), F.size(f)) - x).cast("bigint")))
        return F.concat(F.when(F.get(f, 0), F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint"))), sizes)

    return F.when(F.size(flags) == 0, F.lit("")).otherwise(F.array_join(F.transform(let(flags, runs), varint), ""))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_lines, n_kept, keep: see the module's docstring."""
    lines = _keys(docs).select(
        "doc_id", "text_key", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")
    )
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", BLANK, " ")))
    # the hashes are written once: choosing range bounds reads its input twice
    hashed = written(
        lines.select(
            "doc_id",
            "text_key",
            "pos",
            F.when(F.col("line") != "", F.xxhash64("line")).alias("h1"),
            F.when(F.col("line") != "", F.xxhash64("line", F.lit(7))).alias("h2"),
        ),
        "lines",
    )
    order = ["h1", "h2", "doc_id", "text_key", "pos"]
    ranged = hashed.filter("h1 is not null").repartitionByRange("h1", "h2").sortWithinPartitions(*order)
    w = Window.partitionBy("h1", "h2").orderBy("doc_id", "text_key", "pos")
    # repeated rows give a line twice; one of the two is a first occurrence and its mark wins
    marks = ranged.select("doc_id", "text_key", "pos", (F.row_number().over(w) == 1).alias("keep"))
    blank = hashed.filter("h1 is null").select("doc_id", "text_key", "pos", F.lit(True).alias("keep"))
    lined = marks.unionByName(blank).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "keep")).alias("marks"))
    lined = lined.withColumn("marks", F.array_sort(F.filter("marks", lambda x: x["pos"].isNotNull())))
    # false sorts before true, so the last mark of a position is the one to take
    last = F.filter("marks", lambda x, i: F.coalesce(F.get(F.col("marks"), i + 1)["pos"] != x["pos"], F.lit(True)))
    lined = lined.withColumn("flags", F.transform(last, lambda x: x["keep"]))
    return lined.select(
        "doc_id",
        "text_key",
        F.size("flags").alias("n_lines"),
        F.size(F.filter("flags", lambda x: x)).alias("n_kept"),
        bitmap_of(F.col("flags")).alias("keep"),
    )


def keep_flags(bitmap: Column) -> Column:
    """The array of runs of a bitmap as array of booleans, a flag for each line; null for an empty bitmap."""

    def flags(data: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("long"))
        return let(each, of_bytes)

    def of_bytes(x: Column) -> Column:
        last = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) < 128)
        return let(last, lambda e: F.flatten(F.transform(e, lambda to, k: F.array_repeat(k % 2 == 0, run(x, F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1), to)))))

    def run(x: Column, a: Column, b: Column) -> Column:
        parts = [F.when(a + j <= b, F.shiftleft(F.get(x, a + j).bitwiseAND(F.lit(127)), 7 * j)).otherwise(F.lit(0)) for j in range(5)]
        return sum(parts[1:], parts[0]).cast("int")

    return F.when(F.length(bitmap) > 0, let(F.unhex(bitmap), flags))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with the dropped lines gone and n_chars renewed.

    A document that had lines and keeps none that isn't blank is dropped.
    """
    b = bitmaps.select(F.col("doc_id").alias("_quoin_id"), F.col("text_key").alias("_quoin_key"), F.col("n_lines").alias("_quoin_n"), F.col("n_kept").alias("_quoin_kept"), F.col("keep").alias("_quoin_keep"))
    key = F.xxhash64(docs["text"], F.lit(1))
    joined = docs.join(b, docs["doc_id"].eqNullSafe(b["_quoin_id"]) & (key == b["_quoin_key"]), "left")
    lines = F.split("text", "\n")
    kept = let(keep_flags(F.col("_quoin_keep")), lambda f: F.array_join(F.filter(lines, lambda x, i: F.get(f, i)), "\n"))
    had = F.trim(F.regexp_replace("text", BLANK, " ")) != ""
    text = F.when(F.col("_quoin_kept") == F.col("_quoin_n"), F.col("text")).otherwise(F.col("_quoin_new"))
    return (
        joined.withColumn("_quoin_new", F.when(F.col("_quoin_kept") < F.col("_quoin_n"), kept))
        .filter(F.coalesce(~had | (F.trim(F.regexp_replace(text, BLANK, " ")) != ""), F.lit(True)))
        .select(*[text.alias("text") if c == "text" else (F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return keep_bitmaps(docs).select("doc_id", "n_lines", "n_kept", "keep")


ORACLE = r"""
with d as (select distinct doc_id, text from documents),
l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from d where text is not null),
n as (select *, trim(regexp_replace(line, '[ \t\r\n\f]+', ' ', 'g')) as k from l),
f as (
  select doc_id, text, pos, k = '' or row_number() over (partition by k order by doc_id nulls first, text, pos) = 1 as keep from n),
r as (
  select *, sum(chg) over (partition by doc_id, text order by pos) as run
  from (select *, case when keep = lag(keep, 1, true) over (partition by doc_id, text order by pos) then 0 else 1 end as chg from f)),
g as (select doc_id, text, run, count(*) as n from r group by all),
p as (
  -- a first run of dropped lines follows an empty run of kept ones
  select doc_id, text, run, n from g
  union all
  select doc_id, text, 0, 0 from g group by doc_id, text having min(run) = 1),
s as (
  select doc_id, text, string_agg(
    case when n < 128 then printf('%02X', n)
         when n < 16384 then printf('%02X%02X', (n & 127) + 128, n >> 7)
         else printf('%02X%02X%02X', (n & 127) + 128, ((n >> 7) & 127) + 128, n >> 14) end, '' order by run) as keep
  from p group by doc_id, text)
select s.doc_id, cast(c.n_lines as int) as n_lines, cast(c.n_kept as int) as n_kept, s.keep
from s join (select doc_id, text, count(*) as n_lines, count(*) filter (keep) as n_kept from f group by doc_id, text) c
  on s.doc_id is not distinct from c.doc_id and s.text = c.text
union all
select doc_id, 0, 0, '' from d where text is null
"""
