"""A corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.llm import decontaminate, jaccard_join, pieces, quality
from quoin.llm.line_dedup import apply_bitmaps, keep_bitmaps
from quoin.llm.shared import written


def keep_good(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go; so do null and blank texts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(model.verdict(F.col("text"))["keep"])


def dedup_lines(spark, docs, sf_dir):
    """Lines that occurred before, here or in another document, go; so do documents left without any."""
    return apply_bitmaps(docs, keep_bitmaps(docs))


def dedup_near(spark, docs, sf_dir):
    """Of each group of near duplicates (connected pairs) the document of the least doc_id stays.

    Documents without an id or without tokens stay. Repeated rows, equal in id and text, become one.
    """
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    groups = jaccard_join.groups(jaccard_join.similar_pairs(docs))
    gone = groups.filter("doc_id <> group").select(F.col("doc_id").alias("_quoin_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_quoin_gone"], "left_anti").select(*docs.columns)


def decontaminated(spark, docs, sf_dir):
    """Documents that hold a passage of the benchmark, or its rare words in its layout, go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encoded(spark, docs, sf_dir):
    """Each document as the ids of its pieces, with whether they decode to the text."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]
#: The classifier is fitted and encoding merges by rank; SQL can express neither.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
