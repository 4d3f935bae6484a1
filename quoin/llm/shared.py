"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting under which the files of an execution's shuffles go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quoin-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def free(name: str, columns: list[str]) -> str:
    """The name, with as many leading underscores as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is spoken of."""
    return F.get(F.transform(F.array(value), use), 0)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The frame, written as Parquet in the shared folder, or added to what is at ``path``, and read again; the files of its shuffles go at once."""
    spark = df.sparkSession
    path = path or place(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(spark: SparkSession, path: str) -> None:
    """Removes a written table of which nothing is read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents with both; of a doc_id's different texts, the one with the least hash.

    The text itself is not shuffled: only the ids that have several texts are joined back.
    """
    clean = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    key = F.xxhash64("text")
    several = clean.groupBy("doc_id").agg(F.min(key).alias("_least"), F.max(key).alias("_most")).filter("_least <> _most")
    if several.isEmpty():
        return clean
    several = several.select(F.col("doc_id").alias("_id"), "_least")
    joined = clean.join(several, F.col("doc_id") == F.col("_id"), "left")
    return joined.filter(F.col("_least").isNull() | (key == F.col("_least"))).select("doc_id", "text")
