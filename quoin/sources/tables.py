"""Tables out of texts: Markdown's pipe tables, and CSV with rows of unequal length."""

from __future__ import annotations

import csv
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pipe_tables(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_no, row_no, cells of all pipe tables: runs of lines that begin with a pipe, separator rows left out."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy(key).orderBy("line_no")
    piped = F.col("line").startswith("|")
    tables = lines.withColumn("new", piped & ~F.coalesce(F.lag(piped).over(w), F.lit(False))).withColumn("table_no", F.sum(F.col("new").cast("int")).over(w) - 1)
    body = F.regexp_replace(F.regexp_replace("line", r"^\|", ""), r"\|$", "")
    rows = tables.filter(piped).withColumn("cells", F.transform(F.split(body, r"\|"), lambda c: F.trim(c)))
    rows = rows.filter(~F.forall("cells", lambda c: c.rlike(r"^:?-{2,}:?$")))
    order = Window.partitionBy(key, "table_no").orderBy("line_no")
    return rows.select(key, F.col("table_no").cast("int").alias("table_no"), (F.row_number().over(order) - 1).alias("row_no"), "cells")


ENDS = "\r\x85\u2028\u2029"  # line ends other than \n, before which a pattern's end matches in Java
SEPARATOR = re.compile(rf":?-{{2,}}:?[{ENDS}]?")


def py_pipe_tables(text: str) -> list[list[list[str]]]:
    """The rows of cells of a text's pipe tables, as ``pipe_tables`` has them; tables of separator rows only are empty."""
    out: list[list[list[str]]] = []
    before = False
    for line in text.split("\n"):
        line = line.strip(" ")
        piped = line.startswith("|")
        if piped:
            if not before:
                out.append([])
            body = line[1:]
            if body.endswith("|"):
                body = body[:-1]
            elif body[-2:-1] == "|" and body[-1] in ENDS:
                body = body[:-2] + body[-1]
            cells = [c.strip(" ") for c in body.split("|")]
            if not all(SEPARATOR.fullmatch(c) for c in cells):
                out[-1].append(cells)
        before = piped
    return out


def ragged_rows(text: str) -> list[list[str]]:
    """Rows of a CSV text as they are, cells trimmed; rows of blank cells are left out."""
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""))]
    return [r for r in rows if any(r)]


def csv_rows(texts: DataFrame, key: str = "id") -> DataFrame:
    """key, row_no, cells of CSV texts, whose rows may be of unequal length."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, numbers, cells = [], [], []
            for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                for n, row in enumerate(ragged_rows(text or "")):
                    keys.append(k)
                    numbers.append(n)
                    cells.append(row)
            yield pa.RecordBatch.from_pydict({key: pa.array(keys, batch.column(key).type), "row_no": pa.array(numbers, pa.int32()), "cells": pa.array(cells, pa.list_(pa.string()))})

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {kind}, row_no int, cells array<string>")
