"""Tables like those of larger sizes: long keys, many documents, and plans that don't start a Python group for each."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import same
from quoin.functions.text import py_table_norm, table_norm
from quoin.operators.page import Word, convert, documents
from quoin.operators.scoring import _score, row_similarity
from quoin.plans.markdown import markdown
from quoin.registry import ORACLES, QUERIES
from quoin.sources.tables import pipe_tables, py_pipe_tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """The small tables with keys as long as those of a table 60 times as large as sf0.1."""
    d, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    for t in "region nation customer supplier orders events documents embeddings pages benchmark labels conversations".split():
        (d / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    con.execute(f"copy (select * replace (l_orderkey * 6007 as l_orderkey, l_partkey + 1199000 as l_partkey, l_suppkey + 59900 as l_suppkey) from '{SMALL}/lineitem.parquet') to '{d}/lineitem.parquet'")
    con.execute(f"copy (select * replace (p_partkey + 1199000 as p_partkey) from '{SMALL}/part.parquet') to '{d}/part.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["order_documents", "ruled_documents"])
def test_long_keys_match_sql(spark, long_keys, name):
    same(QUERIES[name](spark, long_keys), ORACLES[name], long_keys)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["reading_order", "markdown_documents", "glyph_words", "order_documents", "ruled_documents"])
def test_no_python_group_for_each_document(spark, name):
    assert "FlatMap" not in plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["raw_lines", "heading_levels", "body_size"])
def test_words_are_not_shuffled(spark, name):
    """Words are set to lines where the text is: neither exploded nor sorted by document."""
    found = plan(QUERIES[name](spark, SMALL))
    assert "Generate" not in found and found.count("Exchange") == 1


def test_rulings_meet_without_a_join(spark):
    found = plan(QUERIES["ruling_intersections"](spark, SMALL))
    assert "Join" not in found and found.count("Exchange hash") == 1


def random_pages(rng, columns):
    pages = []
    for _ in range(rng.randrange(1, 4)):
        words = []
        for k in range(rng.randrange(1, 14)):
            y = 760 - 13.0 * k - rng.choice((0, 0, 2.5))
            for left in (56, 330) if columns else (56,):
                x = float(left)
                for _ in range(rng.randrange(1, 6)):
                    s = rng.choice(("a", "word", "1.", "•", "Page", "7", "....", "a  b", "tab\tbed", "x-"))
                    words.append(Word(s, x + rng.choice((0, 1)), y - rng.choice((0, 0, 0, 1.5)), 6.0 * len(s), rng.choice((11.0, 11.0, 15.0, 22.0, 0.0))))
                    x += 6.0 * len(s) + rng.choice((6, 6, 6, 9, 40))
        rng.shuffle(words)
        pages.append(words)
    return pages


def test_many_documents_at_once_are_as_each_by_itself():
    rng = random.Random(7)
    docs = [random_pages(rng, k % 2) for k in range(300)]
    flat = [(d, p, w) for d, pages in enumerate(docs) for p, ws in enumerate(pages) for w in ws]
    columns = [np.array([getattr(w, c) for _, _, w in flat]) for c in ("x", "y", "w", "size")]
    got = documents(len(docs), np.array([f[0] for f in flat]), np.array([f[1] for f in flat]), [f[2].s for f in flat], *columns, [len(p) for p in docs])
    assert got == [convert(p) for p in docs]


def test_tables_of_words_and_paths_to_markdown(spark):
    rows = [(d, 0, k, s, x, y, 6.0 * len(s), 11.0) for d in range(3) for k, (s, x, y) in enumerate([("AO", 54.0, 685.0), ("07", 74.0, 685.0), ("p1", 94.0, 685.0), ("RF", 54.0, 663.0), ("08", 74.0, 663.0), ("p2", 94.0, 663.0)])]
    words = spark.createDataFrame(rows[::-1], "doc_id long, page_no int, tok_no int, s string, x double, y double, w double, size double")
    bars = [(50.0, 110.0, 700.0 - 22 * i, 701.0 - 22 * i, False) for i in range(3)] + [(x, x + 1, 656.0, 701.0, False) for x in (50.0, 70.0, 90.0, 110.0)]
    paths = spark.createDataFrame([(1, 0, *b) for b in bars], "doc_id long, page_no int, l double, r double, b double, t double, stroked boolean")
    got = {r.doc_id: r.md for r in markdown(words, paths).collect()}
    assert got[1] == "| AO | 07 | p1 |\n| --- | --- | --- |\n| RF | 08 | p2 |\n" and got[0] == got[2] != got[1]
    assert {r.doc_id: r.md for r in markdown(words).collect()} == dict.fromkeys(range(3), got[0])


def brute_score(grid, tables):
    grid, tables = ([[[py_table_norm(c) for c in r] for r in t] for t in x] for x in ([grid], tables))
    grid, best = grid[0], 0.0
    for t in tables:
        for start in range(len(t)):
            best = max(best, sum(row_similarity(g, t[start + i]) for i, g in enumerate(grid) if start + i < len(t)) / max(len(grid), 1))
    return best


def test_scores_of_many_tables_are_as_each_by_itself():
    rng = random.Random(5)
    cell = lambda: rng.choice(("", "a", "A  b", "aaaa aaa", "$ 17 Qty. AO", "19123", "x" * 70, "....", "12. 5 %", "Ünïcode"))
    table = lambda rows: [[cell() for _ in range(rng.randrange(0, 5))] for _ in range(rng.randrange(rows))]
    grids, tables = [table(6) for _ in range(200)], [[table(7) for _ in range(rng.randrange(3))] for _ in range(200)]
    assert np.allclose(_score(grids, tables), [brute_score(g, t) for g, t in zip(grids, tables)])


def test_pipe_tables_and_norms_of_python_are_those_of_columns(spark):
    odd = "| a | b |\n|---|:--:|\n| 1|2\r\n | x |\r\nno\n|\n||\n|--| \n| K….. İ | ’q‘ 1.5 %  † |\n\n| --- |\n|a\x85|\x85"
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").select("text").collect()
    texts = [odd, "", *(r.text.replace("\n", "\n| ") + " | " + odd for r in rows[:60])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.table_no, r.row_no): r.cells for r in pipe_tables(df).collect()}
    assert got == {(d, t, k): row for d, x in enumerate(texts) for t, table in enumerate(py_pipe_tables(x)) for k, row in enumerate(table)}
    lines = spark.createDataFrame([(x,) for t in texts for x in t.split("\n")], "s string").select("s", table_norm(F.col("s")).alias("n")).collect()
    assert all(py_table_norm(r.s) == r.n for r in lines)


@pytest.mark.parametrize("name", ["table_scores", "table_leaderboard"])
def test_rows_of_tables_are_not_joined(spark, name):
    """A conversion meets its grid once; pairs of rows are not rows of a table."""
    found = plan(QUERIES[name](spark, SMALL))
    assert "posexplode" not in found and found.count("Join") == 1


@pytest.mark.parametrize("name", ["column_coverage", "line_cells", "lattice_cells"])
def test_words_of_lines_are_not_exploded(spark, name):
    found = plan(QUERIES[name](spark, SMALL))
    assert not any(x in found for x in ("Generate", "Window", "Join")) and found.count("Exchange hash") == 1


@pytest.mark.parametrize("name", ["column_coverage", "line_cells", "lattice_cells"])
def test_lines_of_long_keys_match_sql(spark, long_keys, name):
    same(QUERIES[name](spark, long_keys), ORACLES[name], long_keys)


def test_coverage_of_odd_rows_matches_sql(spark, long_keys, tmp_path):
    """Lines that come twice, lines without a number, words that lack, and words that reach over others."""
    con = duckdb.connect()
    for t in "region nation customer supplier part orders events documents embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    odd = "l_orderkey % 7 as l_orderkey, case when l_partkey % 3 > 0 then l_linenumber end as l_linenumber, case when l_suppkey % 4 > 0 then l_partkey * 1000000000 end as l_partkey"
    con.execute(f"copy (select * replace ({odd}) from '{SMALL}/lineitem.parquet' union all select * from '{SMALL}/lineitem.parquet' where l_orderkey < 100) to '{tmp_path}/lineitem.parquet'")
    same(QUERIES["column_coverage"](spark, str(tmp_path)), ORACLES["column_coverage"], str(tmp_path))
