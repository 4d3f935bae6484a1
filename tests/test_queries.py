import pytest

from oracle import same
from quoin.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_markdown_has_a_row_for_each_document(spark):
    df = QUERIES["markdown_documents"](spark, SF)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.n_pages >= 1 for r in rows)
    assert not any("Page 2" in r.md.split("\n") for r in rows)


def test_whole_lines_are_read(spark):
    """The queries of lines have a form that sees every line of the documents in full, and clips where clip does."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").select("text").collect()
    want = sorted(len(x) for r in rows for x in r.text.split("\n"))
    got = QUERIES["whole_text_norms"](spark, SF).select("clipped").collect()
    assert sorted(len(r.clipped) for r in got) == [n if n <= 14_000 else 14_010 for n in want]
    assert "14000" in ORACLES["whole_text_norms"] and "% 7" not in ORACLES["whole_text_norms"]
