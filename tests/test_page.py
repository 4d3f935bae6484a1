from quoin.functions.text import py_clean, py_heading_like, py_is_page_number
from quoin.operators.glyphs import fold
from quoin.operators.page import Line, Word, block_cuts, classify, convert, cut_references, join_lines, make_line, repeat_period, segments, table_text
from quoin.operators.rulings import components, lattices, merge_segments
from quoin.operators.scoring import py_dice, row_similarity
from quoin.sources.tables import ragged_rows


def text(x, y, s, size=11.0):
    out = []
    for w in s.split():
        out.append(Word(w, x, y, 0.5 * size * len(w), size))
        x += 0.5 * size * (len(w) + 0.5)
    return out


def test_headings_paragraph_list():
    page = text(56, 760, "Quarterly Notes", 22) + text(56, 720, "This document records the") + text(56, 707, "headline outcomes.") + text(56, 670, "Highlights", 15)
    page += text(56, 640, "• Signed two customers") + text(56, 624, "• Shipped the export") + text(72, 608, "• no data loss")
    assert convert([page]) == "# Quarterly Notes\n\nThis document records the headline outcomes.\n\n## Highlights\n\n- Signed two customers\n- Shipped the export\n  - no data loss\n"


def test_table_of_aligned_cells():
    rows = [("Plan", "Seats", "Price"), ("Solo", "1", "$0"), ("Team", "10", "$49"), ("Scale", "50", "$199")]
    page = [w for i, r in enumerate(rows) for x, c in zip((60, 180, 300), r) for w in text(x, 700 - 22 * i, c)]
    assert convert([page]) == "| Plan | Seats | Price |\n| --- | --- | --- |\n| Solo | 1 | $0 |\n| Team | 10 | $49 |\n| Scale | 50 | $199 |\n"


def test_two_columns_are_read_one_after_the_other():
    left, right = [f"left words number {c}" for c in "abcdefgh"], [f"right words number {c}" for c in "abcdefgh"]
    page = [w for i in range(8) for w in text(56, 700 - 13 * i, left[i]) + text(320, 700 - 13 * i, right[i])]
    md = convert([page])
    assert md.index("left words number h") < md.index("right words number a")


def test_running_heads_and_page_numbers_go():
    pages = [text(56, 800, "Annual Report", 8) + text(56, 700, f"Body text of page {c}.") + text(280, 30, f"Page {k}", 8) for k, c in enumerate("xyz", 1)]
    md = convert(pages)
    assert "Annual Report" not in md and "Page" not in md and "Body text of page y." in md


def test_ruled_table():
    words = [w for i, r in enumerate([("Name", "Value", "Unit"), ("a", "1", "kg"), ("b", "2", "m")]) for x, c in zip((60, 75, 95), r) for w in [Word(c, x, 690 - 20 * i, 8, 11)]]
    segs = [("h", 700 - 20 * i, 50, 110) for i in range(4)] + [("v", x, 640, 700) for x in (50, 70, 90, 110)]
    free, found = lattices(words, [(a, float(p), float(b), float(c)) for a, p, b, c in segs])
    assert not free and found[0][1].splitlines()[0] == "| Name | Value | Unit |"


def test_small_parts():
    assert py_clean("F o r m W-9") == "Form W-9" and py_clean("a b testing") == "a b testing"
    assert py_clean("1. 2. 3. 4") == "1.2.3.4" and py_clean("Contents ..... 3") == "Contents 3"
    assert py_is_page_number(" Page 12 ") and not py_is_page_number("PAGE 12")
    assert py_heading_like("On Reading Order") and not py_heading_like("see www.x.org") and not py_heading_like("Call 555 123 4567")
    assert join_lines(["some hyphen-", "ated text", "Mid-", "Atlantic"]) == "some hyphenated text Mid-Atlantic"
    assert merge_segments([(10.0, 0.0, 5.0), (10.5, 9.0, 20.0), (40.0, 0.0, 1.0)]) == [(10.0, 0.0, 20.0), (40.0, 0.0, 1.0)]
    assert len(components([(10.0, 0.0, 20.0)], [(5.0, 0.0, 20.0), (50.0, 0.0, 20.0)])) == 2
    assert cut_references(["a", "b", "c", "# References", "x"]) == ["a", "b", "c"]
    assert repeat_period([["A", "B", "C", "A", "B", "C"]], 6) == 3
    assert py_dice("night", "nacht") == 0.25 and py_dice("", "") == 1.0 and py_dice("a", "b") == 0.0
    assert row_similarity(["a", "bc"], ["bc"]) == 2 / 3
    assert ragged_rows('a,"b, ""c"""\r\n,\n1\n') == [["a", 'b, "c"'], ["1"]]
    assert convert([[]]) == "\n" and Line


def glyph(k, ch, x, size=11.0, **more):
    return {"glyph_no": k, "ch": ch, "raw_size": size, "l": x, "r": x + 5, "b": 100.0, "t": 110.0, "ma": 1.0, "mb": 0.0, "rot": 0} | more


def test_glyphs():
    words = fold([glyph(0, "a", 0.0), glyph(1, "b", 5.0), glyph(2, " ", 10.0, 1.0), glyph(3, "c", 10.0), glyph(4, "d", 40.0), glyph(5, "S", 50.0, 84.0, t=220.0, mb=-1.0), glyph(6, None, 45.0), glyph(7, "e", 45.0)])
    assert [w[0] for w in words] == ["ab", "c", "d", "e"]
    assert fold([glyph(0, "a", 0.0, rot=90)])[0][1:3] == (100.0, -0.0)


def row(y, *cells, size=11.0):
    """A line of cells (x, text)."""
    return make_line([w for x, c in cells for w in text(x, y, c, size)])


def test_short_pieces_join_the_next_one():
    rows = [row(700 - 10 * k, (56, "aaa"), (200, "bbb")) for k in range(3)] + [row(660 - 10 * k, (90, "ccc"), (300, "ddd")) for k in range(3)] + [row(620 - 10 * k, (130, "eee"), (400, "fff")) for k in range(6)]
    assert [len(s) for s in segments(rows)] == [12]
    assert [len(s) for s in segments(rows[6:] + rows[:3])] == [9]


def test_rows_of_labels_that_do_not_line_up_are_prose():
    aligned = [row(700 - 16 * k, (56, f"{k}."), (130, "some words of text")) for k in range(4)]
    assert [b for _, b in classify([aligned], 11.0, {})] == [f"{k}. some words of text" for k in range(4)]
    ragged = [row(700 - 16 * k, (56 + 40 * k, f"x{k}:"), (230 + 40 * k, "some words of text")) for k in range(4)]
    assert len(classify([ragged], 11.0, {})) == 1


def test_tables_side_by_side():
    cells = lambda k: [(60, f"aa{k}"), (100, f"bb{k}"), (140, f"cc{k}"), (300, f"dd{k}"), (340, f"ee{k}"), (380, f"ff{k}")]
    rows = [row(700 - 16 * k, *cells(k)) for k in range(6)]
    found = table_text(rows)
    assert found.count("| --- | --- | --- |") == 2 and found.index("| aa5") < found.index("| dd0")
    assert len(block_cuts(rows, [(60.0, 0.0), (100.0, 20.0), (140.0, 20.0), (300.0, 140.0), (340.0, 20.0), (380.0, 20.0)])) == 1
