import pytest
from pyspark.sql import functions as F

from tarnline.llm import scans as S

CLEAN = (
    "The crew opens the spark-proof valve before the shift and notes the reading in the log. Nobody starts the pump while the guard is off. "
    "The governor linkage is rated for 411 bar until the next inspection of the system. Each site has its own harness and the operator checks it of old."
)
PAGE = """CLEANING GATE VALVE    12
The crew opens the spark-
proof valve before the shift and notes the read-
— 12 —
Chapter 3  Arc Flash
ing in the 1og. Nobody starts tbe purnp while
the guard is 0ff. The govcrnor liriKage is rated
for 4l1 bar until the next inspection of the sys¬
tem.
Page 12"""


def repairs(spark, rows):
    df = spark.createDataFrame(rows, "ingest_id long, text string, left string, fix string")
    return sorted((r.row_id, r.line_no, r.fix) for r in S.scan_repairs(df).collect())


def test_page(spark):
    rows = [(i, CLEAN, "", "") for i in range(20)] + [(100, PAGE, "", ""), (101, PAGE, "", ""), (7, None, "", ""), (8, "", "", ""), (9, "short\nlines\nonly", "", "")]
    expected = [
        (1, ""), (2, "spark-proof"), (3, "reading"), (4, ""), (5, ""), (6, "log"), (6, "pump"), (6, "the"), (7, "governor"), (7, "linkage"), (7, "off"), (8, "411"), (8, "system"), (10, ""),
    ]
    got = repairs(spark, rows)
    assert got == sorted((i, n, f) for i in (100, 101) for n, f in expected)


def test_reflow(spark):
    page = PAGE.replace("Page 12", "\nSite ru1es: Nobody starts the\npurnp, says the oper-\nator.\n12")
    df = spark.createDataFrame([(i, CLEAN.replace("harness", "harness rules says")) for i in range(20)] + [(100, page)], "ingest_id long, text string")
    got = {r.row_id: r.text for r in S.reflowed(df).collect()}
    assert got == {
        100: "The crew opens the spark-proof valve before the shift and notes the reading in the log. Nobody starts the pump while the guard is off. "
        "The governor linkage is rated for 411 bar until the next inspection of the system.\n\nSite rules: Nobody starts the pump, says the operator."
    }


def test_nothing(spark):
    assert repairs(spark, []) == []
    assert repairs(spark, [(1, CLEAN, "", "")]) == []


@pytest.mark.parametrize("word, read", [("spririg", "spring"), ("riibber", "rubber"), ("clischarge", "discharge"), ("perrnit", "permit"), ("slovvly", "slowly"), ("liarness", "harness"), ("5a1e", "sale"), ("9b9", "989"), ("bours", "hours")])
def test_skeletons_group_misread_words(spark, word, read):
    row = spark.createDataFrame([(word, read)], "a string, b string").select(S.skeleton(F.col("a")), S.skeleton(F.col("b"))).first()
    assert row[0] == row[1]


@pytest.mark.parametrize("text", ["a\tb\nc\td\ne\tf", "• one\n• two\n• three", "One line of text that is long enough.\nAnother line. It ends here.\nAnd a third one.", CLEAN + "\n" + CLEAN])
def test_other_layouts_are_no_scans(text):
    assert not S.is_scanned(text)
    assert S.is_scanned(PAGE)


def test_wide_lines_and_few_lines_are_no_bar():
    """A page is judged by its width as a whole: one line of 86 characters, or a page of two lines, is a scan still."""
    wide = "The crew opens the spark-proof valve before the shift and notes the readings in the old"
    body = ["log. Nobody starts the pump while the guard of the large pump is off and the", "lever of the governor linkage is rated for 411 bar until the next inspection", "of the whole system in the hall. Each site has its own harness and then the"]
    assert len(wide) > 85 and S.is_scanned("\n".join([wide, *body * 4])) and S.is_scanned("\n".join(body[:2]))
    assert not S.is_scanned("\n".join([wide * 4, *body])) and not S.is_scanned("\n".join([wide] * 3))


def test_heads_recur_within_their_source(spark):
    """A title that recurs on pages of other sources, or on the same page read again, is no running head."""
    lines = ["the crew opens the valve of the pump before", "the shift and notes the reading in the old", "book of the hall. Nobody starts the pump", "Gate Valve Safety", "while the guard is off and the seal of the", "pump is worn, because the rules forbid it", "to everyone who works in the hall."]
    page = lambda i: "\n".join(lines).replace("book", "book" + "abcdefgh"[i])
    rows = [(1, "a", page(0)), (2, "b", page(1)), (3, "b", page(1)), (4, "c", page(2)), (5, "c", page(3))]
    df = spark.createDataFrame(rows, "ingest_id long, source_doc_id string, text string")
    assert {(r.row_id, r.line_no) for r in S.scan_repairs(df).where("fix = ''").collect()} == {(4, 4), (5, 4)}
