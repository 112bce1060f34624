import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnline.functions import text as T
from tarnline.operators.chunking import split_text

REFUSED = "The provided context does not contain the answer"


@pytest.mark.parametrize(
    "answer, refused, kind",
    [
        (REFUSED + ".", True, "exact_refusal"), ("  " + REFUSED.lower() + "  ", True, "exact_refusal"), (REFUSED + " .", True, "exact_refusal"), (REFUSED + "...", True, "exact_refusal"), ("...", False, "attempt"), (None, False, "empty"),
        (" ", False, "empty"), ("12 bar. " + REFUSED + ".", False, "exact_refusal"), ("The value is not available.", False, "near_miss_refusal"), ("Keep the area dry. " * 9 + "The value is not available.", False, "attempt"),
        ("Keep the area dry. " * 9 + "The rest is not in the provided context.", False, "near_miss_refusal"), ("Use a wrench.", False, "attempt"),
    ],
)
def test_refusals(spark, answer, refused, kind):
    row = spark.createDataFrame([(answer,)], "a string").select(T.is_refusal(F.col("a")), T.refusal_class(F.col("a"))).first()
    assert tuple(row) == (refused, kind)


@pytest.mark.parametrize("chunk, page", [("guide-p12-3", 12), ("a-p1-p2-0", 1), ("none", -1), ("x-p-1", -1), ("x-p99999999999999999999-1", -1)])
def test_page_of_id(spark, chunk, page):
    assert spark.createDataFrame([(chunk,)], "i string").select(T.page_of_id(F.col("i"))).first()[0] == page


def test_white_space_is_unicode(spark):
    df = spark.createDataFrame([("  a b \n",)], "t string")
    assert tuple(df.select(T.squeezed(F.col("t")), T.stripped(F.col("t")), T.is_blank(F.col("t"))).first()) == ("ab", "a b", False)
    assert df.select(T.is_blank(F.lit("   ")), T.is_blank(F.lit(None).cast("string"))).first() == (True, True)


def test_contexts(spark):
    df = spark.createDataFrame([("d", 0, "x"), (None, None, None)], "d string, p int, t string")
    got = [r[0] for r in df.select(T.context_string(F.col("d"), F.col("p"), F.col("t"))).collect()]
    assert got == ["[source_doc_id=d page=0]\nx", "[source_doc_id=None page=None]\n"]
    assert df.select(T.context_block(F.array().cast("array<string>"))).first()[0] == "(no context retrieved)"


def test_hashes_and_links(spark):
    df = spark.createDataFrame([("see 77e1f50 and deadbeef0, not 77e1f50x or 123456",)], "t string")
    assert df.select(T.hash_tokens(F.col("t"))).first()[0] == ["77e1f50", "deadbeef0"]
    kinds = [df.select(T.link_kind(F.lit(x))).first()[0] for x in ("#a", "https://x", "docs/a.md#b")]
    assert kinds == ["fragment", "scheme", "relative"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40))
def test_splitter_keeps_every_letter_and_the_limit(text, size):
    pieces = split_text(text, size, 0)
    assert "".join("".join(pieces).split()) == "".join(text.split())
    assert all(p and p == p.strip() and len(p) <= size for p in pieces)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc \n", max_size=200), st.integers(8, 40), st.integers(0, 7))
def test_splitter_overlap_stays_within_the_limit(text, size, overlap):
    assert all(len(p) <= size for p in split_text(text, size, overlap))
