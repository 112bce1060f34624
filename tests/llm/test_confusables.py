import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnline.llm.confusables import NEAR, PLAIN, changed_records, consistent, consistent_text, lookalikes, members, prototypes, same_looking, skeleton, tokens_on_pages

CASES = [
    ("ｒｉｎｇ １２", "ring 12"), ("thе pump", "the pump"), ("zero​width", "zerowidth"), ("so­ft", "soft"), ("a b", "a b"), ("ﬂange", "flange"),
    ("café", "café"), ("non‑breaking", "non-breaking"), ("273 K", "273 K"), ("КР-207", "KP-207"), ("а pump", "a pump"), ("\U0001d41bold", "bold"),
    ("Νο", "No"), ("o﻿n", "on"), ("　x", " x"), ("Ångstrom", "Ångstrom"), ("7 bar", "7 bar"),
]
PLAIN_TEXTS = ["2 m² ½ turn", "“quoted” – dash — … •", "¿Qué presión?", "не включать, работают люди", "«Προσοχή υψηλή πίεση»", "10 KΩ, Δp, α-form", "Ångström naïve", "№ 5 ™ °C N·m €", "Дніпро-547", "安全第一", ""]


@pytest.mark.parametrize("text, form", CASES)
def test_forms(text, form):
    assert consistent(text) == form and consistent(form) == form


@pytest.mark.parametrize("text", PLAIN_TEXTS)
def test_no_cases(text):
    assert consistent(text) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_idempotent(text):
    assert consistent(consistent(text)) == consistent(text)
    assert skeleton(consistent(text)) == skeleton(text)


def test_prefilter_covers_the_tables():
    import re

    plain = re.compile(f"[{PLAIN}]")
    near = {c for c in NEAR[0] if c > "\u024f"}
    assert not [c for c in {*prototypes(), *lookalikes(), *near} | {chr(x) for x in range(0x300, 0x370)} if plain.match(c)]


def test_records(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(100 + i, t) for i, t in enumerate(PLAIN_TEXTS)] + [(200, None), (201, "x" * 200_000 + "​"), (3, CASES[3][0])]
    df = spark.createDataFrame(rows, "ingest_id long, text string")
    found = changed_records(df, "ingest_id", "text")
    assert {r.row_id for r in found.collect()} == {*range(len(CASES)), 201} and found.first().field == "text"
    forms = {r.ingest_id: r.text for r in consistent_text(df, "text").collect()}
    assert forms[0] == "ring 12" and forms[200] is None and forms[110] == ""
    assert changed_records(df.where("false"), "ingest_id", "text").count() == 0


def test_tokens_on_pages(spark):
    pages = spark.createDataFrame([("d", 1, "The  ｌｉｍｉｔ is 5 bar"), ("d", 1, None), ("d", 2, "x")], "source_doc_id string, page int, text string")
    tokens = spark.createDataFrame(
        [(1, "d", 1, "LIMIT is 5 bar"), (2, "d", 2, "limit"), (3, "d", 1, None), (4, "d", 9, "x"), (5, "d", 1, " "), (1, "d", 1, "LIMIT is 5 bar")],
        "cand_id long, source_doc_id string, source_page int, key_value_token string",
    )
    assert {(r.cand_id, r.found) for r in tokens_on_pages(tokens, pages).collect()} == {(1, True), (2, False), (3, False), (4, False), (5, False)}


MORE = [("pαge", "page"), ("νalνe", "valve"), ("mοtοr", "motor"), ("fοrcе", "force"), ("pιpe", "pipe"), ("ring\x00", "ring"), ("a\x08b\x1b\x7f", "ab"), ("tag\U000e0041\U000e007f", "tag"), ("vs\U000e0100", "vs")]


@pytest.mark.parametrize("text, form", MORE)
def test_near_letters_and_all_invisibles(text, form):
    assert consistent(text) == form and consistent(form) == form


@pytest.mark.parametrize("text", ["ρgh", "αmax", "γ-ray", "νβ", "Yıldız", "клапан", "κλειδί", "a\tb\r\nc\x0cd"])
def test_signs_and_layout_stay(text):
    assert consistent(text) == text


def test_same_looking(spark):
    rows = [(1, "The pump"), (2, "The puｍp"), (3, "The pump"), (4, "valve"), (5, None), (6, ""), (7, "The p\x00ump")]
    df = spark.createDataFrame(rows, "ingest_id long, text string").selectExpr("*", "'x' AS field", "0 AS skeleton")
    got = sorted((r["first"], r["n"], r["forms"]) for r in same_looking(df, "ingest_id", "text").collect())
    assert got == [(1, 4, 3), (4, 1, 1), (6, 1, 1)]
    by = {r.row_id: r.skeleton for r in members(df, "ingest_id", "text").collect()}
    assert by[1] == by[2] == by[3] == by[7] != by[4] and 5 not in by
    assert {r.row_id for r in changed_records(df, "ingest_id", "text").collect()} == {2, 7}


@pytest.mark.parametrize("text, form", [("Ꭺpple", "Apple"), ("ꓲtem", "Item"), ("Ⲟil", "Oil"), ("1․2 a∶b", "1.2 a:b"), ("pαssword", "password"), ("ɡoogle", "google"), ("ɑpple", "apple"), ("νoltage", "voltage")])
def test_other_scripts_and_signs(text, form):
    assert consistent(text) == form and consistent(form) == form


@pytest.mark.parametrize("text", ["5 − 3", "3 × 4", "ᏣᎳᎩ", "ⲘⲚⲦⲢⲘⲚⲔⲎⲘⲈ"])
def test_own_signs_and_scripts_stay(text):
    assert consistent(text) == text
