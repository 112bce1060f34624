import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnline.llm.repeated_lines import repeated_lines, without_lines
from tarnline.llm.rolling import lines_and_chunks

SCHEMA = "ingest_id long, source_doc_id string, text string, source string, row_id long, chunk string"


def brute(rows, min_rows=5, share=0.05):
    total, held, places = defaultdict(int), defaultdict(set), []
    for i, source, text, *_ in rows:
        if source is None:
            continue
        total[source] += 1
        for n, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            key = re.sub(r"[\d\s]+", "", line).lower()
            if any(c.isalpha() for c in key):
                held[source, key].add(i)
                places.append((i, n, source, key))
    return {(i, n) for i, n, s, k in places if len(held[s, k]) >= min_rows and len(held[s, k]) >= share * total[s]}


def sample(rng):
    notices = ["Page 12 of the guide", "Share THIS page", "x", "Ünï 7 ködes für alle", "All rights reserved by the publisher of this long handbook, with a line that runs on and on over many symbols " * 3]
    rows = []
    for i in range(400):
        source = ["hot", "hot", "mid", "tiny"][rng.integers(4)] if i % 50 else None
        lines = [f"Body {i} " + "".join(rng.choice(list("abcdef ghij"), 60)) for _ in range(rng.integers(0, 4))]
        for notice in notices:
            if rng.random() < 0.1:
                lines.insert(rng.integers(0, len(lines) + 1), notice.upper() if rng.random() < 0.3 else notice.replace("12", str(i)))
        text = None if i % 37 == 0 else "" if i % 41 == 0 else "\n\n".join(lines) + ("\r\n" if i % 3 else "")
        rows.append((i, source, text, "clash", -1, "clash"))
    return rows


def test_equals_brute_force(spark):
    rows = sample(np.random.default_rng(5))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.row_id, r.line_no) for r in repeated_lines(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows) and got


def test_cleaned_text_is_otherwise_unchanged(spark):
    rows = sample(np.random.default_rng(6))
    df = spark.createDataFrame(rows, SCHEMA)
    cut = defaultdict(set)
    for i, n in brute(rows):
        cut[i].add(n)
    got = {r.ingest_id: r.text for r in without_lines(df, repeated_lines(df)).collect()}
    for i, _, text, *_ in rows:
        expected = text if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in cut[i])
        assert got[i] == expected


def test_empty_table_and_all_null(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_lines(df).count() == 0
    assert repeated_lines(spark.createDataFrame([(i, None if i % 2 else "s", None, "", 0, "") for i in range(20)], SCHEMA)).count() == 0


def test_very_long_text_and_repeated_rows(spark):
    long = "The same notice\n" + "lorem ipsum " * 60_000
    rows = [(i, "s", long, "", 0, "") for i in range(6)]
    got = {(r.row_id, r.line_no) for r in repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, n) for i in range(6) for n in (1, 2)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé1 \n\t𝟙x", max_size=80), min_size=1, max_size=6), st.integers(0, 3))
def test_fingerprints_do_not_depend_on_neighbours(texts, at):
    """A line and its chunks hash alike wherever it stands."""
    line = "shared line of words abc"
    alone = lines_and_chunks([line], 4, 8)
    mixed = list(texts)
    mixed.insert(min(at, len(mixed)), "a\n" + line + "\nb")
    both = lines_and_chunks(mixed, 4, 8)
    assert set(alone["line_1"]) <= set(both["line_1"]) and set(alone["chunk"]) <= set(both["chunk"])


@pytest.mark.parametrize("text", ["", "\n", "123\n 4", "𝔘nicode\n𝟙𝟚"])
def test_lines_without_letters(text):
    found = lines_and_chunks([text], 8, 64)
    assert len(found["line_no"]) == sum(any(c.isalpha() for c in x) for x in text.split("\n"))
