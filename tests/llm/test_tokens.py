import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnline.llm import tokens as T

PATH = f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    return T.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=T.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    offsets, flat = encoder.encode([text])
    return flat[offsets[0] : offsets[1]].tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text(alphabet="abcdefghijklmnopqrstuvwxyz ", max_size=120), st.text(alphabet="ha \n'0", max_size=60)))
def test_equals_the_public_encoder(text, ranks, reference):
    assert ids(T.Encoder(ranks), text) == reference.encode_ordinary(text)


def test_long_words_and_cache_limits(ranks, reference, monkeypatch):
    monkeypatch.setattr(T, "CACHE_ENTRIES", 3)
    encoder = T.Encoder(ranks)
    for text in ("h" * 20_000, "ha" * 9_000, "pneumonoultramicroscopicsilicovolcanoconiosis " * 3, "one two three four five six seven", "one"):
        assert ids(encoder, text) == reference.encode_ordinary(text)


def test_failing_words_are_merged(ranks, reference):
    encoder = T.Encoder(ranks)
    text = " ".join(f"{a}{b}ing{c}s" for a in ("un", "re", "xq") for b in ("believ", "start", "zor") for c in ("", "ly", "ne"))
    assert ids(encoder, text) == reference.encode_ordinary(text)
    assert encoder.exact_merges > 0  # and the greedy proposal alone would be wrong somewhere


def test_rows(spark, reference):
    rows = [(1, "Hello world"), (2, ""), (3, None), (3, " \n"), (4, "naïve 日本 🙂" * 500)]
    got = sorted((r.doc_id, r.ids) for r in T.token_ids(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "0 AS id")).collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t in rows)
    assert T.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0
