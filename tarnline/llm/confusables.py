"""Problem 3: one consistent form for text that looks the same, by a confusables skeleton."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other alphabets that have the shape of a Latin letter, as pairs of strings of equal length.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXGQWYaesijopcyxhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
ARMENIAN = ("ՕՍՏԼոսհց", "OUSLnuhg")
COPTIC = ("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABHIKMNOPCTYXopc")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4VSLCPKB")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
#: Letters that resemble a Latin letter less closely; they count inside a word with several Latin letters only.
NEAR = ("νικρυγтвкмнпгɑɡıαӀ", "vikpuyTBKMHnragiaI")
# Hyphens that look like the ordinary one, and invisible characters outside the format category.
HYPHENS = "‐‑‒﹣－"
#: Signs with the very shape of an ordinary one; minus signs, dashes and dots that look different are not among them.
SIGNS = ("․∶∣∗∼∖", ".:|*~\\")
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Control characters that lay out a text.
LAYOUT = "\t\n\v\f\r\x85"
#: Kinds of compatibility forms that differ from the ordinary character in width, font or joining only.
FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Characters on either side in which a word of look-alikes alone may find company of its own alphabet.
CONTEXT = 24
# Ranges of characters that no table holds; a text of these alone is in its consistent form.
PLAIN = "\\t\\n\\r\\x20-\\x7E\\xA1-\\xAC\\xAE-\\u0131\\u0134-\\u0250\\u2013-\\u2023\\u2025-\\u2027\\u20A0-\\u20BF\\u2122\\u2153-\\u215F\\u2190-\\u2215\\u2218-\\u2222\\u2224-\\u2235\\u2237-\\u223B\\u223D-\\u22FF"


@functools.cache
def prototypes() -> dict[str, str]:
    """Characters that are replaced wherever they stand, from the rules of the character database."""
    out: dict[str, str] = {}
    for cp in (*range(0x20000), *range(0xE0000, 0xE1000)):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7B0:
            continue
        ch = chr(cp)
        category, form = unicodedata.category(ch), unicodedata.decomposition(ch)
        if cp < 0x80 and category != "Cc":
            continue
        if category == "Cf" or category == "Cc" and ch not in LAYOUT or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            out[ch] = ""
        elif category == "Zs":
            out[ch] = " "
        elif form.startswith(FORMS) or "LIGATURE" in unicodedata.name(ch, "") and form.startswith("<compat>"):
            out[ch] = unicodedata.normalize("NFKD", ch)
        elif form and form[0] != "<" and " " not in form and category[0] != "M":
            out[ch] = unicodedata.normalize("NFD", ch)  # the same letter under a second code
    out |= dict.fromkeys(INVISIBLE, "") | dict.fromkeys(HYPHENS, "-") | dict(zip(*SIGNS))
    return out


@functools.cache
def lookalikes() -> dict[str, str]:
    return {a: b for pair in (CYRILLIC, GREEK, ARMENIAN, COPTIC, CHEROKEE, LISU) for a, b in zip(*pair)}


@functools.cache
def _tools():
    everywhere = prototypes()
    exact = lookalikes()
    near = dict(zip(*NEAR))
    forced = str.maketrans(everywhere)
    foreign = re.compile("[" + "".join(map(re.escape, [*exact, *filter(_far, near)])) + "]")
    word = re.compile(r"[^\W_]+")
    latin = re.compile(r"[A-Za-zÀ-ɏ]")
    mark = re.compile("[̀-ͯ]")
    return everywhere, exact, near, forced, foreign, word, latin, mark


@functools.cache
def _odd_character():
    return re.compile(f"[^{PLAIN}]").search


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ")[0]


def _far(ch: str) -> bool:
    return ch > "\u024f" and ch.isalpha()


def _odd(word: str) -> list[str]:
    return list(filter(_far, word))


def _word_skeleton(word: str, around: str) -> str:
    """Look-alike letters of a word by their prototypes.

    They are replaced in a word that has Latin letters too, and in a word made of look-alikes alone unless a
    word close by is truly of their alphabet. In a word of another alphabet a Latin look-alike is brought home.
    """
    _, exact, near, _, _, _, latin, _ = _tools()
    odd = _odd(word)
    if not any(c in exact for c in odd):
        # near letters alone: several Latin letters carry the word; a sign before a few (ρgh, αmax) is a formula
        latins = sum(map(bool, map(latin.match, word)))
        if not odd or latins < (2 if any(map(_far, word[1:])) else 4) or len(odd) >= latins or any(c not in near for c in odd):
            return word
        return "".join(near.get(c, c) if _far(c) else c for c in word)
    own = {_script(c) for c in odd}
    true = [c for c in odd if c not in exact]
    latins = sum(map(bool, map(latin.match, word)))
    if latins:
        if len(own) == 1 and len(true) > latins:
            home = {v: k for k, v in exact.items() if _script(k) in own}
            return "".join(home.get(c, c) for c in word)
        return "".join(exact.get(c, near.get(c, c)) for c in word)
    if true:
        return "".join(exact.get(c, c) for c in word) if len(own) > 1 else word
    genuine = any(c not in exact and _script(c) in own for c in _odd(around))
    return word if genuine else "".join(exact[c] if c in exact else c for c in word)


def consistent(text: str) -> str:
    """The consistent form, composed: decompose, replace by prototypes, decompose again, compose."""
    if not _odd_character()(text):
        return unicodedata.normalize("NFC", text)
    _, _, _, forced, foreign, word, _, mark = _tools()
    text = unicodedata.normalize("NFD", text).translate(forced)
    if not text.isascii() and (foreign.search(text) or mark.search(text)):
        text = unicodedata.normalize("NFC", text)
        if foreign.search(text):
            out, at = [], 0
            for m in word.finditer(text):
                if not m[0].isascii():
                    near = text[max(0, m.start() - CONTEXT) : m.start()] + " " + text[m.end() : m.end() + CONTEXT]
                    out += [text[at : m.start()], _word_skeleton(m[0], near)]
                    at = m.end()
            text = "".join(out) + text[at:]
    return unicodedata.normalize("NFC", text)


def skeleton(text: str) -> str:
    """The comparison key: the consistent form, decomposed, without case and repeated white space."""
    return " ".join(unicodedata.normalize("NFD", consistent(text)).lower().split())


@F.pandas_udf(StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    return texts.map(consistent, na_action="ignore")


@F.pandas_udf(StringType())
def _skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


@F.pandas_udf(StringType())
def _key(texts: pd.Series) -> pd.Series:
    """The skeleton without white space."""
    return texts.map(lambda t: skeleton(t).replace(" ", ""), na_action="ignore")


def consistent_text(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` in the consistent form; null stays null and empty stays empty."""
    return df.withColumn(column, _consistent(F.col(column)))


def members(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """``field, row_id, skeleton, original``: each record with the key of its group of texts that look the same.

    ``original`` is a digest of the text and ``skeleton`` one of its consistent form, so a text that stands in the
    form of its group has both alike. Null texts are left out; each text is looked at once, where it lies, and only
    ids and digests come back.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = _odd_character()
        for batch in batches:
            forms = [consistent(t) if odd(t) else None for t in batch.column("text").to_pylist()]
            digests = [None if f is None else hashlib.md5(f.encode("utf-8", "surrogatepass")).hexdigest() for f in forms]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("original"), pa.array(digests, pa.string())], names=["row_id", "original", "skeleton"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("row_id"), F.md5(F.col(column)).alias("original"), F.col(column).alias("text")).where(F.col("text").isNotNull())
    found = rows.mapInArrow(grouped, f"row_id {kind}, original string, skeleton string")
    return found.select(F.lit(column).alias("field"), "row_id", F.coalesce("skeleton", "original").alias("skeleton"), "original")


def same_looking(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """``field, skeleton, n, forms, first``: the groups of texts that look the same, with the number of their records
    and of their distinct originals, and the first id; records are counted by original before their group meets."""
    forms = members(df, id_col, column).groupBy("field", "skeleton", "original").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    return forms.groupBy("field", "skeleton").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.min("first").alias("first"))


def changed_records(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """``field, row_id`` of the members that do not stand in the form of their group; null and blank texts are none."""
    return members(df, id_col, column).where(F.col("original") != F.col("skeleton")).select("field", "row_id")


def tokens_on_pages(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """``cand_id, found``: whether the token stands on its cited page once both are in skeleton form.

    Pages are narrowed to the cited ones before any text moves. Null and blank tokens are not found; a page that
    is missing gives False; the pieces of a page are tested one by one.
    """
    cited = tokens.select("cand_id", "source_doc_id", F.col("source_page").alias("page"), _key(F.col("key_value_token")).alias("token"))
    keys = tokens.select("source_doc_id", F.col("source_page").alias("page")).distinct()
    held = pages.select("source_doc_id", "page", "text").where(F.col("text").isNotNull()).join(keys, ["source_doc_id", "page"], "left_semi")
    texts = held.select("source_doc_id", "page", _key(F.col("text")).alias("text"))
    hits = (
        cited.where(F.length("token") > 0).join(texts, ["source_doc_id", "page"]).where(F.contains("text", "token"))
        .select("cand_id").distinct().withColumn("found", F.lit(True))
    )
    return tokens.select("cand_id").join(hits, "cand_id", "left").select("cand_id", F.coalesce("found", F.lit(False)).alias("found"))
