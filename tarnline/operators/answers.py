"""What follows an answer: citations, verification of tokens, extractive answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_refusal, sentences, squeezed, words


def cited_once(answers: DataFrame, key: str, answer: str, citations: str) -> DataFrame:
    """``key, place, document, page``: each (document, page) of an answer at its first place.

    Entries without a document or a page are left out, and a blank answer or a refusal cites nothing. The order is within an answer,
    whose list is short, so it is kept by an aggregate over the exploded entries.
    """
    kept = answers.where(~is_blank(F.col(answer)) & ~is_refusal(F.col(answer))).select(key, F.posexplode(citations).alias("pos", "c"))
    named = kept.where((F.coalesce(F.col("c.document"), F.lit("")) != "") & F.col("c.page").isNotNull())
    first = named.groupBy(key, F.col("c.document").alias("document"), F.col("c.page").alias("page")).agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return first.select(key, place.cast("long").alias("place"), "document", "page")


def titled(citations: DataFrame, manifest: DataFrame, doc: str) -> DataFrame:
    """``citations`` with ``title``: the manifest's, or the document's own name where it lists none."""
    titles = manifest.select(F.col("doc_id").alias(doc), "title")
    return citations.join(titles, doc, "left").withColumn("title", F.coalesce("title", doc))


def tokens_found(tokens: DataFrame, pages: DataFrame, key: str, doc: str, page: str, token: str, text: str = "text", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key, found``: whether the token stands on any piece of its page, case and white space apart.

    ``normal`` is put over both first, such as the compatibility form of ``functions.unicode.nfkc``.

    Pages are narrowed to the cited ones before their texts move; null and blank tokens are not found.
    """
    normal = normal or (lambda c: c)
    cited = tokens.select(key, F.col(doc).alias("_doc"), F.col(page).alias("_page"), F.lower(squeezed(normal(F.col(token)))).alias("_token"))
    keys = tokens.select(F.col(doc).alias("_doc"), F.col(page).alias("_page")).distinct()
    needed = pages.select(F.col("source_doc_id").alias("_doc"), F.col("page").alias("_page"), F.col(text).alias("_raw")).join(keys, ["_doc", "_page"], "left_semi")
    texts = needed.select("_doc", "_page", F.lower(squeezed(normal(F.col("_raw")))).alias("_text"))
    hits = cited.where(F.length("_token") > 0).join(texts, ["_doc", "_page"]).where(F.contains("_text", "_token"))
    found = hits.select(key).distinct().withColumn("found", F.lit(True))
    return tokens.select(key).join(found, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def best_sentence(asked: Column, text: Column, rank: Column) -> Column:
    """``n, r, p, s``: the sentence of a text that shares most words with ``asked``, the first of equals; the largest of several contexts is the best, by rank of equals."""
    scored = lambda s, i: F.struct(F.size(F.array_intersect(asked, words(s))).alias("n"), (-rank).alias("r"), (-i).alias("p"), s.alias("s"))
    return F.array_max(F.transform(sentences(text), scored))


def extracted(questions: DataFrame, contexts: DataFrame, key: str, question: str, text: str) -> DataFrame:
    """``key, sentence, overlap``: the sentence that shares most distinct words with the question, the earliest of equals.

    ``contexts`` has ``key, rank`` and the text; questions without a shared word give a null sentence.
    """
    asked = questions.select(key, F.array_distinct(words(F.col(question))).alias("_asked"))
    scored = contexts.join(asked, key).select(key, best_sentence(F.col("_asked"), F.col(text), F.col("rank")).alias("_best"))
    best = scored.groupBy(key).agg(F.max("_best").alias("_best"))
    picked = best.select(key, F.when(F.col("_best.n") > 0, F.col("_best.s")).alias("sentence"), F.col("_best.n").cast("long").alias("overlap"))
    return questions.select(key).join(picked, key, "left").select(key, "sentence", F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))
