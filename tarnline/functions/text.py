"""Column expressions over text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentence by which an answer declines; phrases that tell a refusal wherever they stand; phrases that
# tell one in a short answer only.
REFUSAL = "the provided context does not contain the answer"
REFUSAL_ANYWHERE = [
    "does not contain the answer", "not in the provided context", "cannot be determined from the context", "not contained in the provided context", "context does not contain",
]
REFUSAL_WHEN_SHORT = [
    "does not contain", "not in the context", "cannot determine", "cannot be determined", "not provided", "no information", "does not provide", "does not specify", "not available", "unable to answer", "not mentioned",
    "not found in",
]
SHORT_ANSWER = 150
SENTENCE_END = r"(?<=[.?!])\s+"


def squeezed(text: Column) -> Column:
    """Without any white space, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def stripped(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def is_refusal(answer: Column) -> Column:
    """Whether the whole answer is the refusal sentence, whatever its case, padding and final dots; null is none."""
    return F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s*\.*\s*$", "")) == REFUSAL


def refusal_class(answer: Column) -> Column:
    """``empty``, ``exact_refusal`` (the sentence stands in the answer), ``near_miss_refusal`` or ``attempt``."""
    low = F.lower(stripped(F.coalesce(answer, F.lit(""))))
    holds = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    return (
        F.when(low == "", "empty").when(F.contains(low, F.lit(REFUSAL)), "exact_refusal")
        .when(holds(REFUSAL_ANYWHERE) | ((F.length(low) < SHORT_ANSWER) & holds(REFUSAL_WHEN_SHORT)), "near_miss_refusal").otherwise("attempt")
    )


def sentences(text: Column) -> Column:
    """Sentences that are not blank, in order."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(r"\S"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def chunk_id(doc: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s-p%d-%d", doc, page, index)


def page_of_id(chunk: Column) -> Column:
    """The page in a chunk id, -1 if it has none."""
    digits = F.regexp_extract(chunk, r"-p(\d+)-", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def context_string(doc: Column, page: Column, text: Column) -> Column:
    """How a retrieved chunk stands in a prompt; a missing page or document is written as ``None``."""
    none = F.lit("None")
    head = F.concat(F.lit("[source_doc_id="), F.coalesce(doc, none), F.lit(" page="), F.coalesce(page.cast("string"), none), F.lit("]\n"))
    return F.concat(head, F.coalesce(text, F.lit("")))


def context_block(contexts: Column) -> Column:
    return F.when(F.size(contexts) > 0, F.array_join(contexts, "\n\n---\n\n")).otherwise(F.lit("(no context retrieved)"))


# Patterns of links, of targets with a scheme, and of commit hashes.
LINK = r"\]\(([^)\s]+)\)"
SCHEME = r"^[a-z][a-z0-9+.\-]*:"
HASH = r"(?<![0-9A-Za-z_])[0-9a-f]{7,40}(?![0-9A-Za-z_])"


def link_kind(target: Column) -> Column:
    """``fragment``, ``scheme`` or ``relative``; null for a null target."""
    return F.when(target.isNull(), None).when(target.startswith("#"), "fragment").when(target.rlike(SCHEME), "scheme").otherwise("relative")


def hash_tokens(text: Column) -> Column:
    """Distinct commit-like tokens, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(HASH), F.lit(0))))


def entry_name(text: Column, marker: str) -> Column:
    """What stands before the first ``marker``, with white space collapsed; null where the text has no marker."""
    head = F.substring_index(text, marker, 1)
    parts = F.filter(F.split(head, r"(?U)\s+"), lambda p: p != "")
    return F.when(F.contains(text, F.lit(marker)), F.array_join(parts, " "))
