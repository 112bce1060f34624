"""Problem 2: broken question and answer pairs.

Language: posteriors of a character n-gram naive Bayes model trained on the labelled corpus texts. Truncation: the
likelihood that a text ends after its last words, from counts of words before sentence ends and elsewhere.
Empty, refusing and copying answers are told by their own words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, cut_lineage, key_filter, slices
from .rolling import DROP, LETTER, Stream, kinds_and_lower

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: Log posterior odds that a text must show against the question's language, so that bare values and names, which no
#: language claims by much, are none; and those of the question itself.
MIN_ODDS, MIN_QUESTION_ODDS = 20.0, 2.0
#: Share of the labelled texts from which a label is a language of the model; so there are at most 1 / rate of them.
LANGUAGE_RATE = 0.01
#: Least rate at which a text ends after its last words; below, the text is cut off.
MIN_END_RATE = 0.004
#: Evidence at which a pair of last words is trusted before the last word alone.
ENOUGH = 30

# Fillers that stand for no answer.
FILLERS = ["null", "none", "nil", "n/a", "na", "n.a.", "nan", "nul", "tbd", "todo", "undefined", "unknown", "empty", "k.a.", "s/o", "n/d", "s/d", "nd", "keine", "-"]

# Ways of declining in the four languages; each is a cue that the sentence gives no answer.
REFUSALS = [
    # English
    r"\b(?:i|we|i[’']m|i[’']ve|we[’']re)\b.{0,30}\b(?:can ?not|can[’']?t|could not|couldn[’']?t|unable|not able|not allowed|not permitted|won[’']?t|will not|do not|don[’']?t|did not|didn[’']?t|am not|decline|prefer not|rather not|have no|lack|refuse|regret)\b",
    r"\b(?:can ?not|can[’']?t|unable to|not able to|not possible to|impossible to|must decline to|decline to)\b.{0,30}\b(?:answer|help with|comment|respond|reply|discuss|tell|say|assist)",
    r"\b(?:does|do|did|is|are|was|were) ?(?:not|n[’']?t)\b.{0,30}\b(?:mention\w*|specif\w+|stated|address|discuss\w*|documented)\b",
    r"\bfalls? outside\b|\bout(?:side)? of (?:what|my|the) (?:i|scope|area|remit)|\bbeyond (?:my|the) (?:scope|knowledge)|\bas an? (?:language|ai|virtual|digital)\b.{0,12}\b(?:model|assistant|bot)",
    r"\bnothing\b.{0,50}\b(?:covers?|mentions?|says?|answers?|about this|on this|to say)\b|\bno (?:idea|clue|mention|indication|relevant)\b|\bunanswerable\b",
    # German
    r"\b(?:ich|wir|mir|uns)\b.{0,60}\b(?:nicht|nichts|keine?n?)\b|\b(?:lässt|läßt) sich\b.{0,40}\bnicht\b.{0,20}\b(?:sagen|beantworten|ermitteln|feststellen)",
    r"\b(?:seiten|quellen|dokumente?|auszüge|unterlagen|kontext|text)\b.{0,60}\b(?:nichts|nicht|keine)\b|\bkeine ahnung\b",
    # French
    r"\b(?:je|j[’']|nous|me|m[’']|nous)\b ?.{0,20}\b(?:ne|n[’']).{0,30}\b(?:pas|rien|aucune?|point)\b|\b(?:ne|n[’'])\s?(?:conti\w+|mentionn\w+|figur\w+|permet\w*|précis\w+|indiqu\w+|dit|disent|donn\w+)\b.{0,20}\b(?:pas|rien|aucune?)\b",
    r"\bpréf(?:ère|érons|érerais)\b.{0,12}\bne pas\b|\b(?:impossible|pas possible)\b.{0,25}\b(?:répondre|dire)\b|\bne pas (?:me|nous) prononcer\b|\baucune idée\b",
    # Spanish
    r"\bno (?:lo |la |me |te |le )?(?:puedo|podemos|sé|sabemos|tengo|tenemos|dispongo|disponemos|cuento|estoy|encuentro|encontré|conozco|quiero|deseo)\b|\bno (?:se )?(?:lo )?(?:conti?ene[n]?|mencionan?|consta|figura|aparece|dicen?|permiten?|es posible|indican?|especifican?|encuentr\w+)\b",
    r"\bno hay (?:datos?|información|respuesta|mención|nada|suficientes?)\b|\bprefiero no\b|\bpreferimos no\b|\bni idea\b|\bdesconozco\b",
]
# Sentences that accompany a refusal and say nothing else.
COURTESY = r"sorry|apolog|unfortunately|regret|désolé|desole|pardon|excus|regrett|malheureusement|lo siento|lamento|disculp|perdón|lamentablemente|leider|entschuldig|tut mir leid|bedau[e]?r|please (?:ask|contact|consult|refer)|bitte (?:fragen|wenden)|veuillez|por favor|consulte"
# Words about the question, its sources and the giving of answers, and words of lack and inability; a
# sentence with one of each is about answering and not an answer.
ABOUT_ANSWERING = (
    r"\b(?:answer(?:s|ed|ing)?|questions?|context|documents?|sources|excerpts?|passages?|fragments?|snippets?|retrieved|information|knowledge|topic|subject|request|query|respon[ds]\w*|reply|comment|assist|guidance|"
    r"antwort\w*|beantwort\w*|fragen?|kontext\w*|dokument\w*|quellen?|ausz[uü]g\w*|abschnitt\w*|unterlagen|textstellen?|angaben?|auskunft|informationen?|thema|"
    r"réponses?|répondre|questions?|contexte|documents?|extraits?|passages?|pages|informations?|renseignements?|sujet|prononcer|"
    r"respuestas?|responder|contestar|preguntas?|contexto|documentos?|fragmentos?|extractos?|fuentes?|páginas?|información|datos|tema|opinar)\b"
)
LACK = (
    r"\b(?:no|not|nothing|none|never|cannot|unable|without|lacks?|lacking|insufficient|enough|impossible|missing|outside|beyond|declin\w+|refus\w+|unclear|unknown|sorry|apolog\w+|unfortunately|fails? to|rather)\b|n[’']t\b|"
    r"\b(?:nicht|nichts|kein\w*|ohne|unmöglich|unzureichend|fehl\w+|leider|wenig|außerhalb|weder)\b|"
    r"\b(?:ne|pas|rien|aucune?|sans|impossible|insuffisant\w*|manqu\w+|faute|désolé\w*|hors|ignore|refuse)\b|\bn[’']|"
    r"\b(?:no|nada|ningun[ao]?|ningún|sin|imposible|insuficientes?|falta[n]?|lamento|siento|fuera|desconozco|ignoro|tampoco)\b"
)
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
_ABOUT, _LACK = re.compile(ABOUT_ANSWERING), re.compile(LACK)
_COURTESY = re.compile(COURTESY)
_WORD = re.compile(r"[^\W_]+(?:[’'][^\W_]+)*")
_PIECES = re.compile(r"(?<=[.!?…;])\s+")
SENTENCE_MARKS = np.array([ord(c) for c in ".!?…"], dtype=np.uint32)
#: Stands for every run of figures.
FIGURE = -1
#: A last figure is judged on a line of at least so many words, after a word; shorter ones are bare values.
FIGURE_WORDS = 5


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of all character n-grams of the letters and single spaces of texts; none crosses two texts."""
    joined = "".join(f" {t} \0" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind, low = kinds_and_lower(codes)
    edge = np.zeros(len(codes), dtype=bool)
    edge[np.cumsum([len(t) + 3 for t in texts], dtype=np.int64) - 1] = True
    symbols = np.where(kind == LETTER, low, np.uint32(32))
    kept = np.append(True, (symbols[1:] != 32) | (symbols[:-1] != 32) | edge[1:] | edge[:-1]) if len(symbols) else np.zeros(0, bool)
    symbols, edge = symbols[kept].astype(np.uint64), edge[kept]
    owner = np.cumsum(edge, dtype=np.int32) - edge
    owners, buckets = [], []
    rolled, whole = symbols, ~edge
    for n in GRAMS:
        if n > 1:
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + symbols[n - 1 :]
            whole = whole[:-1] & ~edge[n - 1 :]
        if not len(rolled):
            break
        at = np.flatnonzero(whole)
        mixed = rolled[at] + np.uint64(n)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[at])
        buckets.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return (np.concatenate(owners), np.concatenate(buckets)) if owners else (np.zeros(0, np.int32),) * 2


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of one text."""
    return grams_of([text])[1] if text else np.zeros(0, dtype=np.int64)


def posteriors(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Log posterior, up to a constant, of each language (rows) for each text (columns)."""
    owner, bucket = grams_of(texts)
    return np.stack([np.bincount(owner, weights=row[bucket], minlength=len(texts)) for row in model])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                counts = np.bincount(grams("\n".join(texts)), minlength=BUCKETS)
                totals[lang] = totals[lang] + counts if lang in totals else counts
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"]
        )


def language_model(corpus: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each n-gram bucket in each, counted over all labelled texts.

    Its size is at most ``BUCKETS`` / ``LANGUAGE_RATE`` numbers, whatever the corpus and its labels; rows without a
    label or a text are left out, and so are labels rarer than that rate.
    """
    rows = corpus.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    labels = corpus.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = labels.agg((F.sum("n") * LANGUAGE_RATE).alias("least"))
    usual = [r["lang"] for r in labels.crossJoin(F.broadcast(total)).where("n >= least").select("lang").collect()]
    rows = rows.where(F.col("lang").isin(usual)) if usual else rows.where("false")
    counted = rows.mapInArrow(_gram_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), table["bucket"].to_numpy(dtype=int)] = table["n"]
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True)) if langs else counts


#: How a word stands before what follows it on its line.
GOES_ON, ENDS, LINE_END = 0, 1, 2


def running_words(texts: list[str]) -> dict[str, np.ndarray]:
    """Words of all texts in order: their row, fingerprints of the word before and of the word, and what follows.

    Words are runs of letters, or of figures (all figures are one word); the word before is 0 after any sign. A
    word ENDS before a sentence mark, unless a letter or figure follows the mark at once. ``count`` is the number
    of words on the line.
    """
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind, low = kinds_and_lower(codes)
    figure = (codes >= 48) & (codes <= 57)
    form = np.where(kind == LETTER, 1, np.where(figure, 2, 0)).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], form, [0]))))
    start, end = edge[:-1], edge[1:]
    held = form[start] > 0
    start, end = start[held], end[held]
    word = Stream(low).spans(start, end).view(np.int64)
    word[form[start] == 2] = FIGURE
    break_at = np.flatnonzero(codes == 10)
    line = np.searchsorted(break_at, start)
    space = (kind == DROP) & ~figure | (codes == 10)
    solid = np.flatnonzero(~space)
    after = np.searchsorted(solid, end)
    nxt = np.where(after < len(solid), solid[np.minimum(after, len(solid) - 1)], len(codes) - 1) if len(solid) else np.zeros(len(end), np.int64)
    same = (after < len(solid)) & (np.searchsorted(break_at, nxt) == line)
    mark = np.isin(codes[nxt], SENTENCE_MARKS)
    beyond = form[np.minimum(nxt + 1, len(codes) - 1)] > 0
    follows = np.where(~same, LINE_END, np.where(mark & ~beyond, ENDS, GOES_ON))
    before = np.zeros(len(word), dtype=np.int64)
    if len(word) > 1:
        linked = (np.searchsorted(solid, start[1:]) == after[:-1]) & (line[1:] == line[:-1])
        before[1:][linked] = word[:-1][linked]
    text_end = np.cumsum([len(t) + 1 for t in texts])
    count = np.bincount(line, minlength=len(break_at))[line] if len(line) else line
    return {"row": np.searchsorted(text_end, start, side="right"), "before": before, "word": word, "follows": follows, "count": count, "letters": form[start] == 1}


def _ends(batches: Iterator[pa.RecordBatch], sought: KeyFilter | None) -> Iterator[pa.RecordBatch]:
    """Of each pair of neighbouring words: how often it stands, and how often before a sentence end.

    The last word of an unpointed line tells nothing, unless the line is a bare value of a few words. With
    ``sought`` only pairs whose second word passes it are counted.
    """
    for batch in batches:
        kept: list[tuple[np.ndarray, ...]] = []
        for part in slices(batch, "text"):
            w = running_words(part.column("text").to_pylist())
            use = (w["follows"] != LINE_END) | (w["count"] <= 4)
            if sought is not None:
                use &= sought.holds(w["word"])
            kept.append((w["before"][use], w["word"][use], w["follows"][use] != GOES_ON))
        if not kept:
            continue
        a, b, ended = (np.concatenate(x) for x in zip(*kept))
        if not len(a):
            continue
        order = np.lexsort((b, a))
        a, b, ended = a[order], b[order], ended[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        n = np.diff(np.append(first, len(a)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[first]), pa.array(b[first]), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat(ended.astype(np.int64), first))], names=["a", "b", "n", "ends"]
        )


def end_counts(texts: DataFrame, sought: KeyFilter | None = None) -> DataFrame:
    """``a, b, n, ends`` over all texts (column ``text``), partial counts before the shuffle.

    With ``sought`` (a bounded filter of last words) only pairs that end in such a word are counted.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sought)
    return (
        texts.where(F.col("text").isNotNull()).select("text").mapInArrow(lambda batches: _ends(batches, shared.value), "a long, b long, n long, ends long")
        .groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    )


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def is_empty(text: str | None) -> bool:
    """Null, blank, only punctuation, or a filler."""
    if text is None:
        return True
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", text.strip().lower())
    return not bare or bare in FILLERS or text.strip().lower() in FILLERS


def is_refusal(text: str) -> bool:
    """Every sentence declines or is a courtesy beside one that declines."""
    low = text.strip().lower()
    if not _LACK.search(low) and not _COURTESY.search(low):
        return False
    parts = [p for p in _PIECES.split(low) if _WORD.search(p)]
    declines = [bool(_REFUSAL.search(p) or (_ABOUT.search(p) and _LACK.search(p))) for p in parts]
    return any(declines) and all(d or (_COURTESY.search(p) and len(p) < 90) for d, p in zip(declines, parts)) or (
        bool(parts) and len(parts) <= 2 and all(_COURTESY.match(re.sub(r"^\W+", "", p)) and len(p) < 60 for p in parts)
    )


def is_copy(text: str, question: str) -> bool:
    """Nothing but the question's words in its order, once or more, or the greater part of them."""
    q, a = normal_words(question), normal_words(text)
    while a and a[0] in ("q", "question", "frage", "pregunta", "f", "p") and a[0] != (q[0] if q else ""):
        a = a[1:]
    if not q or not a or len(a) < 0.55 * len(q):
        return False
    if a == q:
        return True
    for start in range(0, len(a), len(q)):
        part = a[start : start + len(q)]
        at = 0
        missed = 0
        for w in part:
            try:
                at = q.index(w, at) + 1
            except ValueError:
                missed += 1
        if missed > 0.1 * len(part):
            return False
    return True


_SENTENCE_START = re.compile(r"[.!?…][\"”»)]*\s+(?=[^\W\d_a-zà-öø-ÿ])|\n")
_GERMAN_QUOTES = re.compile(r"„[^“”]*[“”]|»[^«»]*«")


def is_open(text: str) -> bool:
    """Whether the text ends inside a bracket or a quotation that began in its last sentence or 24 characters."""
    text = text.rstrip()
    start = max((m.end() for m in _SENTENCE_START.finditer(text)), default=0)
    end = _GERMAN_QUOTES.sub("", text[min(start, max(0, len(text) - 24)) :])
    return any(end.rfind(a) > end.rfind(b) for a, b in (("(", ")"), ("[", "]"), ("“", "”"), ("«", "»"), ("„", "“")))


_LAST_SIGN = re.compile(r"([^\w\s]|_)$")


def last_sign(text: str) -> str:
    """The sign that ends a text, without quotation marks after it; empty after a word."""
    found = _LAST_SIGN.search(text.rstrip().rstrip("\"”»").rstrip())
    return found[1] if found else ""


def other_language(questions: list[str], texts: list[str], model: np.ndarray) -> np.ndarray:
    """Whether each text speaks another language than its question, by the margins of both posteriors."""
    asked = list(dict.fromkeys(questions))
    place = {q: i for i, q in enumerate(asked)}
    of_question = posteriors(asked, model)
    best = of_question.argmax(axis=0)
    ranked = np.sort(of_question, axis=0)
    sure = ranked[-1] - ranked[-2] > MIN_QUESTION_ODDS
    at = np.fromiter((place[q] for q in questions), dtype=np.int64, count=len(questions))
    mine = posteriors(texts, model)
    theirs = best[at]
    return sure[at] & (mine.argmax(axis=0) != theirs) & (mine.max(axis=0) - mine[theirs, np.arange(len(texts))] > MIN_ODDS)


def _looked(part: pa.RecordBatch, langs: list[str], model: np.ndarray) -> pa.RecordBatch:
    """The defects of a slice of pairs that one look tells, and the last words of the others."""
    questions, texts = (part.column(c).to_pylist() for c in ("question", "text"))
    n = len(texts)
    defect: list[str | None] = [None] * n
    unsettled = []
    for i, (question, text) in enumerate(zip(questions, texts)):
        if is_empty(text):
            defect[i] = "empty"
        elif is_copy(text, question or ""):
            defect[i] = "copy"
        elif is_refusal(text):
            defect[i] = "refusal"
        else:
            unsettled.append(i)
    signs = {i: last_sign(texts[i]) for i in unsettled}
    for i in unsettled:
        if signs[i] and signs[i] not in ".!?…)]%°" or is_open(texts[i]):
            defect[i] = "truncated"
    spoken = [i for i in unsettled if defect[i] is None and questions[i]]
    if len(langs) > 1 and spoken:
        for i, other in zip(spoken, other_language([questions[i] for i in spoken], [texts[i] for i in spoken], model)):
            if other:
                defect[i] = "language"
    w = running_words([t or "" for t in texts])
    last = np.flatnonzero(np.append(w["row"][1:] != w["row"][:-1], True)) if len(w["row"]) else np.zeros(0, np.int64)
    running = (w["before"][last] != 0) & (w["count"][last] >= FIGURE_WORDS)
    ends = {int(w["row"][k]): k for k, ok in zip(last.tolist(), (w["letters"][last] | running).tolist()) if ok}
    ends = {i: k for i, k in ends.items() if i in signs and defect[i] is None and not signs[i]}
    a, b = ([int(w[c][ends[i]]) if i in ends else None for i in range(n)] for c in ("before", "word"))
    return pa.RecordBatch.from_arrays(
        [part.column("field"), part.column("row_id"), pa.array(defect, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["field", "row_id", "defect", "a", "b"]
    )


def pair_features(pairs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """Of each pair what one look at it tells; the ends of texts are judged later against the counts."""
    shared = pairs.sparkSession.sparkContext.broadcast((langs, model))  # bounded: languages x BUCKETS numbers

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _looked(part, *shared.value)

    return pairs.select("field", "row_id", "question", "text").mapInArrow(
        look, "field string, row_id long, defect string, a long, b long"
    )


def end_rate(pair_n: Column, pair_ends: Column, word_n: Column, word_ends: Column) -> Column:
    """Rate of ends after the last two words, leaning on that of the last word where the pair is rare."""
    zero = F.lit(0)
    word = (F.coalesce(word_ends, zero) + 0.0001) / (F.coalesce(word_n, zero) + 1)
    return (F.coalesce(pair_ends, zero) + word * ENOUGH) / (F.coalesce(pair_n, zero) + ENOUGH)


def broken_pairs(pairs: DataFrame, corpus: DataFrame, min_end_rate: float = MIN_END_RATE) -> DataFrame:
    """``field, row_id, defect`` of each defective pair.

    ``pairs`` has ``field, row_id, question, text``; ``corpus`` has ``text, lang`` and trains the language model
    and, with the pairs' own texts, the counts of ends. Defects are tried in the order empty, copy, refusal,
    truncated by sign, language, truncated by likelihood, so each case has one. A null question leaves only the
    defects that need none. Empty tables give an empty result. A figure at the end is judged in running text only,
    where the pair of the word before and a figure is seen 1 / min_end_rate times, by that pair's own rate.
    """
    langs, model = language_model(corpus)
    looked = cut_lineage(pair_features(pairs, langs, model))  # read three times below
    told = looked.where(F.col("defect").isNotNull()).select("field", "row_id", "defect")

    open_end = looked.where(F.col("defect").isNull() & F.col("b").isNotNull())
    texts = corpus.select("text").unionAll(pairs.select("text")).unionAll(pairs.select(F.col("question").alias("text")))
    near = cut_lineage(end_counts(texts, key_filter(open_end.select("b").distinct())))  # and a few pairs more, which no join meets
    by_word = near.groupBy("b").agg(F.sum("n").alias("word_n"), F.sum("ends").alias("word_ends"))
    judged = (
        open_end.join(near.withColumnsRenamed({"n": "pair_n", "ends": "pair_ends"}), ["a", "b"], "left").join(by_word, "b", "left")
        .withColumn("rate", end_rate(F.col("pair_n"), F.col("pair_ends"), F.col("word_n"), F.col("word_ends")))
    )
    figure = F.col("b") == FIGURE  # judged by its pair alone: any name may stand before a figure
    strange = ~figure & F.col("pair_n").isNull() & (F.col("word_n") >= ENOUGH) & (F.col("a") != 0)  # a fragment that happens to be a word
    often = (F.col("pair_n") * min_end_rate >= 1) & (F.coalesce("pair_ends", F.lit(0)) < F.col("pair_n") * min_end_rate)
    cut = judged.where(F.when(figure, often).otherwise((F.col("rate") < min_end_rate) | strange)).select("field", "row_id", F.lit("truncated").alias("defect"))
    return told.unionByName(cut)
