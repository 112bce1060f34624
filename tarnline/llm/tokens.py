"""Problem 6: encoding of a corpus with a public byte-level BPE vocabulary, by speculating and verifying."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Where the vocabulary files lie unless a path is given; they are read on the driver and broadcast.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: How byte_bpe_50k cuts text into words (the published pattern of this vocabulary).
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a worker keeps at most of the words and pairs it has met.
CACHE_ENTRIES = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file; its size is that of the file, about 50,000 entries."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact merging: always joins the leftmost pair of lowest rank, with a heap, so long words stay cheap."""
    n = len(word)
    end = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] - i != size:
            continue
        alive[j] = False
        end[i] = end[j]
        if end[i] < n:
            left[end[i]] = i
            if (r := ranks.get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]] - i))
        if (k := left[i]) >= 0 and (r := ranks.get(word[k : end[i]])) is not None:
            heapq.heappush(heap, (r, k, end[i] - k))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes words: greedy longest match proposes, pair checks verify, exact merging mends the rest."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.size = max(self.bytes_of) + 1
        self.words: dict[str, int] = {}  # the place of a word among the known ones
        self.ids = np.zeros(1024, dtype=np.int32)  # the ids of all known words, one after the other
        self.starts = np.zeros(1024, dtype=np.int64)  # where those of each word begin, and after the last where they end
        self.pairs = np.zeros(0, dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.exact_merges = 0

    def proposed(self, word: bytes) -> list[int]:
        out, at, n, ranks = [], 0, len(word), self.ranks
        while at < n:
            end = min(n, at + self.longest)
            while (r := ranks.get(word[at:end])) is None:
                end -= 1
            out.append(r)
            at = end
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of two tokens gives just those two; a key is left * size + right."""
        unique, back = np.unique(keys, return_inverse=True)
        place = np.searchsorted(self.pairs, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = place < len(self.pairs)
        known[inside] = self.pairs[place[inside]] == unique[inside]
        new = unique[~known]
        if len(new):
            verdict = np.fromiter((self._pair(int(k)) for k in new), dtype=bool, count=len(new))
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs, self.good = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
                return self.compatible(keys)
            pairs = np.concatenate((self.pairs, new))
            order = np.argsort(pairs)
            self.pairs, self.good = pairs[order], np.concatenate((self.good, verdict))[order]
            place = np.searchsorted(self.pairs, unique)
        return self.good[place][back]

    def _pair(self, key: int) -> bool:
        a, b = divmod(key, self.size)
        return merged(self.bytes_of[a] + self.bytes_of[b], self.ranks) == [a, b]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words not met before into ``self.words``."""
        raw = [w.encode("utf-8") for w in words]
        offers = [self.proposed(b) for b in raw]
        length = np.fromiter(map(len, offers), dtype=np.int64, count=len(offers))
        flat = np.fromiter((t for o in offers for t in o), dtype=np.int64, count=int(length.sum()))
        owner = np.repeat(np.arange(len(offers)), length)
        adjacent = owner[1:] == owner[:-1]
        ok = self.compatible((flat[:-1] * self.size + flat[1:])[adjacent]) if adjacent.any() else np.zeros(0, bool)
        failed = set(owner[1:][adjacent][~ok].tolist())
        for i in failed:
            self.exact_merges += 1
            offers[i] = merged(raw[i], self.ranks)
        if failed:
            length = np.fromiter(map(len, offers), dtype=np.int64, count=len(offers))
            flat = np.fromiter((t for o in offers for t in o), dtype=np.int64, count=int(length.sum()))
        known, used = len(self.words), int(self.starts[len(self.words)])
        if used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(flat)))
        if known + len(words) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (known + len(words) + 1))
        self.ids[used : used + len(flat)] = flat
        self.starts[known + 1 : known + len(words) + 1] = used + np.cumsum(length)
        self.words.update(zip(words, range(known, known + len(words))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        cut = _splitter()
        split = [cut(t) if t else [] for t in texts]
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        new = {w for s in split for w in s}.difference(self.words)
        if new:
            self.learn(list(new))
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        place = np.fromiter((self.words[w] for s in split for w in s), dtype=np.int64, count=int(n.sum()))
        start = self.starts[place]
        size = self.starts[place + 1] - start
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        return ends[np.concatenate(([0], np.cumsum(n)))].astype(np.int32), ids


_SPLIT = []


def _splitter():
    if not _SPLIT:
        _SPLIT.append(regex.compile(WORD_PATTERN).findall)
    return _SPLIT[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, ranks: Broadcast) -> Encoder:
    """The worker's encoder for a vocabulary: later tasks of the worker find the words that earlier ones learnt."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(ranks.value)
    return _ENCODERS[path]


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids ARRAY<INT>`` of every row's whole text, without special tokens.

    Empty and null texts have no tokens: their ids are the empty list. Repeated rows and ids each give a row.
    A proposal that passes the check of every adjacent pair equals the result of merging; words that fail are
    merged exactly. The vocabulary (bounded by its file) is broadcast; there is no shuffle.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, shared)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, ids = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["id", "ids"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
