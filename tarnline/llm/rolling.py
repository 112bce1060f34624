"""Polynomial rolling hash and content-defined chunks over whole batches of texts."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

BASE_1 = 0x9E3779B97F4A7C15
BASE_2 = 0xC2B2AE3D27D4EB4F
MASK_64 = (1 << 64) - 1
DROP, OTHER, LETTER, BREAK = 0, 1, 2, 3


@functools.cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below size; base is odd, so it has an inverse."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        powers = np.ones(size, dtype=np.uint64)
        filled, step = 1, b & MASK_64
        while filled < size:
            take = min(filled, size - filled)
            powers[filled : filled + take] = powers[:take] * np.uint64(step)
            filled += take
            step = step * step & MASK_64
        out.append(powers)
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    room = 1 << max(10, (size - 1).bit_length())
    up, down = _powers(base, room)
    return up[:size], down[:size]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane: its kind, and its lower-case form (of one character)."""
    kind = np.full(0x10000, OTHER, dtype=np.uint8)
    lower = np.arange(0x10000, dtype=np.uint32)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if ch == "\n":
            kind[cp] = BREAK
        elif ch.isspace() or ch.isdecimal():
            kind[cp] = DROP
        elif ch.isalpha():
            kind[cp] = LETTER
        low = ch.lower()
        if len(low) == 1:
            lower[cp] = ord(low)
    return kind, lower


def kinds_and_lower(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind, lower = _tables()
    if codes.size and codes.max() < 0x10000:
        return kind[codes], lower[codes]
    near = np.minimum(codes, 0xFFFF)
    k, low = kind[near].copy(), lower[near].copy()
    for cp in np.unique(codes[codes >= 0x10000]).tolist():
        at, ch = codes == cp, chr(cp)
        k[at] = DROP if ch.isspace() or ch.isdecimal() else LETTER if ch.isalpha() or unicodedata.category(ch)[0] == "L" else OTHER
        low[at] = ord(ch.lower()) if len(ch.lower()) == 1 else cp
    return k, low


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64)
    x += np.uint64(1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _finish(x: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Stream:
    """The symbols of many texts in one array, hashed so that any span's fingerprint costs two look-ups."""

    def __init__(self, symbols: np.ndarray, base: int = BASE_1):
        up, self.down = powers(base, len(symbols) + 1)
        mixed = _mixed(symbols)
        mixed *= up[: len(symbols)]
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of symbols[start:end], the same wherever the same symbols stand."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return _finish(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


    def windows(self, width: int) -> np.ndarray:
        """The rolling hash of every run of ``width`` symbols, by where it starts."""
        if len(self.sums) <= width:
            return np.zeros(0, dtype=np.uint64)
        rolled = self.sums[width:] - self.sums[:-width]
        rolled *= self.down[: len(rolled)]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled >>= np.uint64(40)
        return rolled


def joined_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for each pair of keys, such as a source and a fingerprint."""
    return _finish(a.view(np.uint64) * np.uint64(BASE_2) ^ b.view(np.uint64)).view(np.int64)


def firsts(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key stands at its first place in its row."""
    by = np.lexsort((keys, rows))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (rows[by][1:] != rows[by][:-1]) | (keys[by][1:] != keys[by][:-1])
    out = np.zeros(len(by), dtype=bool)
    out[by] = new
    return out


def lines_and_chunks(texts: list[str], window: int, mean_chunk: int) -> dict[str, np.ndarray]:
    """Content-defined chunks of all texts, and their lines with a letter.

    Digits and white space, line breaks among it, are left out and letters are lowered first; ``mean_chunk`` is a
    power of two. A cut falls wherever the rolling hash of the last ``window`` symbols of a text meets the cut
    condition; a chunk lies between two cuts. So the chunks between the cuts of a line depend on the line alone,
    and stand in every text that holds it. A line that holds no whole chunk (fewer than two cuts) is one itself.

    Returns arrays: line_row, line_no (from 1), line_1, line_2 (128 bits of fingerprint), line_first (1 at the
    line's first place in its row); chunk_row, chunk (distinct in their row); and for each line in order its chunks
    from inner_from[line] on in ``inner``.
    """
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind, low = kinds_and_lower(codes)
    text_len = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text_start = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(text_len[:-1] + 1, out=text_start[1:])

    breaks = np.flatnonzero(kind == BREAK)
    line_from = np.concatenate(([0], breaks[:-1] + 1))
    row = np.searchsorted(text_start, line_from, side="right") - 1
    first_line = np.searchsorted(line_from, text_start)
    number = np.arange(len(line_from)) - first_line[row] + 1

    kept = (kind != DROP) & (kind != BREAK)
    has_letter = np.logical_or.reduceat(kind == LETTER, line_from) if len(line_from) else np.zeros(0, bool)
    place = np.zeros(len(codes) + 1, dtype=np.int32)
    np.cumsum(kept, out=place[1:], dtype=np.int32)
    symbols = low[kept]
    start, end = place[line_from].astype(np.int64), place[breaks].astype(np.int64)
    row_end = place[text_start + text_len].astype(np.int64)
    row_start = place[text_start].astype(np.int64)

    stream, other = Stream(symbols), Stream(symbols, BASE_2)
    keep = np.flatnonzero(has_letter)
    start, end, row, number = start[keep], end[keep], row[keep], number[keep]
    line_1, line_2 = stream.spans(start, end), other.spans(start, end)

    # Cuts of each text: the window ends before symbol ``cut`` and lies wholly in the text.
    cut = np.flatnonzero(stream.windows(window) & np.uint64(mean_chunk - 1) == 0) + window
    cut_row = np.searchsorted(row_end, cut - 1, side="right")
    inside = cut - window >= row_start[cut_row] if len(cut) else np.zeros(0, bool)
    cut, cut_row = cut[inside], cut_row[inside]
    whole = np.flatnonzero(cut_row[1:] == cut_row[:-1])
    chunk, chunk_row = stream.spans(cut[whole], cut[whole + 1]), cut_row[whole]
    rank = np.full(len(cut) + 1, -1, dtype=np.int64)
    rank[whole] = np.arange(len(whole))

    # Chunks between the cuts of each line whose windows lie in the line.
    first_cut = np.searchsorted(cut, start + window)
    n_inner = np.maximum(np.searchsorted(cut, end, side="right") - first_cut - 1, 0)
    size = np.maximum(n_inner, 1)
    inner_from = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(inner_from, size)
    inner = np.repeat(line_1, size)
    held = np.repeat(n_inner > 0, size)
    inner[held] = chunk[rank[(np.repeat(first_cut, size) + at)[held]]]
    short = np.flatnonzero(n_inner == 0)
    chunk_row, chunk = np.concatenate((chunk_row, row[short])), np.concatenate((chunk, line_1[short]))
    once = firsts(chunk_row, chunk)
    return {
        "line_row": row, "line_no": number, "line_1": line_1.view(np.int64), "line_2": line_2.view(np.int64),
        "line_first": firsts(row, line_1).astype(np.int64), "inner_from": inner_from, "inner": inner.view(np.int64),
        "inner_size": size, "chunk_row": chunk_row[once], "chunk": chunk[once].view(np.int64),
    }
