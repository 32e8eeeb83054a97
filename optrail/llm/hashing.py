"""Vectorised 64-bit hashes of byte spans, words and shingles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: For a second hash of the same spans.
SECOND = np.random.default_rng(19770523).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of text that are hashed together; one longer text is hashed alone.
PART = 1 << 20


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size + 1, _MULTIPLIER, np.uint64), np.full(size + 1, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for at least ``size`` + 1 places."""
    return _powers(max(PART, 1 << size.bit_length()) if size > PART else PART)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes of any spans of a byte array in constant time each, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def parts(texts: list[bytes], most: int = PART) -> list[tuple[int, int]]:
    """Index ranges of texts of about ``most`` bytes together."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((begin, i))
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; a shorter text is one shingle, one without words has none."""
    lines = [b" ".join(words_of(t)) for t in texts]
    out: list[np.ndarray] = []
    for a, b in parts(lines):
        data = np.frombuffer(b"\n".join(lines[a:b]) + b"\n", np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = np.concatenate([[-1], np.flatnonzero(data[ends] == 10)])  # the last word of each text
        spans = SpanHash(data)
        whole = spans.spans(starts[: max(0, len(starts) - width + 1)], ends[width - 1 :]) if len(starts) >= width else np.zeros(0, np.uint64)
        for i in range(b - a):
            first, end = last[i] + 1, last[i + 1] + 1
            if not lines[a + i]:
                out.append(np.zeros(0, np.uint64))
            elif end - first < width:
                out.append(spans.spans(starts[first : first + 1], ends[end - 1 : end]))
            else:
                out.append(np.unique(whole[first : end - width + 1]))
    return out
