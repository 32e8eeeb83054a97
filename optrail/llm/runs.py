"""Maximal repetitions ("runs") of words, from Lyndon arrays of both orders of the alphabet.

Every run of smallest period q starts a longest Lyndon word of length q, for one of two opposite orders of the words. So the
Lyndon arrays of both orders give all candidates, at most two for each place, and a candidate is a run if what matches to its left and right
at distance q is long enough. Arrays are made from right to left by comparing suffixes word by word. What such a comparison has matched is kept
and used again: by the next comparison of the same suffix, and by all comparisons at the same distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, slices

#: Shortest run that counts, in words; with twice the period this makes a run repeat WINDOW words at least.
LEAST, WINDOW = 12, 6
#: Bytes of text that are looked at together.
PART = 2 << 20


def lyndon_array(s: list[int]) -> tuple[list[int], list[int]]:
    """(next, match): where the next smaller suffix starts, the end for none, and how many words it has in common with the own one.

    Suffix i is compared with those on the way of next smaller suffixes from i + 1. If it matches j by a words and j matches next[j] by b,
    then for a <> b both the match of i and next[j] and which one is smaller follow; for a = b the comparison goes on after a
    words. ``seen`` holds, for each distance, the last match: a comparison that gets to its start jumps to its end.
    """
    n = len(s)
    nxt, match, seen = [n] * n, [0] * n, {}
    get = seen.get
    for i in range(n - 2, -1, -1):
        first, j, a = s[i], i + 1, 0
        while True:
            # from the first a words, which match, to all that match
            if a or first == s[j]:
                d = j - i
                k = i + a
                x, end = get(d, (n, n))
                if k < x:
                    top = min(n - d, x)
                    while k < top and s[k] == s[k + d]:
                        k += 1
                if x <= k < end:
                    k = end
                elif k >= end:
                    top = n - d
                    while k < top and s[k] == s[k + d]:
                        k += 1
                seen[d] = (i, k)
                a = k - i
                if j + a == n or s[k] > s[k + d]:
                    nxt[i], match[i] = j, a
                    break
            elif first > s[j]:
                nxt[i] = j
                break
            # suffix i is smaller than suffix j, and so than all up to next[j]
            while True:
                b, j = match[j], nxt[j]
                if j == n:
                    a = n
                    break
                if a < b:  # next[j] differs from i where j does
                    continue
                if a > b:
                    nxt[i], match[i] = j, b
                    a = n
                break
            if a == n:
                break
    return nxt, match


def runs_of(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs of at least ``least`` words, sorted."""
    n, found = len(s), set()
    for flip in (False, True):
        nxt, match = lyndon_array([-x for x in s] if flip else s)
        done: dict[int, int] = {}
        for i in range(n):
            j = nxt[i]
            p = j - i
            right = match[i]
            # a stretch that matches at distance p has to be p words long, and what it may have to the left is at most i
            if i + right < p or p + right + i < least or i < done.get(p, 0):
                continue
            k = i - 1
            while k >= 0 and s[k] == s[k + p]:
                k -= 1
            done[p] = i + right  # up to here the distance is known
            length = j + right - (k + 1)
            if length >= 2 * p and length >= least:
                found.add((k + 1, p, length))
    return sorted(found)


def numbered(groups: np.ndarray) -> np.ndarray:
    """Numbers for values, equal ones for equal values, in their order."""
    return np.unique(groups, return_inverse=True)[1].astype(np.int64)


def repeated(names: np.ndarray, texts: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words, at least 2, that occurs twice or more in its text.

    Windows are named by pairs of the names of shorter ones, so equal names are equal windows. ``texts`` are the texts' numbers, rising.
    """
    n = len(names)
    out = np.zeros(n, bool)
    if n < width:
        return out
    size, named = 1, names
    while size < width:
        step = min(size, width - size)
        count = len(named) - step
        named = numbered(named[:count] * (int(named.max()) + 1) + named[step : step + count])
        size += step
    inside = texts[: len(named)] == texts[width - 1 :]
    keys = texts[: len(named)] * (int(named.max()) + 1) + named
    kept = np.flatnonzero(inside)
    _, back, counts = np.unique(keys[kept], return_inverse=True, return_counts=True)
    starts = kept[counts[back] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return np.cumsum(cover[:n]) > 0


def stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of each stretch of true values of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def runs_in(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, period, length) of the runs of each text of words, by start, then period.

    A run of ``least`` words and two periods matches itself at distance q over least / 2 words or more, so each of its words lies in a window of
    that many words that occurs twice. Lyndon arrays are made of stretches of such words alone, which hold every run and what stops it.
    """
    numbers: dict[bytes, int] = {}
    names = np.array([numbers.setdefault(w, len(numbers)) for ws in texts for w in ws], np.int64)
    sizes = np.array([len(ws) for ws in texts], np.int64)
    mask = repeated(names, np.repeat(np.arange(len(texts)), sizes), min(WINDOW, least // 2))
    begin, out = 0, []
    for n in sizes.tolist():
        out.append(sorted((a + x, p, length) for a, b in stretches(mask[begin : begin + n], least) for x, p, length in runs_of(names[begin + a : begin + b].tolist(), least)))
        begin += n
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for x, p, length in runs:
        keep[x + p : x + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _find(batches: Iterator[pa.RecordBatch], least: int, edit: Callable[[int | None, list[bytes]], list[bytes]] | None) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in slices(batches, PART):
        texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        if edit:
            texts = [edit(k, ws) for k, ws in zip(batch.column(0).to_pylist(), texts, strict=True)]
        found = runs_in(texts, least)
        flat = [r for runs in found for r in runs]
        cells = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in (0, 2, 1)], fields=list(kind))
        ends = np.concatenate([[0], np.cumsum([len(runs) for runs in found], dtype=np.int64)]).astype(np.int32)
        left = [b" ".join(collapsed(ws, runs)) for ws, runs in zip(texts, found, strict=True)]
        sizes = pa.array([len(ws) for ws in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.ListArray.from_arrays(pa.array(ends), cells), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "text"])
        del texts, found, left
        give_back()


def find_runs(docs: DataFrame, least: int = LEAST, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, text) for each row of ``docs``: its runs of at least ``least`` words as (start, length, period) by start, then period, and
    its words without those that a run contains after the run's first period, joined by one space.

    ``edit`` may change the words of a document beforehand, given its id. Null texts count as empty; null ids are passed on; repeated rows give a row each; a
    very long text is looked at alone; an empty table gives none. Columns other than doc_id and text are ignored.
    """
    if least < 4:
        raise ValueError("runs have four words at least")
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(partial(_find, least=least, edit=edit)), schema)
