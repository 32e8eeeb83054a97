"""Byte-level BPE by monoid tree reduction: encode halves, join neighbours through growing boundary windows.

Two trees are reduced. A text is halved down to leaves of a few characters, whose nodes hold the pre-token matches with
their ids; a join scans a window around the border anew until a match ends where one of the right side ends. A match is
halved down to leaves of a few bytes; a join encodes a window of tokens around the border anew until the tokens beside the
window stay. The ids of a match depend on the match alone, so frequent matches are remembered, within a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import ARROW, bound_batches, lean, others, schema_of, slices

#: Characters of a text, and bytes of a match, that a leaf holds at most.
LEAF_CHARS, LEAF_BYTES = 512, 4
#: Characters behind a match's start that decide it even where it does not reach them.
LOOK = 3
#: Results that are remembered of each kind (matches, leaves, neighbouring tokens), and as many again of older ones.
KNOWN = 1 << 18
NO_RANK = 1 << 40

#: What ``encode_texts`` can add.
OUTPUTS = {"n_tokens": "bigint", "ids": "binary", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


class _Known(dict):
    """Results of ``work`` by key, worked out when first asked for. Beyond KNOWN the older ones are kept apart for as long again, and
    those of them that are asked for come back."""

    def __init__(self, work):
        self.work, self.old = work, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.work(key)
        if len(self) >= KNOWN:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Node:
    """The matches of a stretch of text as if it stood alone, and each match's packed ids."""

    __slots__ = ("ids", "pieces")

    def __init__(self, pieces: list[str], ids: list[bytes]):
        self.pieces, self.ids = pieces, ids


@lru_cache(maxsize=1)
def odd_characters() -> tuple[re.Pattern, dict[int, str]]:
    """Characters whose class differs between the pattern engine here and that of the tiktoken library, whose Unicode
    tables are of another year; and for each a character of the class that the library gives it."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    stand_in, odd = {}, set()
    for kind, common in ((r"\p{L}", "\u4e00"), (r"\p{N}", "\u0663"), (r"\s", "\u2003")):
        bare = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs, ours = set(bare.decode(bare.encode_ordinary(everything))), set(regex.findall(kind, everything))
        odd |= theirs ^ ours
        stand_in |= {ord(c): common for c in theirs - ours}
    stand_in = {ord(c): stand_in.get(ord(c), "\u00a7") for c in odd}
    return re.compile(f"[{ranges(odd)}]" if odd else r"(?!)"), stand_in


def is_plain(text: str) -> bool:
    """Whether a text's characters are all below 256, where all Unicode tables agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def ranges(characters: set[str]) -> str:
    """The inside of a class of ``characters``."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.bytes_of = ranks, [b""] * (1 + max(ranks.values()))
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.pattern, self.leaf_chars, self.leaf_bytes = regex.compile(pattern), leaf_chars, leaf_bytes
        self.packed, self.small, self.leaf, self.pair = (_Known(f) for f in (self.pack_piece, self.join_leaves, self.merge, self.merge_pair))
        self.odd, self.stand_in = odd_characters()
        self.joins = 0

    def matches(self, text: str, seen: str, start: int, stop: int) -> list[str]:
        if seen is text and not self.pattern.groups:
            return self.pattern.findall(text, start, stop)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(seen, start, stop)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers: leaves alone, then neighbours level by level."""
        if not text:
            return b""
        step, nodes = self.leaf_chars, []
        seen = text if is_plain(text) or not self.odd.search(text) else text.translate(self.stand_in)
        for i in range(0, len(text), step):
            pieces = self.matches(text, seen, i, i + step)
            nodes.append((i, Node(pieces, list(map(self.packed.__getitem__, pieces)))))
        while len(nodes) > 1:
            ends = [a for a, _ in nodes[2::2]] + [len(text)]
            joined = [(a, self.join(text, seen, left, right, border, end)) for (a, left), (border, right), end in zip(nodes[::2], nodes[1::2], ends, strict=False)]
            nodes = joined + nodes[2 * len(joined) :]
        return b"".join(nodes[0][1].ids)

    def join(self, text: str, seen: str, left: Node, right: Node, border: int, end: int) -> Node:
        """The node of both stretches together; ``right`` stands at border to end. ``left`` is built upon. ``seen`` is what
        the pattern is to see for ``text``.

        A left match is final if it ends before the border and starts LOOK characters before it; the scan
        goes on from the first other match, over a window that grows until a match ends where a match
        of the right side ends: from there on the scan of the right side alone holds.
        """
        self.joins += 1
        start, keep = border, len(left.pieces)
        while keep:
            begin = start - len(left.pieces[keep - 1])
            if start < border and begin <= border - LOOK:
                break
            keep, start = keep - 1, begin
        window, used = 32, None
        while used is None:
            stop, new, at, j, begin = min(end, border + window), [], border, 0, start
            for m in self.pattern.finditer(seen, start, stop):
                if stop < end and (m.end() >= stop or begin > stop - LOOK):
                    break
                new.append(text[begin : m.end()])
                begin = m.end()
                while at < begin:
                    at += len(right.pieces[j])
                    j += 1
                if at == begin:
                    used = j
                    break
            window *= 4
        left.ids[keep:] = map(self.packed.__getitem__, new)
        left.pieces[keep:] = new
        left.ids += right.ids[used:]
        left.pieces += right.pieces[used:]
        return left

    def pack_piece(self, piece: str) -> bytes:
        """Packed ids of one match: a token as it is, else halves, joined."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        return np.array(self.halves(raw), "<u4").tobytes() if len(raw) > 1024 else b"".join([i.to_bytes(4, "little") for i in self.halves(raw)])

    def halves(self, raw: bytes) -> list[int]:
        size = len(raw)
        if size <= 2 * self.leaf_bytes:
            return self.small[raw]
        half = size // 2
        return self.join_piece(self.halves(raw[:half]), self.halves(raw[half:]))

    def join_leaves(self, raw: bytes) -> list[int]:
        """A leaf, or two leaves joined."""
        if len(raw) <= self.leaf_bytes:
            return self.leaf[raw]
        half = len(raw) // 2
        return self.join_piece(self.leaf[raw[:half]], self.leaf[raw[half:]])

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of one match from the tokens of its two parts.

        Tokens are a match's encoding exactly if every two neighbours are the encoding of their bytes, so a
        window of tokens around the border is final once both its edges fit what stands outside.
        """
        self.joins += 1
        window, pair = 1, self.pair
        middle = pair[left[-1] << 32 | right[0]]
        if len(left) == len(right) == 1:
            return middle
        while True:
            a, b = len(left) - window, min(window, len(right))
            fits_left = a <= 0 or pair[left[a - 1] << 32 | middle[0]] == [left[a - 1], middle[0]]
            if fits_left and (b == len(right) or pair[middle[-1] << 32 | right[b]] == [middle[-1], right[b]]):
                return left[: max(0, a)] + middle + right[b:]
            window *= 2
            raw = b"".join(map(self.bytes_of.__getitem__, left[-window:] + right[:window]))
            middle = self.leaf[raw] if len(raw) <= 2 * self.leaf_bytes else self.merge(raw)

    def merge_pair(self, key: int) -> list[int]:
        return self.merge(self.bytes_of[key >> 32] + self.bytes_of[key & 0xFFFFFFFF])

    def merge(self, raw: bytes) -> list[int]:
        """Tokens of a window: of all neighbours those of least rank merge first, the leftmost of equals."""
        n, get = len(raw), self.ranks.get
        if n > 64:
            return self.merge_long([raw[i : i + 1] for i in range(n)])
        at = list(range(n + 1))
        found = [get(raw[i : i + 2], NO_RANK) for i in range(n - 1)]
        while found:
            least = min(found)
            if least == NO_RANK:
                break
            i = found.index(least)
            del at[i + 1], found[i]
            if i < len(found):
                found[i] = get(raw[at[i] : at[i + 2]], NO_RANK)
            if i:
                found[i - 1] = get(raw[at[i - 1] : at[i + 1]], NO_RANK)
        return [get(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]

    def merge_long(self, parts: list[bytes]) -> list[int]:
        """``merge`` with a heap, for windows that have grown."""
        ranks, n = self.ranks, len(parts)
        after, before, held = list(range(1, n + 1)), list(range(-1, n - 1)), list(parts)
        heap = [(r, i, x, y) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(x + y)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if held[i] != x or j >= n or held[j] != y:
                continue  # one of the two has merged since
            held[i], held[j] = x + y, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(held[a] + held[b])) is not None:
                    heapq.heappush(heap, (r, a, held[a], held[b]))
        return [ranks[x] for x in held if x]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: halves are decoded and concatenated up the tree."""
        if len(ids) <= 1 << 14:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_packed(self, packed: bytes) -> bytes:
        return self.decode(np.frombuffer(packed, "<u4").tolist())


@lru_cache(maxsize=1)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def load(path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeBpe:
    """The encoder of a vocabulary; a worker holds one."""
    return TreeBpe(ranks_of(path), pattern, leaf_chars)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Replace column ``text`` by ``outputs``: n_tokens long, ids binary (little-endian unsigned 32-bit integers), decoded
    binary (what the ids decode to), or lower-case hexadecimal SHA-256 of either. One pass does all of them.

    Null text counts as empty: no ids. Every other column is passed through (columns named like an output,
    in any case, give way); repeated rows are encoded alike; an empty table gives none. A text of any length
    is encoded whole; memory is that of one text and a slice of its batch.
    """
    bound_batches(docs.sparkSession)
    keep = others(docs, text, *outputs)
    both = "decoded" in outputs or "decoded_sha256" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern, leaf_chars)
        for part in slices(batches):
            found: dict[str, list] = {n: [] for n in OUTPUTS}
            for x in part.column(part.num_columns - 1):
                packed = bpe.encode_packed(x.as_py() or "")
                decoded = bpe.decode_packed(packed) if both else None
                for n in outputs:
                    found[n].append(len(packed) // 4 if n == "n_tokens" else packed if n == "ids" else decoded if n == "decoded" else hashlib.sha256(packed if n == "ids_sha256" else decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(found[n], ARROW[OUTPUTS[n]]) for n in outputs)], names=[*part.schema.names[:-1], *outputs])

    rows = docs.select(*keep)
    return docs.select(*keep, docs[text]).mapInArrow(lean(run), schema_of(rows, *((n, OUTPUTS[n]) for n in outputs)))


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add decoded binary, the bytes of the packed ids; null ids give null. Other columns are passed through (one named
    decoded, in any case, gives way); an empty table gives none."""
    bound_batches(encoded.sparkSession)
    keep = others(encoded, "decoded", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches):
            texts = [None if not x.is_valid else bpe.decode_packed(x.as_py()) for x in part.column(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    rows = encoded.select(*keep, encoded["ids"])
    return rows.mapInArrow(lean(run), schema_of(rows, ("decoded", "binary")))
