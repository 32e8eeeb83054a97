"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, lean, lean_group, materialize, others, private, schema_of, slices
from .hashing import PART, SECOND, SpanHash, parts

_GEAR = np.random.default_rng(977).integers(0, 1 << 16, 256, dtype=np.uint16)
#: Bits of the rolling hash that must be zero at a cut: bit b depends on the last b + 1 bytes, so cuts
#: depend on 16 bytes and come every 32 bytes on average.
CUT = np.uint16(0b1111_1000_0000_0000)
#: Chunks end after so many bytes at the latest, counted from the last cut by the hash.
LONGEST = 512
#: Bits of the filter of digests that occur more than once: its size is fixed whatever the input.
FILTER_BITS = 27
#: Bytes of packed digests that one group of buckets holds at most, roughly.
GROUP_BYTES = 8 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """The low 16 bits of h[i] = 2 * h[i - 1] + G[data[i]], by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    return h


def chunk_ends(text: bytes) -> np.ndarray:
    """Ends of a text's chunks. Cuts depend on the bytes before them alone, so an insertion moves only the cuts near it."""
    if not text:
        return np.zeros(0, np.int64)
    found = np.flatnonzero((gear(np.frombuffer(text, np.uint8)) & CUT) == 0) + 1
    ends = np.unique(np.concatenate([found, [len(text)]]))
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > LONGEST:
        ends = np.unique(np.concatenate([ends, *(np.arange(e - s + LONGEST, e, LONGEST) for e, s in zip(ends, sizes, strict=True) if s > LONGEST)]))
    return ends


def _cut(texts: list[bytes]) -> Iterator[tuple]:
    """(first text, ends of each text's chunks, starts and stops of all chunks in the joined bytes, number of each text's first chunk, the joined bytes)."""
    for a, b in parts(texts, PART):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        ends = [chunk_ends(t) for t in texts[a:b]]
        base = np.cumsum([0] + [len(t) for t in texts[a:b]])
        if not len(data):
            continue
        stops = np.concatenate([e + o for e, o in zip(ends, base, strict=False)])
        yield a, ends, np.concatenate([[0], stops[:-1]]), stops, np.cumsum([0] + [len(e) for e in ends]), data


def chunks_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the text, chunk ends, chunk digests) for each text that is not empty."""
    for a, ends, starts, stops, at, data in _cut(texts):
        digests = SpanHash(data).spans(starts, stops)
        for i, own in enumerate(ends):
            if len(own):
                yield a + i, own, digests[at[i] : at[i + 1]]


def units_of(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the text, places of units, and the two halves of their 128-bit digests) for each text with units: chunks with the one after them, of
    place 2 * p, so that a run of repeated units holds chunks that followed each other before; and chunks that reach ``least`` bytes
    alone, of place 2 * p + 1."""
    for a, ends, starts, stops, at, data in _cut(texts):
        last = np.zeros(len(stops), bool)
        last[at[1:][np.diff(at) > 0] - 1] = True
        pair, long = np.flatnonzero(~last), np.flatnonzero(stops - starts >= least)
        begin, end = np.concatenate([starts[pair], starts[long]]), np.concatenate([stops[pair + 1], stops[long]])
        digests, checks = SpanHash(data).spans(begin, end), SpanHash(data, SECOND).spans(begin, end)
        chunk = np.concatenate([pair, long])
        order = np.argsort(chunk, kind="stable")
        owner = np.searchsorted(at, chunk, "right") - 1
        place = (2 * (chunk - at[owner]) + (np.arange(len(chunk)) >= len(pair))).astype(np.uint32)[order]
        cuts, digests, checks = np.searchsorted(chunk[order], at), digests[order], checks[order]
        for i in range(len(ends)):
            own = slice(cuts[i], cuts[i + 1])
            if cuts[i] < cuts[i + 1]:
                yield a + i, place[own], digests[own], checks[own]


PACKED = (("bucket", "int"), ("digests", "binary"), ("checks", "binary"), ("docs", "binary"), ("places", "binary"), ("again", "binary"))


def _first_of(digests: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each digest once, with its smallest (doc, place) and whether it stands at more than one."""
    order = np.lexsort((places, docs, checks, digests))
    d, c, o, p = digests[order], checks[order], docs[order], places[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]) if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    other = np.zeros(len(d), bool)
    other[1:] = ~new[1:] & ((o[1:] != o[:-1]) | (p[1:] != p[:-1]))
    more = np.add.reduceat(other | again[order], at) > 0 if len(at) else np.zeros(0, bool)
    return d[at], c[at], o[at], p[at], more


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated_units(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(digest, check, first_doc, first_place) of every unit's digest that stands at more than one place."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(64, int(total / 32 * 29 / GROUP_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [x.as_py().encode() for x in batch.column(1)]
            found = list(units_of(texts, least))
            if not found:
                continue
            digests, checks = np.concatenate([d for _, _, d, _ in found]), np.concatenate([c for *_, c in found])
            owner = np.repeat(keys[[f[0] for f in found]], [len(f[1]) for f in found]).astype(np.int64)
            places = np.concatenate([f[1] for f in found])
            digests, checks, owner, places, again = _first_of(digests, checks, owner, places, np.zeros(len(digests), bool))
            bucket = (digests >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for k in range(buckets):
                own = order[cuts[k] : cuts[k + 1]]
                if len(own):
                    rows.append((k, digests[own].tobytes(), checks[own].tobytes(), owner[own].tobytes(), places[own].tobytes(), again[own].tobytes()))
            yield batch_of(rows, PACKED)

    def unite(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)
        d, c, o, p, more = _first_of(join("digests", np.uint64), join("checks", np.uint64), join("docs", np.int64), join("places", np.uint32), join("again", bool))
        return pa.table({"digest": _signed(d[more]), "check": _signed(c[more]), "first_doc": pa.array(o[more]), "first_place": pa.array(p[more].astype(np.int32))})

    packed = docs.select(F.col(key), F.col(text)).mapInArrow(lean(pack), ", ".join(f"{n} {t}" for n, t in PACKED))
    return materialize(packed.groupBy("bucket").applyInArrow(lean_group(unite), "digest long, check long, first_doc long, first_place int"), "chunks")


def digest_filter(digests: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bitmap of 2**bits bits in which each digest sets one: of fixed size, so it may be broadcast."""
    slice_bits = bits - 6

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(seen, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        size = (1 << slice_bits) >> 3
        yield batch_of([(k, seen[k * size : (k + 1) * size].tobytes()) for k in range(64) if seen[k * size : (k + 1) * size].any()], (("part", "int"), ("bits", "binary")))

    def both(table: pa.Table) -> pa.Table:
        merged = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([merged.tobytes()])})

    size = (1 << slice_bits) >> 3
    got = {r.part: bytes(r.bits) for r in digests.select("digest").mapInArrow(lean(mark), "part int, bits binary").groupBy("part").applyInArrow(lean_group(both), "part int, bits binary").collect()}
    return b"".join(got.get(k, bytes(size)) for k in range(64))


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 120) -> DataFrame:
    """``docs`` with later copies of repeated passages cut from ``text``; adds n_chunks, removed_bytes, spans and copied_from.

    Texts are cut into chunks whose borders follow the content. Of equal pairs of neighbouring chunks, the one in the
    smallest (key, place) stays; others go where copied pairs that share their chunks make up at least ``least`` bytes, cut back to
    whole words. ``spans`` are the removed byte ranges of the text in UTF-8; ``copied_from`` are the keys of the
    documents that keep what was removed. A document of which nothing is removed keeps its text as it is.

    Pairs are compared by 128-bit digests; a chunk of ``least`` bytes or more also counts alone. A null key or
    text takes no part and passes through; rows with equal key and text are one document and are all treated alike;
    rows with one key and different texts are compared with each other; an empty table gives none. Columns named
    like the added ones, in any case, give way, others pass through.
    """
    added = (("n_chunks", "int"), ("removed_bytes", "long"), ("spans", "array<struct<start:long,stop:long>>"), ("copied_from", "array<long>"))
    base = docs.select(*others(docs, *(n for n, _ in added)))
    keep = base.columns
    own_key, own_mark, own_copies = (private(base, n) for n in ("_k", "_mark", "_copies"))
    usable = base.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null and t <> ''")
    repeated = repeated_units(usable, "k", "t", least)
    bitmap = base.sparkSession.sparkContext.broadcast(digest_filter(repeated))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, p, d, c in units_of([x.as_py().encode() for x in batch.column(2)], least):
                at = d >> np.uint64(64 - FILTER_BITS)
                hit = np.flatnonzero(seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([_signed(d[hit]), _signed(c[hit]), pa.array(np.full(len(hit), keys[i])), pa.array(np.full(len(hit), marks[i])), pa.array(p[hit].astype(np.int32))], names=["digest", "check", "k", "mark", "place"])

    mark = F.xxhash64("t")
    found = usable.select("k", mark.alias("mark"), "t")
    held = found.mapInArrow(lean(suspects), "digest long, check long, k long, mark long, place int").join(repeated, ["digest", "check"]).where("first_doc <> k or first_place <> place")
    copies = held.groupBy("k", "mark").agg(F.collect_set(F.struct("place", "first_doc")).alias("copies"))
    marked = base.withColumn(own_key, F.col(key).cast("long")).withColumn(own_mark, F.xxhash64(F.col(text)))
    joined = marked.join(copies.toDF(own_key, own_mark, own_copies), [own_key, own_mark], "left").select(*others(base), own_copies)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch]):
                texts, n_chunks, removed, spans, sources = [], [], [], [], []
                for value, copies in zip(part.column(text).to_pylist(), part.column(own_copies).to_pylist(), strict=True):
                    raw = (value or "").encode()
                    ends = chunk_ends(raw)
                    gone, origin = removable(raw, ends, copies or [], least)
                    texts.append(value if not gone else without(raw, gone).decode())
                    n_chunks.append(len(ends))
                    removed.append(sum(b - a for a, b in gone))
                    spans.append([{"start": a, "stop": b} for a, b in gone])
                    sources.append(origin)
                columns = [part.column(c) if c != text else pa.array(texts, pa.string()) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_chunks, pa.int32()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(sources, pa.list_(pa.int64()))], names=[*keep, *(n for n, _ in added)])

    return joined.mapInArrow(lean(cut), schema_of(base, *added))


def removable(raw: bytes, ends: np.ndarray, copies: list[dict], least: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Byte ranges of runs of copied chunks that reach ``least`` bytes, cut back to whole words, and where they stay."""
    if not copies:
        return [], []
    first = {c["place"]: c["first_doc"] for c in sorted(copies, key=lambda c: (c["place"], -c["first_doc"]))}
    places = np.array(sorted({p // 2 + i for p in first for i in range(2 - p % 2)}))
    breaks = np.array([i for i, p in enumerate(places[:-1].tolist(), 1) if 2 * p not in first], int)
    gone, origin = [], set()
    for run in np.split(places, breaks):
        a, b = int(ends[run[0] - 1]) if run[0] else 0, int(ends[run[-1]])
        if b - a < least:
            continue
        while a < b and a and raw[a - 1] not in b" \t\n\r\x0b\x0c":
            a += 1
        while b > a and b < len(raw) and raw[b - 1] not in b" \t\n\r\x0b\x0c" and raw[b] not in b" \t\n\r\x0b\x0c":
            b -= 1
        if b > a:
            gone.append((a, b))
            units = [2 * p for p in run[:-1].tolist()] or [2 * int(run[0]) + 1]
            origin.update(first[u] for u in units)
    return gone, sorted(origin)


def without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])
