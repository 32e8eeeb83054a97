"""Embedding near-dedup by spherical-cap filters: structured random product codes and list decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, connected_components, lean, lean_group, materialize

#: Vectors that a filter is to hold, about: the number of filters follows from it and grows with the vectors, so that a vector meets as
#: many others whatever their number. A filter is a pair of code words, one of each half of the product code.
MEMBERS = 64
#: Code words in each half at least.
CODES = 16
#: Filters that a vector is expected to exceed, and lists at least; at a cosine of 0.93 two vectors then share about half as many.
LISTED = 32.0
#: Vectors of one filter that one block holds at most, roughly; every two blocks of a filter meet in a task.
BLOCK_VECTORS = 2000
#: Listed vectors that one task compares at a time, roughly.
GROUP_VECTORS = 20_000

FOUND = (("id", "long"), ("other", "long"), ("n", "long"))


@lru_cache(maxsize=4)
def product_code(size: int, codes: int = CODES, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation, and random unit code words for each half of the rotated vector."""
    rng = np.random.default_rng(seed + size)
    rotation, _ = np.linalg.qr(rng.normal(size=(size, size)))
    half = (size + 1) // 2
    words = [rng.normal(size=(codes, n)) for n in (half, max(1, size - half))]
    return rotation, *(w / np.linalg.norm(w, axis=1, keepdims=True) for w in words)


@lru_cache(maxsize=4)
def threshold(size: int, codes: int = CODES, listed: float = LISTED, seed: int = 5) -> float:
    """The sum of both halves' products that a random unit vector exceeds at ``listed`` filters on average."""
    x = np.random.default_rng(seed).normal(size=(300, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, first, second = product_code(size, codes)
    a, b = halves(x @ rotation, first, second)
    b, low, high = np.sort(b, axis=1), -2.0, 2.0
    for _ in range(40):
        t = (low + high) / 2
        exceeded = sum(float((codes - np.searchsorted(b[i], t - a[i])).sum()) for i in range(len(x))) / len(x)
        low, high = (t, high) if exceeded > listed else (low, t)
    return high


def codes_for(vectors: int) -> int:
    """Code words in each half for so many vectors that are compared with each other."""
    return max(CODES, math.ceil(math.sqrt(vectors * LISTED / MEMBERS)))


def halves(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first.shape[1]
    return x[:, :n] @ first.T, (x[:, n:] @ second.T if x.shape[1] > n else np.zeros((len(x), len(second))))


def list_decode(x: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that a unit vector exceeds, by row and filter.

    Code words of each half are tried from the best; a word of the first half whose product with
    the best of the second stays below the threshold ends the list, so work follows the list's length. A
    vector far from all filters would share none with its own copies: it lists its best LISTED instead.
    """
    step = max(8, (1 << 20) // (codes * 16))
    if len(x) > step:
        parts = [list_decode(x[i : i + step], codes) for i in range(0, len(x), step)]
        return np.concatenate([r + i * step for i, (r, _) in enumerate(parts)]), np.concatenate([f for _, f in parts])
    rotation, first, second = product_code(x.shape[1], codes)
    a, b = halves(x @ rotation, first, second)
    t = threshold(x.shape[1], codes)
    rows, words = np.nonzero(a + b.max(1, keepdims=True) >= t)
    hit = a[rows, words][:, None] + b[rows] >= t
    at, other = np.nonzero(hit)
    rows, filters = rows[at], words[at] * codes + other
    short = np.flatnonzero(np.bincount(rows, minlength=len(x)) < LISTED)
    if len(short):
        best = [np.argpartition(-(a[i][:, None] + b[i][None]).ravel(), int(LISTED))[: int(LISTED)] for i in short]
        kept = ~np.isin(rows, short)
        rows, filters = np.concatenate([rows[kept], np.repeat(short, int(LISTED))]), np.concatenate([filters[kept], *best])
        order = np.lexsort((filters, rows))
        rows, filters = rows[order], filters[order]
    return rows, filters


def usable(x: np.ndarray) -> bool:
    return x.size > 0 and bool(np.isfinite(x).all()) and bool((x != 0).any())


def vectors(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(id, g, size, raw) of every row; raw is the packed vector in its own precision, null where it takes no part."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    dtype = np.float32 if kind == "array<float>" else np.float64
    kept = df.select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.col(vector).cast(kind).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, g, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.array([np.nan if y is None else y for y in v.as_py() or ()], dtype)
                takes_part = i is not None and g is not None and usable(x)
                rows.append((i, g, x.itemsize * len(x), x.tobytes() if takes_part else None))
            yield batch_of(rows, (("id", "long"), ("g", "string"), ("size", "int"), ("raw", "binary")))

    return kept.mapInArrow(lean(run), "id long, g string, size int, raw binary")


def unit(raws: list[bytes], dtype: type) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pairs_in(x: np.ndarray, y: np.ndarray, at_x: list[np.ndarray], at_y: list[np.ndarray], own: int, least: float) -> np.ndarray:
    """Pairs (i, j) of cosine ``least`` or more whose smallest common filter is ``own``: each pair is counted at one filter."""
    i, j = np.nonzero(x @ y.T >= least - 1e-12)
    if not len(i):
        return np.zeros((0, 2), np.int64)
    exact = np.einsum("ij,ij->i", x[i], y[j]) >= least
    i, j = i[exact], j[exact]
    below = sorted({f for fs in (*at_x, *at_y) for f in fs[fs < own].tolist()})
    if below and len(i):
        place = {f: k for k, f in enumerate(below)}
        mark = [np.zeros((len(at), len(below)), np.float32) for at in (at_x, at_y)]
        for m, at in zip(mark, (at_x, at_y), strict=True):
            for row, fs in enumerate(at):
                m[row, [place[f] for f in fs[fs < own].tolist()]] = 1
        if len(i) * 20 > len(x) * len(y):
            seen = (mark[0] @ mark[1].T)[i, j]
        else:
            seen = np.einsum("ij,ij->i", mark[0][i], mark[1][j])
        i, j = i[seen == 0], j[seen == 0]
    return np.stack([i, j], 1)


def link_near(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", least: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links between vectors of one group by cosine.

    Equal vectors of a group become one row with a weight, and their links follow from it. Every vector is listed
    under all filters that it exceeds; vectors that share a filter are compared in double precision, each pair
    at its smallest common filter. Filters with many vectors are dealt to pairs of blocks; a task returns
    links counted for each vector and a spanning forest, never its pairs. Recall is that of sharing a filter:
    see the README for what was measured.

    Rows with a null key come back without links and with a null component; a null group, or a vector that
    is null, empty, zero or holds a null or non-finite component, links with nothing and is its own component;
    vectors of different length never meet; repeated rows count as separate vectors, and different vectors
    under one key are one node whose links add up; an empty table gives none. Other columns are ignored.
    """
    dtype = np.float32 if dict(df.dtypes)[vector] == "array<float>" else np.float64
    everything = materialize(vectors(df, key, vector, group), "vectors")
    taking = everything.where("raw is not null")
    reps = materialize(taking.groupBy("g", "size", "raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "representatives")

    codes = codes_for(reps.groupBy("g", "size").count().agg(F.max("count")).first()[0] or 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = table.column("size").to_numpy()
            for size in np.unique(sizes):
                part = table.filter(pa.array(sizes == size))
                for s in range(0, part.num_rows, 500):
                    piece = part.slice(s, 500).combine_chunks()
                    x = unit(piece.column("raw").to_pylist(), dtype)
                    rows, filters = list_decode(x, codes)
                    lists = [f.astype(np.int32).tobytes() for f in np.split(filters, np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])]
                    picked = piece.take(pa.array(rows))
                    columns = [picked.column(c).combine_chunks() for c in ("g", "size", "id", "weight", "raw")]
                    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(filters.astype(np.int32)), *columns, pa.array([lists[r] for r in rows], pa.binary())], names=["filter", "g", "size", "id", "weight", "raw", "lists"])

    listed = reps.select("g", "size", "id", "weight", "raw").mapInArrow(lean(deal), "filter int, g string, size int, id long, weight long, raw binary, lists binary")
    counts = materialize(listed.groupBy("filter", "g", "size").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK_VECTORS).cast("int")), "filters")
    groups = max(64, (counts.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0) // GROUP_VECTORS)
    large = counts.where("blocks > 1").select("filter", "g", "size", "blocks")
    dealt = (
        listed.join(large, ["filter", "g", "size"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("a", F.least("block", "with"))
        .withColumn("b", F.greatest("block", "with"))
        .withColumn("meeting", F.xxhash64("filter", "g", "size", "a", "b"))
        .withColumn("task", F.pmod("meeting", F.lit(groups)))
        .select("task", "meeting", "filter", "a", "b", "block", "id", "weight", "size", "raw", "lists")
    )

    def compare(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("id").to_numpy(), table.column("meeting").to_numpy()))
        meeting, own, a, b, block, ids, weight, size = (table.column(c).to_numpy()[order] for c in ("meeting", "filter", "a", "b", "block", "id", "weight", "size"))
        raws, lists = (np.array(table.column(c).to_pylist(), object)[order] for c in ("raw", "lists"))
        borders = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1], [True]]))
        rows: list[tuple] = []
        for s, e in zip(borders[:-1], borders[1:], strict=True):
            if e - s > 1:
                rows += meet(ids[s:e], weight[s:e], unit(raws[s:e].tolist(), dtype), [np.frombuffer(v, np.int32) for v in lists[s:e]], int(own[s]), block[s:e], int(a[s]), int(b[s]), least)
        return pa.Table.from_batches([batch_of(rows, FOUND)])

    found = materialize(dealt.groupBy("task").applyInArrow(lean_group(compare), "id long, other long, n long"), "found")
    linked = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    members = connected_components(found.where("other is not null").select("id", "other"), "id", "other")
    facts = reps.join(linked, "id", "left").join(members.withColumnRenamed("node", "id"), "id", "left").select("g", "size", "raw", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = everything.join(facts, ["g", "size", "raw"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def meet(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, lists: list[np.ndarray], own: int, block: np.ndarray, a: int, b: int, least: float) -> list[tuple]:
    """Links of one filter's vectors, all of block ``a`` against all of block ``b``: (id, null, links) and (id, other, 0) of a forest."""
    left, right = (np.arange(len(ids)),) * 2 if a == b else (np.flatnonzero(block == a), np.flatnonzero(block == b))
    links, root, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for s in range(0, len(left), 500):
        part = left[s : s + 500]
        pairs = pairs_in(x[part], x[right], [lists[i] for i in part], [lists[i] for i in right], own, least)
        pairs = np.stack([part[pairs[:, 0]], right[pairs[:, 1]]], 1)
        if a == b:
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        np.add.at(links, pairs[:, 0], weight[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], weight[pairs[:, 0]])
        while len(pairs := pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]):
            i, j = pairs[0]
            edges.append((int(ids[i]), int(ids[j]), 0))
            root[root == root[j]] = root[i]
    return [(int(ids[i]), None, int(links[i])) for i in np.flatnonzero(links)] + edges
