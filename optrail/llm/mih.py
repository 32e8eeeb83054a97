"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .caps import usable
from .common import batch_of, bounded_sample, lean, lean_group, materialize, slices

#: Rows that rotations, thresholds and radii are fitted on at most: those of smallest hash of the key.
SAMPLE = 4096
#: Bits of a code, about; every rotation adds one for each dimension.
CODE_BITS = 256
#: Share of pairs of near vectors whose codes differ by no more than the radius allows, as measured in the sample.
SURE = 0.95
#: Rows of a bin of the index, about: a substring's place, the first bits of its value, and a block of a bin with more rows.
BIN_ROWS = 20_000

VECTORS = (("id", "long"), ("size", "int"), ("norm", "double"), ("raw", "binary"), ("query", "boolean"))
ENTRIES = (("place", "int"), ("top", "int"), ("id", "long"), ("h", "long"), ("code", "binary"), ("radius", "int"))
PAIRS = (("query_id", "long"), ("query_h", "long"), ("id", "long"), ("h", "long"))


def fit_rotations(x: np.ndarray, bits: int = CODE_BITS, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """Orthogonal rotations side by side, each turned until signs of rotated vectors are near the vectors themselves.

    The first starts from the principal axes, the others at random.
    """
    rng, size, out = np.random.default_rng(seed), x.shape[1], []
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(size))
    for k in range(math.ceil(bits / size)):
        turn, _ = np.linalg.qr(rng.normal(size=(size, size)))
        rotation = axes @ turn if k == 0 else turn
        for _ in range(rounds):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ rotation >= 0, 1.0, -1.0))
            rotation = u @ v
        out.append(rotation)
    return np.concatenate(out, 1)


class Codes:
    """Balanced bits of rotated vectors, in substrings of about log2(rows) bits."""

    def __init__(self, sample: np.ndarray, rows: int):
        rotations = fit_rotations(sample)
        self.part = max(4, min(16, round(math.log2(max(rows, 2)))))
        self.parts = max(1, min(CODE_BITS, rotations.shape[1]) // self.part)
        self.bits = self.part * self.parts
        self.rotations = rotations[:, : self.bits]
        self.middle = np.median(self.turned(sample), 0)
        self.weights = (1 << np.arange(self.part)[::-1]).astype(np.uint16)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotations

    def of(self, x: np.ndarray) -> np.ndarray:
        """One row of substrings for each vector."""
        bits = (self.turned(x) >= self.middle).astype(np.uint16)
        spare = self.bits - bits.shape[1]
        return np.pad(bits, ((0, 0), (0, spare))).reshape(len(x), self.parts, -1) @ self.weights


def near_in(radius: int, parts: int) -> np.ndarray:
    """Bits in which each substring may differ: by the pigeonhole principle codes within ``radius`` agree up to so many
    bits in one substring at least, radius // parts, or one less for those beyond radius % parts. Negative: none need be looked at."""
    return radius // parts - (np.arange(parts) > radius % parts).astype(int)


def probe(codes: np.ndarray, place: int, query: np.ndarray, radius: int) -> np.ndarray:
    """Rows within ``radius`` of the query that are found at this place of the index and at none before it.

    ``codes`` are sorted by the substring at the place: rows of one value are a bucket, and of the buckets that there are those
    within reach of the query's substring are read."""
    values, starts = np.unique(codes[:, place], return_index=True)
    return probe_buckets(codes, values, np.append(starts, len(codes)), place, query, radius)


def probe_buckets(codes: np.ndarray, values: np.ndarray, borders: np.ndarray, place: int, query: np.ndarray, radius: int) -> np.ndarray:
    near = near_in(radius, codes.shape[1])
    if near[place] < 0:
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(np.bitwise_count(values ^ query[place]) <= near[place])
    sizes = borders[hit + 1] - borders[hit]
    rows = np.repeat(borders[hit], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    apart = np.bitwise_count(codes[rows] ^ query)
    good = (apart.sum(1, dtype=np.uint16) <= radius) & (apart[:, :place] > near[:place]).all(1)
    return rows[good]


def angle_for(distance: float, norm: float, low: float, high: float) -> float:
    """The largest angle, as a share of the half circle, between vectors within ``distance`` of which one has norm ``norm`` and the other
    a norm between ``low`` and ``high``."""
    at = [low, high]
    if norm > distance and low < math.sqrt(norm**2 - distance**2) < high:
        at.append(math.sqrt(norm**2 - distance**2))
    cosine = min((norm**2 + x**2 - distance**2) / (2 * norm * x) for x in at)
    return math.acos(max(-1.0, min(1.0, cosine))) / math.pi


class Reach:
    """Radii, from the distance to which the sample says that a query must reach and what codes made of such distances there."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, codes: Codes, rows: int, k: int, low: float, high: float):
        self.sample, self.ids, self.bits, self.low, self.high = sample, ids, codes.bits, low, high
        expected = k * len(sample) / max(rows, 1)  # neighbours in the sample for k among all rows
        self.rank = k if len(sample) >= rows else math.ceil(expected + 2 * math.sqrt(expected))
        own = codes.of(sample)
        excess = []
        for i in range(0, len(sample), max(1, len(sample) // 256)):
            d = np.sqrt(((sample - sample[i]) ** 2).sum(1))
            d[ids == ids[i]] = np.inf
            near = np.argsort(d, kind="stable")[: max(self.rank, 3)]
            near = near[np.isfinite(d[near])]
            apart = np.bitwise_count(own[near] ^ own[i]).sum(1, dtype=int)
            excess += [a - self.bits * angle_for(float(x), float(np.linalg.norm(sample[i])), *[float(np.linalg.norm(sample[j]))] * 2) for a, x, j in zip(apart, d[near], near, strict=True)]
        self.slack = float(np.quantile(excess, SURE)) if excess else 0.0

    def radius(self, key: int, x: np.ndarray) -> int:
        d = np.sort(np.sqrt(((self.sample[self.ids != key] - x) ** 2).sum(1)))
        if len(d) < self.rank:
            return self.bits
        share = angle_for(float(d[self.rank - 1]), float(np.linalg.norm(x)), self.low, self.high)
        return max(0, min(self.bits, math.ceil(self.bits * share + self.slack)))


def vectors(df: DataFrame, key: str, vector: str, is_query: Column) -> DataFrame:
    """(VECTORS) rows that take part, packed in the vector's own precision."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    dtype = np.float32 if kind == "array<float>" else np.float64
    kept = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where("id is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v, q in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = np.array([np.nan if y is None else y for y in v.as_py()], dtype)
                if usable(x):
                    rows.append((i, x.itemsize * len(x), float(np.linalg.norm(x.astype(np.float64))), x.tobytes(), q))
            yield batch_of(rows, VECTORS)

    return kept.mapInArrow(lean(run), ", ".join(f"{n} {t}" for n, t in VECTORS))


def unpack(raws: list[bytes], dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1).astype(np.float64)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest other rows found, by Euclidean distance.

    Every row is indexed under each substring of its code; entries are shuffled by place and first bits of the substring, bins with many
    rows in blocks. A query goes to the bins within its reach, where buckets near its substring are read, and every code within the
    query's radius is found at one place alone; pairs found are then given their vectors and ranked by exact distance in double
    precision. A query with fewer than ``k`` pairs is asked again with a radius of all bits. Rotations, thresholds and radii are fitted on SAMPLE
    rows: a radius reaches as far as the query's neighbours among the sample say that ``k`` among all rows lie.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null key, take no
    part; vectors of different length are not compared; rows with equal key and vector are one, and different vectors of one key are
    candidates of their own, but never of a query with their key; of equal vectors of many keys only the smallest k + 1 keys can be
    answers, and only they are indexed; ties go to the smaller key; an empty table gives none. Other columns are ignored.
    """
    spark = df.sparkSession
    dtype = np.float32 if dict(df.dtypes)[vector] == "array<float>" else np.float64
    every = vectors(df, key, vector, is_query).groupBy("id", "raw", "size", "norm").agg(F.max("query").alias("query"))
    same = Window.partitionBy("raw").orderBy("id")
    rows = every.withColumn("nth", F.row_number().over(same)).where((F.col("nth") <= k + 1) | F.col("query"))
    rows = materialize(rows.select("id", "size", "norm", "raw", F.xxhash64("raw").alias("h"), "query", (F.col("nth") <= k + 1).alias("listed")), "vectors")
    facts = rows.groupBy("size").agg(F.sum(F.col("listed").cast("long")).alias("n"), F.sum(F.col("query").cast("long")).alias("queries"), F.min("norm").alias("low"), F.max("norm").alias("high")).collect()
    out = None
    for fact in facts:
        if fact["queries"]:
            found = candidates(rows.where(F.col("size") == fact["size"]), fact.asDict(), dtype, k)
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = rows.select(F.col("id").alias("query_id"), F.col("h").alias("query_h"), F.col("raw").alias("asked"))
    scored = out.join(rows.select("id", "h", "raw"), ["id", "h"]).join(own, ["query_id", "query_h"]).select("query_id", "id", "asked", "raw").mapInArrow(lean(distances(dtype)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def distances(dtype: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, vec_id, score) of pairs with both vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = np.array([len(x.as_py()) for x in batch.column(3)])
                score = np.zeros(batch.num_rows)
                for size in np.unique(lengths):
                    own = np.flatnonzero(lengths == size)
                    x, y = (unpack(batch.column(c).take(pa.array(own)).to_pylist(), dtype) for c in (2, 3))
                    score[own] = np.sqrt(((x - y) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def candidates(rows: DataFrame, fact: dict, dtype: type, k: int) -> DataFrame:
    """(PAIRS) of queries and listed rows of one length that the index finds; short queries are asked again over all bits."""
    sample = bounded_sample(rows.where("listed").select("id", "raw"), "id", fact["n"], SAMPLE, "fit").collect()
    base, ids = unpack([bytes(r.raw) for r in sample], dtype), np.array([r.id for r in sample])
    codes = Codes(base, fact["n"])
    reach = Reach(base, ids, codes, fact["n"], k, fact["low"], fact["high"])
    shared = rows.sparkSession.sparkContext.broadcast((codes, reach))
    top_bits = max(0, min(codes.part, math.ceil(math.log2(max(1, fact["n"] / BIN_ROWS)))))

    def coded(asking: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, far = shared.value
            for batch in slices(batches, 1 << 20):
                keys, marks, x = batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpack(batch.column(2).to_pylist(), dtype)
                found = own.of(x) if len(x) else []
                yield batch_of([(i, h, c.tobytes(), far.radius(i, v) if asking else None) for i, h, c, v in zip(keys, marks, found, x, strict=True)], (("id", "long"), ("h", "long"), ("code", "binary"), ("radius", "int")))

        return run

    ddl = "id long, h long, code binary, radius int"
    index = materialize(rows.where("listed").select("id", "h", "raw").mapInArrow(lean(coded(False)), ddl), "codes")
    asked = materialize(rows.where("query").select("id", "h", "raw").mapInArrow(lean(coded(True)), ddl), "queries")
    entries = index.mapInArrow(lean(spread(codes, top_bits)), ", ".join(f"{n} {t}" for n, t in ENTRIES))
    bins = materialize(entries.groupBy("place", "top").agg(F.ceil(F.count(F.lit(1)) / BIN_ROWS).cast("int").alias("blocks")), "bins")
    entries = entries.join(F.broadcast(bins) if codes.parts << top_bits <= 1 << 16 else bins, ["place", "top"]).withColumn("block", F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int")).drop("blocks")
    found = materialize(meet(entries, asked, bins, codes, top_bits), "pairs")
    short = asked.join(found.groupBy(F.col("query_id").alias("id"), F.col("query_h").alias("h")).agg(F.count(F.lit(1)).alias("n")), ["id", "h"], "left").where(F.coalesce("n", F.lit(0)) < min(k, fact["n"] - 1))
    short = materialize(short.select("id", "h", "code", F.lit(codes.bits).alias("radius")), "short")
    if short.isEmpty():
        return found
    return found.join(short.select(F.col("id").alias("query_id"), F.col("h").alias("query_h")), ["query_id", "query_h"], "left_anti").select(*found.columns).union(meet(entries, short, bins, codes, top_bits))


def spread(codes: Codes, top_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(ENTRIES): a row of the index at each place, or a query in each bin within its reach."""
    tops = np.arange(1 << top_bits, dtype=np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, code, radius in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own = np.frombuffer(code, np.uint16) >> np.uint16(codes.part - top_bits)
                if radius is None:
                    rows += [(j, t, i, h, code, None) for j, t in enumerate(own.tolist())]
                    continue
                for j, near in enumerate(near_in(radius, codes.parts).tolist()):
                    if near >= 0:
                        rows += [(j, t, i, h, code, radius) for t in tops[np.bitwise_count(tops ^ own[j]) <= near].tolist()]
            yield batch_of(rows, ENTRIES)

    return run


def meet(entries: DataFrame, asked: DataFrame, bins: DataFrame, codes: Codes, top_bits: int) -> DataFrame:
    """(PAIRS): queries against the bins that they reach."""
    asking = asked.mapInArrow(lean(spread(codes, top_bits)), ", ".join(f"{n} {t}" for n, t in ENTRIES)).join(bins, ["place", "top"])
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(table: pa.Table) -> pa.Table:
        radius = table.column("radius").to_numpy()
        place, asks = table.column("place")[0].as_py(), np.isfinite(radius)
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        ids, marks = table.column("id").to_numpy(), table.column("h").to_numpy()
        listed = np.flatnonzero(~asks)
        listed = listed[np.argsort(code[listed, place], kind="stable")]
        built, out = code[listed], []
        values, starts = np.unique(built[:, place], return_index=True)
        borders = np.append(starts, len(built))
        for q in np.flatnonzero(asks) if len(listed) else []:
            at = listed[probe_buckets(built, values, borders, place, code[q], int(radius[q]))]
            at = at[ids[at] != ids[q]]
            out.append((np.full(len(at), ids[q]), np.full(len(at), marks[q]), ids[at], marks[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[n for n, _ in PAIRS])

    return entries.unionByName(asking.select(entries.columns)).groupBy("place", "top", "block").applyInArrow(lean_group(run), ", ".join(f"{n} {t}" for n, t in PAIRS))
