"""Clusterings of distinct traces on feature vectors (trace_id, features).

Equal vectors are one weighted point. Few points are collected and worked on where they are, by the same rules as more of them are by
Spark: k-means by passes that update all starts at once, Ward's agglomeration by rounds that merge all pairs of mutual nearest neighbours, and the silhouette
by sums over pairs of blocks. So neither the number of traces nor that of points has a bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from .features import aggregate_attributes, attribute_tokens, context_vectors, control_flow_tokens, enabled_tokens, standardised
from .paragraphs import paragraph_vectors

#: Different vectors that are collected at most, here and for Ward's agglomeration, whose work grows with their square; points of a block, of which pairs meet in a task, and rows of it that do so at a time;
#: blocks that many points are dealt to at least.
LOCAL, LOCAL_WARD, BLOCK, TILE, LEAST_BLOCKS = 20_000, 5000, 5000, 500, 16
#: Starts of k-means, of which the best by cost is kept, and passes at most.
STARTS, PASSES = 10, 50


def points_of(vectors: DataFrame) -> DataFrame:
    """(pid, features, w): the different vectors, named by their smallest trace, and how many traces have each."""
    points = vectors.groupBy("features").agg(F.min("trace_id").alias("pid"), F.count(F.lit(1)).alias("w"))
    return written(points.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "pid"), "points")  # passes over them keep all cores at work


def labelled(vectors: DataFrame, points: DataFrame, labels: DataFrame) -> DataFrame:
    """(trace_id, group_id) from (pid, label) of points; groups are numbered by their smallest point."""
    order = {r.label: str(i) for i, r in enumerate(labels.groupBy("label").agg(F.min("pid").alias("first")).orderBy("first").collect())}
    names = F.create_map(*(F.lit(x) for pair in order.items() for x in pair)) if order else F.create_map().cast("map<bigint,string>")
    named = points.join(labels, "pid").select("features", names[F.col("label")].alias("group_id"))
    return vectors.join(named, "features").select("trace_id", "group_id")


def on_driver(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, vectors and weights of points that are known to be few, by name."""
    rows = points.select("pid", "features", "w").orderBy("pid").collect()
    return np.array([r.pid for r in rows], np.int64), np.array([r.features for r in rows], float), np.array([r.w for r in rows], float)


# k-means


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest centre, the first of equals, and the squared distance; centres are (starts, k, size)."""
    starts, k, size = centers.shape
    d = (x * x).sum(1)[:, None, None] + (centers * centers).sum(2)[None] - 2 * (x @ centers.reshape(-1, size).T).reshape(-1, starts, k)
    at = d.argmin(2)
    return at.T, np.maximum(np.take_along_axis(d, at[..., None], 2)[..., 0], 0).T


def gathered(x: np.ndarray, w: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted sums of the vectors of each centre, and as the last number of each start's the cost: (starts, k, 1 + size), (starts)."""
    at, d = nearest(x, centers)
    out = np.zeros((*centers.shape[:2], 1 + x.shape[1]))
    for s in range(len(centers)):
        hot = np.zeros((len(x), centers.shape[1]))
        hot[np.arange(len(x)), at[s]] = w
        out[s, :, 0] = hot.sum(0)
        out[s, :, 1:] = hot.T @ x
    return out, (d * w).sum(1)


def best_centers(points: DataFrame, n: int, ks: list[int], seed: int = 0, local: int = LOCAL) -> list[np.ndarray]:
    """For each number of groups, of which none is above the number ``n`` of points, the centres of the best start. All are updated in one pass, but
    those that stand still: a start is left out from then on, a number of groups once all its starts do."""
    draw = F.array(*(F.xxhash64(F.lit(seed), F.lit(i), "pid") for i in range(STARTS)))  # a start's centres are the points of smallest draw
    if n <= local:
        rows = points.select("pid", "features", "w", draw.alias("draw")).orderBy("pid").collect()
        pids, x, w, draws = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, float, float, np.int64)))
        first = [x[np.lexsort((pids, draws[:, i]))[: max(ks)]] for i in range(STARTS)]
        gather = lambda asked: [gathered(x, w, c) for c in asked]
    else:
        first = [np.array([r.features for r in rows], float) for rows in _first_points(points, draw, max(ks))]
        gather = lambda asked: _gather(points, asked)
    centers = [np.stack([f[:k] for f in first]) for k in ks]
    cost, going = [np.full(STARTS, np.inf) for _ in ks], [np.ones(STARTS, bool) for _ in ks]
    for _ in range(PASSES):
        open_ = [i for i in range(len(ks)) if going[i].any()]
        if not open_:
            break
        for i, (sums, paid) in zip(open_, gather([centers[i][going[i]] for i in open_]), strict=True):
            at, filled = np.flatnonzero(going[i]), sums[..., :1] > 0
            moved = np.where(filled, sums[..., 1:] / np.where(filled, sums[..., :1], 1), centers[i][at])
            going[i][at] = np.abs(moved - centers[i][at]).max((1, 2)) >= 1e-9
            centers[i][at], cost[i][at] = moved, paid
    return [c[int(np.argmin(paid))] for c, paid in zip(centers, cost, strict=True)]


def _first_points(points: DataFrame, draw, k: int) -> list[list]:
    """Of each start the ``k`` points of smallest draw: few of each task, then few of all."""

    def run(batches):
        import pandas as pd

        kept = None
        for pdf in batches:
            kept = pdf if kept is None else pd.concat([kept, pdf])
            order = [np.lexsort((kept["pid"], [h[i] for h in kept["h"]]))[:k] for i in range(STARTS)]
            kept = kept.iloc[np.unique(np.concatenate([*order, np.zeros(0, int)]))]
        if kept is not None:
            yield kept

    rows = points.select("pid", "features", draw.alias("h")).mapInPandas(run, "pid long, features array<double>, h array<long>").collect()
    return [sorted(rows, key=lambda r: (r.h[i], r.pid))[:k] for i in range(STARTS)]


def with_labels(points: DataFrame, centers: list[np.ndarray]) -> DataFrame:
    """``points`` with ``labels``, the nearest of each of several sets of centres."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column("features"))
            labels = np.stack([nearest(x, c[None])[0][0] for c in centers], 1).astype(np.int32)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(centers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, labels.ravel())], names=["pid", "features", "w", "labels"])

    return written(points.select("pid", "features", "w").mapInArrow(run, "pid long, features array<double>, w long, labels array<int>"), "labels")


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def kmeans(vectors: DataFrame, k: int, seed: int = 0, local: int = LOCAL) -> DataFrame:
    """(trace_id, group_id) by k-means from random points; k is cut to the number of different vectors. An empty group keeps its centre."""
    points = points_of(vectors)
    n = points.count()
    k = max(1, min(k, n))
    if k < 2:
        return vectors.select("trace_id", F.lit("0").alias("group_id"))
    known = with_labels(points, best_centers(points, n, [k], seed, local))
    return labelled(vectors, points, known.select("pid", F.get("labels", F.lit(0)).cast("long").alias("label")))


def _gather(points: DataFrame, asked: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``gathered`` for several sets of centres over all points in one pass; each task sends one number for each start, centre and column."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            found = [gathered(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float), c) for c in asked]
            flat = np.concatenate([part.ravel() for pair in found for part in pair])
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["slot", "v"])

    sizes = [(c.shape[0] * c.shape[1] * (1 + c.shape[2]), len(c)) for c in asked]
    flat = np.zeros(sum(map(sum, sizes)))
    for r in points.select("features", "w").mapInArrow(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect():
        flat[r.slot] = r.v
    out, at = [], 0
    for c, (many, starts) in zip(asked, sizes, strict=True):
        out.append((flat[at : at + many].reshape(*c.shape[:2], 1 + c.shape[2]), flat[at + many : at + many + starts]))
        at += many + starts
    return out


# Ward


def ward_merges(names: np.ndarray, x: np.ndarray, w: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of all merges by nearest-neighbour chains over centroids, each behind those it builds upon; a, the smaller name, stands for both. No table of distances is held."""
    names, center, size, alive = names.copy(), x.astype(float), w.astype(float), np.ones(len(x), bool)
    merges, chain = [], []
    for left in range(len(x), 1, -1):
        if not chain and 2 * left < len(names):  # those that are gone need not be looked at any more
            names, center, size, alive = names[alive], center[alive], size[alive], np.ones(left, bool)
        while True:
            if not chain:
                chain.append(int(np.flatnonzero(alive)[0]))
            i = chain[-1]
            d = ((center - center[i]) ** 2).sum(1) * size * size[i] / (size + size[i])
            d[~alive] = np.inf
            d[i] = np.inf
            j = int(np.argmin(d))
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                break
            chain.append(j)
        a, b = sorted(chain[-2:])
        merges.append((float(d[chain[-2]]), int(names[a]), int(names[b])))
        center[a] = (center[a] * size[a] + center[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        chain = chain[:-2]
    return merges


def blocks_of(n: int, block: int) -> int:
    """Into how many blocks points are dealt: a block holds ``block`` of them at most, about, and of many there are enough for their pairs to keep all cores at work."""
    return max(1, -(-n // block), min(LEAST_BLOCKS, n // 1000))


def in_pairs(points: DataFrame, blocks: int) -> DataFrame:
    """Points with their own block and the pair (i, j) of blocks that they are sent to, pairs dealt to tasks of their own."""
    mine = points.withColumn("own", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int"))
    sent = mine.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    return sent.select(*mine.columns, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).repartition(blocks * (blocks + 1) // 2, "i", "j")


def cheapest(x: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the place in ``y`` that costs least to merge with, the first of equals, and the cost; ``same`` if both are one table, where none is its own.

    Products tell which rows come into question, and only of these the costs are worked out, by differences, not products, so that equal distances come out
    equal in any block.
    """
    at, cost = np.zeros(len(x), int), np.full(len(x), np.inf)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 1e-11 * (xx.max() + yy.max())
    for first in range(0, len(x), TILE):
        u, mass = x[first : first + TILE], v[first : first + TILE]
        share = mass[:, None] * w[None] / (mass[:, None] + w[None])
        near = (xx[first : first + TILE, None] + yy[None] - 2 * (u @ y.T)) * share
        if same:
            near[np.arange(len(u)), first + np.arange(len(u))] = np.inf
        least = near.min(1)
        r, c = np.nonzero((near <= (least + 2 * slack * mass)[:, None]) & (near < np.inf))
        if not len(r):
            continue
        d = np.zeros(len(r))
        for i in range(x.shape[1]):
            d += (u[r, i] - y[c, i]) ** 2
        d *= share[r, c]
        begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        best = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.append(begin, len(r))))
        hit = np.flatnonzero(d == best)
        rows, place = np.unique(r[hit], return_index=True)
        at[first + rows], cost[first + rows] = c[hit[place]], d[hit[place]]
    return at, cost


def neighbours(clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pid, other, cost): the cheapest cluster to merge each with, of equals the pair of smallest names. Blocks of clusters meet in pairs, one pair a task."""
    sent = in_pairs(clusters.select("pid", "features", "w"), blocks_of(clusters.count(), block))

    def meet(key, pdf):
        import pandas as pd

        left, right = (pdf[pdf["own"] == k].sort_values("pid") for k in key)
        if not len(left) or not len(right):
            return pd.DataFrame({"pid": [], "lo": [], "hi": [], "cost": []})
        x, y, p, q = np.stack(left["features"]), np.stack(right["features"]), left["pid"].to_numpy(), right["pid"].to_numpy()
        v, w = left["w"].to_numpy(float), right["w"].to_numpy(float)
        at, cost = cheapest(x, v, y, w, key[0] == key[1])
        rows = [pd.DataFrame({"pid": p, "other": q[at], "cost": cost})]
        if key[0] != key[1]:
            at, cost = cheapest(y, w, x, v, False)
            rows.append(pd.DataFrame({"pid": q, "other": p[at], "cost": cost}))
        out = pd.concat(rows)
        return pd.DataFrame({"pid": out["pid"], "lo": out[["pid", "other"]].min(axis=1), "hi": out[["pid", "other"]].max(axis=1), "cost": out["cost"]})

    met = sent.groupBy("i", "j").applyInPandas(meet, "pid long, lo long, hi long, cost double")
    best = met.where(F.col("cost") < float("inf")).groupBy("pid").agg(F.min(F.struct("cost", "lo", "hi")).alias("m"))
    return best.select("pid", F.when(F.col("m.lo") == F.col("pid"), F.col("m.hi")).otherwise(F.col("m.lo")).alias("other"), F.col("m.cost").alias("cost"))


def merge_round(clusters: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The merges (a, b, cost) of all pairs that are each other's neighbours, and the clusters after them. Among the pairs of least cost one always is, so each round merges some."""
    near = written(neighbours(clusters, block), "neighbours")
    back = near.select(F.col("pid").alias("b"), F.col("other").alias("a"))
    pairs = written(near.where("pid < other").select(F.col("pid").alias("a"), F.col("other").alias("b"), "cost").join(back, ["a", "b"]), "merges")
    gone = clusters.join(pairs.select(F.col("b").alias("pid"), "a"), "pid").select(F.col("a").alias("pid"), F.col("features").alias("f"), F.col("w").alias("v"))
    rest = clusters.join(pairs.select(F.col("b").alias("pid")), "pid", "left_anti").join(gone, "pid", "left")
    center = F.zip_with("features", "f", lambda x, y: (x * F.col("w") + y * F.col("v")) / (F.col("w") + F.col("v")))
    after = rest.select("pid", F.when(F.col("f").isNull(), F.col("features")).otherwise(center).alias("features"), (F.col("w") + F.coalesce("v", F.lit(0))).alias("w"))
    return pairs, written(after, "clusters")


def ward(vectors: DataFrame, k: int, local: int = LOCAL_WARD, block: int = BLOCK) -> DataFrame:
    """(trace_id, group_id) by Ward's agglomeration into k groups, or as many as there are different vectors.

    Merging mutual nearest neighbours in any order gives the same tree. Of its merges the k - 1 most expensive are not made, of equals the last ones.
    """
    points = points_of(vectors)
    spark, clusters, rounds = vectors.sparkSession, points.select("pid", "features", "w"), []
    left = n = clusters.count()
    k = max(1, min(k, n))
    while left > local:
        pairs, clusters = merge_round(clusters, block)
        rounds.append(pairs)
        left = clusters.count()
    names, x, w = on_driver(clusters)
    merges = [(cost, len(rounds), i, a, b) for i, (cost, a, b) in enumerate(ward_merges(names, x, w))]
    dearest = [(r.cost, t, 0, r.a, r.b) for t, pairs in enumerate(rounds) for r in pairs.orderBy(F.desc("cost"), F.desc("a")).limit(k - 1).collect()]
    undone = {(a, b) for *_, a, b in sorted(merges + dearest)[max(0, len(merges) + len(dearest) - (k - 1)) :]} if k > 1 else set()
    root = {int(p): int(p) for p in names}
    for *_, a, b in reversed(merges):  # from the last merge to the first: what was merged into a is where a is
        root[b] = b if (a, b) in undone else root[a]
    labels = spark.createDataFrame(list(root.items()), "pid long, label long")
    split = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in sorted(undone)))
    for pairs in reversed(rounds):
        moved = pairs.join(labels, pairs["a"] == labels["pid"]).select(F.col("b").alias("pid"), (F.when(F.array_contains(split, F.struct("a", "b")), F.col("b")).otherwise(F.col("label")) if undone else F.col("label")).alias("label"))
        labels = written(labels.union(moved), "labels")
    return labelled(vectors, points, labels)


# silhouette


def silhouettes(points: DataFrame, labels: DataFrame, block: int = BLOCK) -> list[float]:
    """The mean Euclidean silhouette of each of several groupings of weighted points; 0 for a vector alone in its group.

    ``labels`` is (pid, labels), an array with a group's number, from 0, for each grouping.
    """
    return silhouettes_of(written(points.join(labels, "pid").select("pid", "features", "w", "labels"), "labelled"), block)


def silhouettes_of(known: DataFrame, block: int = BLOCK) -> list[float]:
    """``silhouettes`` of (pid, features, w, labels). Blocks of points meet in pairs; a task works out each distance once and returns, for each point of either block, the
    weighted sum of its distances to the other's points by grouping and group, and these are added up."""
    n = known.count()
    if not n:
        return []
    sizes = {(r.t, r.g): float(r.w) for r in known.select("w", F.posexplode("labels").alias("t", "g")).groupBy("t", "g").agg(F.sum("w").alias("w")).collect()}
    groupings, groups = 1 + max(t for t, _ in sizes), 1 + max(g for _, g in sizes)
    sent = in_pairs(known, blocks_of(n, block))

    def meet(key, pdf):
        import pandas as pd

        one, other = (pdf[pdf["own"] == k] for k in key)
        if not len(one) or not len(other):
            return pd.DataFrame({"pid": [], "sums": []})
        x, y, hots = np.stack(one["features"]), np.stack(other["features"]), []
        for side in (one, other):
            hot = np.zeros((len(side), groupings * groups))
            for t, g in enumerate(np.stack(side["labels"]).T):
                hot[np.arange(len(side)), t * groups + g] = side["w"]
            hots.append(hot)
        xx, yy, there, back = (x * x).sum(1), (y * y).sum(1), [], np.zeros_like(hots[1])
        for at in range(0, len(x), TILE):
            d = np.maximum(xx[at : at + TILE, None] + yy[None] - 2 * (x[at : at + TILE] @ y.T), 0)
            if key[0] == key[1]:
                d[np.arange(len(d)), at + np.arange(len(d))] = 0
            np.sqrt(d, out=d)
            there.append(d @ hots[1])
            back += d.T @ hots[0][at : at + TILE]
        out = [pd.DataFrame({"pid": one["pid"].to_numpy(), "sums": list(np.concatenate(there))})]
        if key[0] != key[1]:
            out.append(pd.DataFrame({"pid": other["pid"].to_numpy(), "sums": list(back)}))
        return pd.concat(out)

    met = sent.groupBy("i", "j").applyInPandas(meet, "pid long, sums array<double>")
    sums = met.groupBy("pid").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(groupings * groups))).alias("sums"))
    rows = known.select("pid", "w", "labels").join(sums, "pid")

    def mean(t: int):
        own = F.get("labels", F.lit(t))
        size = F.element_at(F.create_map(*(F.lit(v) for (u, g), w in sizes.items() if u == t for v in (g, w))), own)
        a = F.get("sums", own + t * groups) / F.greatest(size - 1, F.lit(1.0))
        others = [F.when(own != g, F.get("sums", F.lit(t * groups + g)) / w) for (u, g), w in sorted(sizes.items()) if u == t]
        b = F.array_min(F.array(*others))
        s = F.when((size > 1) & b.isNotNull() & (F.greatest(a, b) > 1e-12), (b - a) / F.greatest(a, b)).otherwise(0.0)
        return F.sum(s * F.col("w")) / F.sum("w")

    return list(rows.agg(*(mean(t).alias(f"t{t}") for t in range(groupings))).first())


def judged(vectors: DataFrame, most: int = 8, seed: int = 0) -> tuple[int, DataFrame, DataFrame]:
    """The k from 2 to ``most`` with the best silhouette, the points, and their (pid, label) for it. All are found in the same passes and judged in one."""
    points = points_of(vectors)
    n, ks = points.count(), list(range(2, min(most, vectors.count() - 1) + 1))
    known = with_labels(points, best_centers(points, n, [max(1, min(k, n)) for k in ks], seed))
    values = silhouettes_of(known)
    best = max(range(len(ks)), key=lambda i: (round(values[i], 9), -ks[i])) if values else 0
    return ks[best], points, known.select("pid", F.get("labels", F.lit(best)).cast("long").alias("label"))


def pick_k(vectors: DataFrame, most: int = 8, seed: int = 0) -> int:
    """The k from 2 to ``most`` with the best silhouette; the number of traces if there are under three."""
    n = vectors.count()
    return max(1, n) if n < 3 else judged(vectors, most, seed)[0]


def control_flow(variants: DataFrame) -> DataFrame:
    return standardised(control_flow_tokens(variants), variants)


def enabled(variants: DataFrame) -> DataFrame:
    return standardised(enabled_tokens(variants), variants)


def words_of_trace():
    """A trace's activities, alone and with their enabled sets."""
    return F.flatten(F.transform("trace", lambda e: F.array(e["a"], F.concat(e["a"], F.lit("|"), F.array_join(e["en"], "+")))))


def trace2vec(variants: DataFrame, seed: int = 0) -> DataFrame:
    """Paragraph vectors of traces, of 4 to 32 numbers, no more than there are traces."""
    return paragraph_vectors(variants, words_of_trace(), min(32, max(4, variants.count())), seed)


#: Feature sets by name; each takes variants and gives (trace_id, features).
FEATURES = {"cf": control_flow, "ctx": context_vectors, "enabled": enabled, "trace2vec": trace2vec}


def by_vectors(vectors: DataFrame, k: int | None, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """Groups of vectors; without ``k`` the number of groups with the best silhouette."""
    vectors = written(vectors, "vectors")
    if k is None and method == "kmeans" and vectors.count() > 2:
        _, points, labels = judged(vectors, seed=seed)
        return labelled(vectors, points, labels)
    if k is None:
        k = pick_k(vectors, seed=seed)
    return ward(vectors, k) if method == "ward" else kmeans(vectors, k, seed)


def cluster(variants: DataFrame, features: str, k: int | None = None, method: str = "kmeans", seed: int = 0) -> DataFrame:
    if features not in FEATURES:
        raise ValueError(f"unknown features {features!r}; one of {sorted(FEATURES)}")
    return by_vectors(FEATURES[features](variants), k, method, seed)


def cluster_by(traces: DataFrame, attributes: DataFrame, numeric: list[str], categorical: list[str], k: int | None = None, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """(trace_id, group_id): distinct traces of (case_id, trace) by what their cases' attributes say: means of the named numbers, majorities of the
    named categories, one-hot and standardised."""
    keyed = traces.select("case_id", F.xxhash64("trace").alias("key"))
    per_key = written(aggregate_attributes(keyed, attributes.select("case_id", *numeric, *categorical), numeric, categorical), "attributes")
    return by_attributes(per_key, numeric, categorical, k, method, seed)


def by_attributes(per_key: DataFrame, numeric: list[str], categorical: list[str], k: int | None = None, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """``cluster_by`` of attributes that are aggregated by key and written."""
    vectors = standardised(attribute_tokens(per_key, numeric, categorical), per_key.select(F.col("key").alias("trace_id")))
    return by_vectors(vectors, k, method, seed)
