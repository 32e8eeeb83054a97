"""Clusterings by Spark against the same ones in memory and against plain versions."""

import numpy as np
import pytest

from optrail.operators import clustering as cl


def frame(spark, x):
    return spark.createDataFrame([(i * 7 % 1009, [float(v) for v in row]) for i, row in enumerate(x)], "trace_id long, features array<double>").repartition(5)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.5, (40, 3)) for c in (0, 3, 6)])
    return np.concatenate([x, x[:10], x[:1].repeat(15, 0)])  # some vectors occur more than once


def parts_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.group_id, set()).add(r.trace_id)
    return sorted(map(sorted, groups.values()))


def plain_ward(x, k):
    """Merge the cheapest pair until k groups are left; costs straight from the points."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = lambda a, b: ((x[a].mean(0) - x[b].mean(0)) ** 2).sum() * len(a) * len(b) / (len(a) + len(b))
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return groups


@pytest.mark.parametrize("k", [1, 3, 7])
def test_ward(spark, points, k):
    df = frame(spark, points)
    here, there = (parts_of(cl.ward(df, k, local, block=70).collect()) for local in (5000, 60))
    ids = np.array([i * 7 % 1009 for i in range(len(points))])
    assert here == there == sorted(sorted(ids[g].tolist()) for g in plain_ward(points, k))


def test_ward_of_few_and_equal_vectors(spark):
    same = frame(spark, np.ones((6, 2)))
    assert len(parts_of(cl.ward(same, 3).collect())) == 1
    assert cl.ward(same.where("false"), 3).count() == 0
    line = frame(spark, np.arange(24.0)[:, None])  # all distances tie
    assert parts_of(cl.ward(line, 2, 4, 6).collect()) and len(parts_of(cl.ward(line, 24, 4, 6).collect())) == 24


@pytest.mark.parametrize("k", [1, 3, 5])
def test_kmeans(spark, points, k):
    df = frame(spark, points)
    here, there = (cl.kmeans(df, k, 0, local).collect() for local in (5000, 10))
    assert parts_of(here) == parts_of(there) and len(parts_of(here)) == k
    x = {i * 7 % 1009: row for i, row in enumerate(points)}
    cost = lambda parts: sum(((np.array([x[i] for i in p]) - np.mean([x[i] for i in p], 0)) ** 2).sum() for p in parts)
    if k == 3:
        ids = [i * 7 % 1009 for i in range(len(points))]
        own = [[ids[i] for i in range(len(points)) if (points[i].mean() > 1.5) + (points[i].mean() > 4.5) == c] for c in range(3)]
        assert cost(parts_of(here)) <= cost(own) + 1e-9


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, g in enumerate(labels):
        own = labels == g
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == h].mean() for h in set(labels.tolist()) - {g})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_silhouettes(spark, points):
    rng = np.random.default_rng(5)
    groupings = [np.arange(len(points)) % 120 // 40, rng.integers(0, 4, len(points))]
    same = {tuple(row): i for i, row in reversed(list(enumerate(points)))}
    groupings = [np.array([labels[same[tuple(row)]] for row in points]) for labels in groupings]
    df = frame(spark, points)
    known = cl.points_of(df)
    ids = {i * 7 % 1009: i for i in range(len(points))}
    rows = [(r.pid, [int(labels[ids[r.pid]]) for labels in groupings]) for r in known.collect()]
    got = cl.silhouettes(known, spark.createDataFrame(rows, "pid long, labels array<int>"), block=25)
    assert np.allclose(got, [plain_silhouette(points, labels) for labels in groupings])
    assert cl.pick_k(df) == 3 and cl.pick_k(df.limit(2)) == 2


def test_paragraph_vectors(spark):
    """Documents of one topic are nearer to each other than to those of another, alike in reruns, and without words at their start."""
    from pyspark.sql import functions as F

    from optrail.operators.paragraphs import paragraph_vectors

    rng = np.random.default_rng(2)
    topics = [[f"w{t}{i}" for i in range(12)] for t in range(3)]
    rows = [(i, [str(w) for w in rng.choice(topics[i % 3] + ["every", "one"], 9)]) for i in range(90)] + [(500, [])]
    df = spark.createDataFrame(rows, "trace_id long, words array<string>")
    got = {r.trace_id: np.array(r.features) for r in paragraph_vectors(df.repartition(3), F.col("words"), 8, part=40).collect()}
    again = {r.trace_id: np.array(r.features) for r in paragraph_vectors(df.repartition(2), F.col("words"), 8, part=40).collect()}
    assert set(got) == set(again) == {i for i, _ in rows} and all(np.allclose(got[i], again[i]) for i in got)
    x = np.stack([got[i] / np.linalg.norm(got[i]) for i in range(90)])
    cosine = x @ x.T
    np.fill_diagonal(cosine, -1)
    assert np.mean([cosine[i].argmax() % 3 == i % 3 for i in range(90)]) > 0.9
    assert paragraph_vectors(df.where("false"), F.col("words"), 4).count() == 0
