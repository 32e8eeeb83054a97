"""Nearest neighbours and near-duplicate vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from optrail.llm import caps, mih
from optrail.llm.caps import link_near, list_decode
from optrail.llm.mih import search

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def odd_rows():
    return [(9001, None, 1, 0), (9002, [0.0] * 24, 1, 0), (9003, [math.nan] * 24, 1, 0), (9004, [None] + [1.0] * 23, 1, 0), (9005, [], 1, 0), (None, [1.0] * 24, 1, 0), (9006, [1.0, 2.0], 1, 0), (9007, [math.inf] + [1.0] * 23, 1, 0)]


def make_vectors(seed=1, n=600, size=24, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    for i in range(n // 3, n // 2):  # near copies of a few
        x[i] = x[i % 7] + 0.12 * rng.normal(size=size) * (i % 3 > 0)
    return [(int(i * 5), [float(np.float32(v)) for v in row], int(i % labels) if i % 50 else None, 0) for i, row in enumerate(x)]


def test_every_code_in_the_radius_is_found_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 24))
    x[600:] = x[:100]
    codes = mih.Codes(x, 700)
    own = codes.of(x)
    for i in range(0, 700, 50):
        apart = np.bitwise_count(own ^ own[i]).sum(1, dtype=int)
        for radius in (0, 1, 3, 4, 9, 17, 30, 40, codes.bits):
            found = []
            for place in range(codes.parts):
                order = np.argsort(own[:, place], kind="stable")
                found += order[mih.probe(own[order], place, own[i], radius)].tolist()
            assert sorted(found) == np.flatnonzero(apart <= radius).tolist()


def test_few_candidates_where_vectors_have_structure():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 32))
    x, ids = centres[rng.integers(0, 100, 5000)] + 0.3 * rng.normal(size=(5000, 32)), np.arange(5000)
    norms = np.linalg.norm(x, axis=1)
    codes = mih.Codes(x[:2000], 5000)
    reach = mih.Reach(x[:2000], ids[:2000], codes, 5000, 10, norms.min(), norms.max())
    own, hits, share = codes.of(x), 0, []
    for q in range(0, 5000, 100):
        near = np.bitwise_count(own ^ own[q]).sum(1, dtype=int) <= reach.radius(q, x[q])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += near[np.argsort(d)[:10]].sum()
        share.append(near.mean())
    assert hits >= 0.9 * 500 and np.mean(share) < 0.05


@pytest.mark.parametrize("rows_of_a_bin", [20_000, 40])
def test_search_recall_and_scores(spark, monkeypatch, rows_of_a_bin):
    monkeypatch.setattr(mih, "BIN_ROWS", rows_of_a_bin)
    rows = make_vectors() + odd_rows()
    rows += [(6000 + i, rows[20][1], 1, 0) for i in range(30)] + [(100, rows[20][1], 1, 0), (100, rows[20][1], 1, 0)]  # one vector under many keys, and a key with two vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = search(df, F.col("vec_id") % 100 == 0).collect()
    good = {(r[0], tuple(r[1])) for r in rows if r[0] is not None and r[1] and len(r[1]) == 24 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])}
    keys, x = [k for k, _ in good], np.array([v for _, v in good])
    hits = wanted = 0
    for q in sorted({k for k in keys if k % 100 == 0} - {100}):
        d = np.sqrt(((x - x[keys.index(q)]) ** 2).sum(1))
        best = sorted((s, k) for s, k in zip(d.tolist(), keys, strict=True) if k != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        own = dict.fromkeys(zip(keys, d.tolist(), strict=True))
        assert all((v, s) in own for _, v, s in mine)
        hits += len({k for _, k in best} & {v for _, v, _ in mine})
        wanted += 10
    assert {r.query_id for r in got} == {k for k in keys if k % 100 == 0} and not any(r.query_id == r.vec_id for r in got)
    assert hits / wanted >= 0.9
    assert search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_few_rows_are_all_answers(spark):
    rows = [(0, [1.0, 0.0], 1, 0), (1, [0.0, 1.0], 1, 0), (2, [-1.0, 0.0], 1, 0), (2, [-1.0, 0.0], 1, 0)]
    got = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("block", [2000, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK_VECTORS", block)
    rows = make_vectors(3) + odd_rows()
    rows += [(7001, rows[10][1], rows[10][2], 0), (7002, rows[10][1], rows[10][2], 0), (7002, rows[10][1], rows[10][2], 0)]
    got = link_near(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    part = [i for i, (k, v, g, _) in enumerate(rows) if k is not None and g is not None and v and all(a is not None and math.isfinite(a) for a in v) and any(v)]
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))
    for i in part:
        for j in part:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
    low = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            low[r] = min(rows[i][0], low.get(r, 1 << 60))
    want = sorted(((rows[i][0], links[i], low.get(root[i]) if rows[i][0] is not None else None) for i in range(len(rows))), key=repr)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert link_near(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filters_grow_with_the_vectors():
    """However many vectors there are, a random one shares its filters with about as many others, and near ones share filters."""
    rng = np.random.default_rng(7)
    met, missed = [], 0
    for n in (2000, 10_000):
        x = rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = caps.codes_for(n)
        rows, filters = list_decode(x, codes)
        met.append((np.bincount(filters).astype(float) ** 2).sum() / n)
        y = x[:300] + np.sqrt(1 / 0.935**2 - 1) * (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))(rng.normal(size=(300, 32)))
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near, own = list_decode(y, codes)
        missed += sum(not set(filters[rows == i]) & set(own[near == i]) for i in range(300) if x[i] @ y[i] >= 0.93)
    assert met[1] < 1.3 * met[0] and not missed


def test_lists_hold_every_filter_above_the_threshold():
    rng = random.Random(5)
    x = np.random.default_rng(5).normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, filters = list_decode(x)
    rotation, first, second = caps.product_code(16)
    t = caps.threshold(16)
    for i in rng.sample(range(40), 10):
        a, b = caps.halves((x[i] @ rotation)[None], first, second)
        sums = (a[0][:, None] + b[0][None]).ravel()
        own = filters[rows == i]
        assert set(np.flatnonzero(sums >= t)) <= set(own.tolist()) and len(own) >= caps.LISTED


def test_angles_of_distances():
    assert mih.angle_for(0.0, 1.0, 1.0, 1.0) == 0
    assert mih.angle_for(2.0, 1.0, 1.0, 1.0) == 1
    assert abs(mih.angle_for(2**0.5, 1.0, 1.0, 1.0) - 0.5) < 1e-9
