"""The mix against a sequential version of fair queueing, and the components against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from optrail.llm.common import connected_components
from optrail.llm.mix import in_mix_order, mix_sources, source_targets

SCHEMA = "doc_id long, text string, source string, size int"


def targets_of(total, weights=(3, 1, 2), share=1.5, most=2):
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    budget, target, left = share * sum(total.values()), {}, set(total)
    while left:
        rest, sum_w = budget - sum(target.values()), sum(weight[s] for s in left)
        full = {s for s in left if rest * weight[s] / sum_w > most * total[s]}
        target |= {s: most * total[s] for s in full} if full else {s: rest * weight[s] / sum_w for s in left}
        left -= full or left
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(700):
        source = rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", None])
        out.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), source, 3))
    return [*out, (900, None, "a", 3), (901, " \t", "only", 3), (None, "no id here", "b", 3), (902, "long " * 3000, "b", 3)]


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(8):
        total = {s: rng.choice([0, 1, 10, 500, 10_000]) for s in rng.sample(["a", "b", "c", "d", "é", None, "Z"], rng.randint(1, 7))}
        df = spark.createDataFrame(list(total.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = targets_of(total)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in total), (total, got, want)


def test_mix(spark, rows):
    got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = {}
    for r in rows:
        total[r[2]] = total.get(r[2], 0) + size[r[0]]
    target = targets_of(total)
    want, served, budget = {}, 0, sum(target.values())  # one queue of all sources, in the order of finish times, cut at the budget
    queue = [(r.finish + nth * r.source_size / r.target, -1 if r.doc_id is None else r.doc_id, r.size) for r in got if r.target and r.size for nth in (0, 1)]
    for _, k, n in sorted(queue):
        if served + n / 2 < budget:
            want[k] = want.get(k, 0) + n
        served += n
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == want.get(-1 if r.doc_id is None else r.doc_id, 0)
    largest = {s: max(size[r[0]] for r in rows if r[2] == s) for s in total}
    short = sum(largest.values()) / 2 / sum(target[s] for s in total if target[s] < 2 * total[s])  # others make up for what whole documents leave
    for s in total:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= largest[s] / 2 + short * target[s] + 1e-6
    assert abs(sum(r.taken for r in got) - budget) <= max(size.values()) / 2 + 1e-6
    df = spark.createDataFrame(rows, SCHEMA)
    out = in_mix_order(df, mix_sources(df)).collect()
    times = {}
    for r in out:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {r.doc_id: r.taken // r.size for r in got if r.taken}
    place = {r.doc_id: r.finish for r in got}
    first = list(dict.fromkeys(r.doc_id for r in out))
    assert [place[k] for k in first] == sorted(place[k] for k in first)
    again = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 20), (200, 150), (200, 199)):
        pairs = [(i, i + 1) for i in range(m)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        if n == 200:
            pairs += [(0, i) for i in range(60, 120)]
        root = {x: x for p in pairs for x in p}
        for a, b in pairs:
            x, y = root[a], root[b]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
        df = spark.createDataFrame([(a, b) for a, b in pairs] + [(None, 1), (2, None)], "u long, v long")
        assert {r.node: r.component for r in connected_components(df).collect()} == root
    assert connected_components(spark.createDataFrame([], "u long, v long").withColumn("x", F.lit(1))).count() == 0
