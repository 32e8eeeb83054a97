"""Open intervals against a plain sweep, and sales against their definition."""

import random
from datetime import datetime, timedelta

from optrail.llm.sweep import look_up, open_sales, sweep

SCHEMA = "nation_id int, from_s long, to_s long, cents long"


def plain_sweep(rows):
    """Every moment is looked at by itself."""
    whole = [(-1 if n is None else n, a, b, c) for n, a, b, c in rows if a is not None and (b is None or b > a)]
    whole += [(-2, *r[1:]) for r in whole]
    out = []
    for nation in {r[0] for r in whole}:
        own = [r[1:] for r in whole if r[0] == nation]
        state, found, high = (0, 0), [], 0
        for t in sorted({a for a, _, _ in own} | {b for _, b, _ in own if b is not None}):
            now = [c for a, b, c in own if a <= t and (b is None or t < b)]
            if (len(now), sum(now)) != state:
                state = len(now), sum(now)
                high = max(high, state[0])
                found.append([nation, t, None, *state, high])
        for x, y in zip(found, found[1:], strict=False):
            x[2] = y[1]
        peak = max((x[4] for x in found), default=0)
        out += [(*x, x[4] == peak) for x in found]
    return sorted(out)


def test_sweep(spark):
    rng = random.Random(5)
    for seconds in (600, 40 * 86_400):
        rows = []
        for _ in range(300):
            a = rng.randrange(-seconds // 4, seconds) // 60 * 60
            rows.append((rng.choice([3, 3, 3, 3, 0, 24, None]), a, rng.choice([None, a, a - 60, a + 60, a + rng.randrange(seconds) // 60 * 60]), rng.choice([0, 1, 5, -5, 10**12])))
        rows += [(7, 0, 60, 5), (7, 60, 120, 5), (7, 120, None, 5), (8, None, 60, 1), (3, 0, 60, 5), (3, 0, 60, 5)]
        got = sweep(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        assert sorted(map(tuple, got)) == plain_sweep(rows)
    assert [tuple(r) for r in got if r.nation_id == 7] == [(7, 0, None, 1, 5, 1, True)]  # starts and ends that cancel out make no row
    assert sweep(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sweep(spark.createDataFrame([(1, 60, 60, 5), (1, None, None, 5)], SCHEMA)).count() == 0


def test_look_up(spark):
    rng = random.Random(1)
    keys = [rng.choice([7, 7, 7, None, *range(600)]) for _ in range(4000)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    values = {k: f"v{k}" for k in range(0, 600, 2)} | {7: "hot"}
    for known in (values, {}):
        got = look_up(rows, spark.createDataFrame(list(known.items()), "k long, v string"), "k").collect()
        assert {r.i: (r.k, r.v) for r in got} == {i: (k, known.get(k)) for i, k in enumerate(keys)} and len(got) == len(keys)


def test_open_sales(spark):
    day = datetime(2024, 1, 3, 4, 5, 59, 999_999)
    at = 1704254700  # 2024-01-03 04:05
    sales = [
        (1, 10, day, 1.005, "x"),
        (2, 10, day, None, "x"),
        (3, 11, day, 2.0, "x"),
        (4, None, day, 0.125, "x"),
        (5, 99, None, 9.0, "x"),
        (None, 12, day, float("nan"), "x"),
        (6, 12, day, -0.5, "x"),
        (6, 12, day, -0.5, "x"),
        (7, 12, datetime(1969, 12, 31, 23, 59, 59), 1.0, "x"),
    ]
    lines = [(1, day + timedelta(days=1)), (1, None), (1, day), (2, None), (3, day - timedelta(days=7)), (None, day), (6, day - timedelta(days=6))]
    clients = [(10, 4, 0), (11, 5, 0), (12, None, 0), (12, None, 1), (None, 3, 0)]
    got = open_sales(
        spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz, total double, to_s string"),
        spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"),
        spark.createDataFrame(clients, "client_id long, nation_id int, from_s long"),
    ).collect()
    week, daily = 7 * 86_400, 86_400
    want = [(4, at, at + week, 100), (4, at, None, 0), (None, at, None, 13), (None, at, None, 0), (None, at, at + daily, -50), (None, at, at + daily, -50), (None, -60, None, 100)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
