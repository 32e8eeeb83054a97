"""Work that is done once, however many results come from it."""

import numpy as np
import pytest

from optrail.operators import clustering as cl
from optrail.operators import grouping as gr
from optrail.operators import levels, miner, model, quality
from optrail.operators import log as lg
from optrail.operators.align import Aligner, Prefixes
from optrail.plans import experiments as ex
from optrail.sources.logs import derived_traces

SF = "/root/testdata/sf0.001"


def counting(monkeypatch, module, name):
    """Calls of a function of a module from now on."""
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *args, **kwargs: calls.append(args) or real(*args, **kwargs))
    return calls


def test_coverage_reads_the_log_once(spark):
    df = ex.coverage_curve(spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    v = lg.variants_of(derived_traces(spark, SF)).where("false")
    assert [r.coverage for r in ex.learning_curve(v).collect()] == [0.0] * 9


def test_trees_of_all_miners_share_their_passes(spark, monkeypatch):
    passes = counting(monkeypatch, levels, "written")
    rows = ex.discover_trees(spark, SF).collect()
    assert len(passes) == 1 and len(rows) == 2 * len(miner.VARIANTS)
    v = lg.variants_of(derived_traces(spark, SF))
    asked = [("im", 0.0), ("imtf", 0.4), ("imf", 0.4)]
    assert levels.discover_each(v, asked, 40) == {a: levels.discover_tree(v, *a) for a in asked}


def test_numbers_of_groups_share_their_passes(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(3).normal(c, 0.4, (30, 3)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "trace_id long, features array<double>")
    points, passes = counting(monkeypatch, cl, "points_of"), counting(monkeypatch, cl, "best_centers")
    assert cl.by_vectors(df, None).select("group_id").distinct().count() == 3
    assert len(points) == len(passes) == 1


def test_cases_are_counted_before_they_are_written(spark, monkeypatch):
    calls = counting(monkeypatch, ex, "written")
    rows = ex.separation(ex.labelled_events(spark, SF), "events").collect()
    assert len(rows) == len(gr.PARTITIONS) and "traces" not in [name for _, name in calls]


def test_attributes_are_aggregated_once(spark, monkeypatch):
    calls = [*map(lambda m: counting(monkeypatch, m, "aggregate_attributes"), (cl, ex))]
    assert ex.attribute_clustering(spark, SF).count() == 3
    assert sum(map(len, calls)) == 1


@pytest.mark.parametrize("same", [False, True])
def test_cheapest(same):
    rng = np.random.default_rng(4)
    x, y = (rng.integers(0, 3, (n, 3)).astype(float) for n in (700, 40))  # very many ties
    y = x if same else y
    v, w = rng.integers(1, 4, len(x)).astype(float), rng.integers(1, 4, len(y)).astype(float)
    w = v if same else w
    d = ((x[:, None] - y[None]) ** 2).sum(2) * (v[:, None] * w[None] / (v[:, None] + w[None]))
    if same:
        np.fill_diagonal(d, np.inf)
    at, cost = cl.cheapest(x, v, y, w, same)
    assert np.array_equal(at, d.argmin(1)) and np.array_equal(cost, d.min(1))
    assert cl.blocks_of(100_000, cl.BLOCK) == 20 and cl.blocks_of(30, 5) == 6


def test_alignments_are_worked_out_once_for_traces_of_the_same_activities(monkeypatch):
    """Costs by sets are those of whole alignments, from fewer vectors than there are beginnings of traces; sets aside, a sequence of activities is aligned once."""
    net = model.net_of(model.parse_identifier("and(xor(loop(a, tau), tau), xor(loop(b, tau), tau), c)"))
    rng = np.random.default_rng(5)
    words = ["", "a", "c", "abc", "cab", "abcab", "aabbcc", "abzcab", "bbbcaaa"]
    traces = [[(x, frozenset({x, *rng.choice(list("abcd"), rng.integers(0, 3))})) for x in word] for word in words for _ in range(40)]
    slow = Aligner(net)
    whole = slow.align(traces, by_sets=True)
    assert np.allclose(slow.costs(traces), [cost for cost, _ in whole], atol=1e-12)
    assert np.allclose(slow.costs(traces[::-1]), [cost for cost, _ in whole[::-1]], atol=1e-12)  # endings are known by now
    assert np.allclose(Aligner(net, few=0).costs(traces[:80]), [cost for cost, _ in whole[:80]], atol=1e-3)
    back, vectors = counting(monkeypatch, Aligner, "_moves_back"), []
    real = Aligner._closed
    monkeypatch.setattr(Aligner, "_closed", staticmethod(lambda *args: vectors.append(args) or real(*args)))
    facts = quality.aligned_facts(net, Aligner(net), traces, [2] * len(traces), 1)
    assert len(back) == len(words) and 0 < 3 * len(vectors) < 2 * len(Prefixes(traces, True).parent)
    total = lambda kind, i: sum(f[i] for f in facts if f[0] == kind)
    assert total("aligned", 3) == 2 * len(traces) and abs(total("fit_sets", 3) - 2 * sum(cost for cost, _ in whole)) < 1e-9
    assert total("fit", 4) == total("fit_sets", 4) == sum(2 * (len(t) + 1) for t in traces)
