"""The worked example, folds against the written definitions, relations, miner, replay, conformance and generators."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from optrail.functions import abstraction as ab
from optrail.functions.sets import detect_enabled, parse_set
from optrail.operators import clustering as cl
from optrail.operators import enrich as en
from optrail.operators import grouping as gr
from optrail.operators import log as lg
from optrail.operators import metrics as mt
from optrail.operators import levels, miner, model, quality
from optrail.operators import relations as rel
from optrail.operators import views as vw
from optrail.operators.align import Aligner
from optrail.sources import logs
from optrail.sources import synth as sy

TRACE = "array<struct<a:string,en:array<string>>>"


def traces(spark, lines):
    rows = [(f"c{i}", i, [(x.split(":")[0], sorted(x.split(":")[1])) for x in line.split()]) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, f"case_id string, case_ord long, trace {TRACE}")


@pytest.fixture(scope="module")
def example(spark):
    return lg.variants_of(sy.running_example(spark), with_ids=True).cache()


def test_worked_example(example):
    got = [(r.label, r.kappa, r.n_cases) for r in vw.induce_views(example).orderBy("label").collect()]
    assert got == [("C1", "seq(o, and(xor(b, c), xor(d, e)), f, xor(g, h))", 2), ("C2", "seq(o, xor(b, c), xor(d, e), f, xor(g, h))", 2), ("C3", "seq(o, b, d, f, xor(g, h))", 2)]
    cross = vw.crosstab(vw.assign_views(example, vw.induce_views(example)))
    assert {r.label for r in cross.where("variant = 'o -> b -> d -> f -> g'").collect()} == {"C1", "C2", "C3"}
    wide = vw.crosstab_wide(vw.assign_views(example, vw.induce_views(example)), ["C1", "C2", "C3"]).collect()
    assert sum(r.C1 + r.C2 + r.C3 for r in wide) == 6


def test_first_trace(example):
    one = example.where("first_ord = 0").select(ab.interval_text(F.col("trace")).alias("i"), F.transform("trace", lambda e, i: F.array_join(ab.successor_enabled(F.col("trace"), i), "")).alias("s")).first()
    assert one.i == "[1][2,3][4][5]" and one.s == ["bcde", "de", "f", "gh", ""]


def test_epsilon_and_unknown(spark):
    df = traces(spark, ["", "a:a"])
    assert [r.k for r in df.select(ab.kappa(F.col("trace")).alias("k")).collect()] == ["epsilon", "a"]
    with pytest.raises(ValueError):
        ab.decompose(F.col("trace"), "longest")


def choice_of(trace):
    sets = [set(e) for _, e in trace] + [set()]
    return [({a} | (sets[i] - sets[i + 1]), sets[i] & sets[i + 1]) for i, (a, _) in enumerate(trace)]


def by_definition(trace, kind):
    x = choice_of(trace)
    ok = lambda p, q: all(not x[i][0] & x[j][0] and x[j][0] <= x[i][1] for i, j in itertools.combinations(range(p, q), 2))
    out, n = [], len(x)
    if kind == "rightmost":
        q = n
        while q > 0:
            p = min(p for p in range(q) if ok(p, q))
            out.append((p, q))
            q = p
        return out[::-1]
    p = 0
    while p < n:
        q = max(q for q in range(p + 1, n + 1) if ok(p, q)) if kind == "leftmost" else (p + 2 if p + 2 <= n and ok(p, p + 2) else p + 1)
        out.append((p, q))
        p = q
    return out


EVENTS = st.tuples(st.sampled_from("abcde"), st.sets(st.sampled_from("abcde"), max_size=4)).map(lambda x: (x[0], sorted(x[1] | {x[0]})))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(EVENTS, max_size=8), min_size=60, max_size=60))
def test_folds_equal_the_definitions(spark, logs_):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(logs_)], f"i int, trace {TRACE}")
    for kind in ab.DECOMPOSITIONS:
        got = {r.i: r.d for r in df.select("i", ab.interval_text(F.col("trace"), kind).alias("d")).collect()}
        for i, t in enumerate(logs_):
            assert got[i] == "".join("[" + ",".join(str(k + 1) for k in range(p, q)) + "]" for p, q in by_definition(t, kind)), (kind, t)


def test_relations_of_the_example(example):
    steps = rel.universe_steps(example)
    assert {r.a for r in rel.start_activities(steps).collect()} == {"o"}
    assert {r.a for r in rel.end_activities(steps).collect()} == {"g", "h"}
    pairs = {(r.x, r.a): r.w for r in rel.choice(steps).collect()}
    assert pairs["b", "c"] == pairs["c", "b"] > 0
    classical = {(r.src, r.dst) for r in rel.classical_dfg(steps).where("kind = 'edge'").collect()}
    assert classical <= {(r.src, r.dst) for r in rel.translucent_dfg(steps).where("kind = 'edge'").collect()}
    assert {r.a for r in rel.successors(rel.classical_dfg(steps), "f").collect()} == {"g", "h"}
    assert {r.a for r in rel.predecessors(rel.classical_dfg(steps), "f").collect()} == {"d", "e"}
    dfg = rel.classical_dfg(steps)
    assert rel.filter_infrequent(dfg, 0).count() == dfg.count()


def test_projection_merges_traces(example):
    got = lg.project_log(example, ["o", "f"]).collect()
    assert [(r.n_cases, len(r.case_ids)) for r in got] == [(6, 6)]


def test_ingestion(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    with open(path, "w") as f:
        f.write('case:concept:name,concept:name,enabled\n1,o,o\n1,b,"b,c"\n2,o,\n2,c," b , c,,"\n,x,x\n')
    events = logs.load_csv(spark, path)
    got = {r.case_id: [(e.a, e.en) for e in r.trace] for r in lg.traces_of(events).collect()}
    assert got == {"1": [("o", ["o"]), ("b", ["b", "c"])], "2": [("o", ["o"]), ("c", ["b", "c"])]}
    assert detect_enabled(["x", "en", "enabled"]) == "enabled" and detect_enabled(["x"]) is None
    with pytest.raises(ValueError):
        logs.from_table(spark.createDataFrame([("1", "a")], "`case:concept:name` string, `concept:name` string"))
    timed = spark.createDataFrame([("b", "2", "y", "y|z"), ("b", "1", "x", None), ("a", "1", "q", "q")], "c string, t string, act string, en string")
    one = lg.traces_of(logs.from_table(timed, separator="|", case="c", activity="act", timestamp="t")).orderBy("case_ord").collect()
    assert [(r.case_id, [(e.a, e.en) for e in r.trace]) for r in one] == [("a", [("q", ["q"])]), ("b", [("x", ["x"]), ("y", ["y", "z"])])]
    assert spark.range(1).select(parse_set(F.lit("b. a..b"), ".").alias("s")).first().s == ["a", "b"]


def test_xes_and_csv_round_trip(spark, example, tmp_path):
    df = sy.running_example(spark)
    logs.export_xes(df, str(tmp_path / "x"))
    logs.export_csv(df.coalesce(1), str(tmp_path / "c"))
    want = {r.kappa for r in vw.induce_views(example).collect()}
    for events in (logs.load_xes(spark, str(tmp_path / "x")), logs.load_csv(spark, str(tmp_path / "c"))):
        assert {r.kappa for r in vw.induce_views(lg.variants_of(lg.traces_of(events))).collect()} == want


def simple(words):
    return {tuple((a, frozenset(a)) for a in w): n for w, n in words.items()}


@pytest.mark.parametrize("words, tree", [
    ({"pqr": 4}, "seq(p, q, r)"),
    ({"puq": 3, "pvq": 2, "pwq": 1}, "seq(p, xor(u, v, w), q)"),
    ({"puvq": 1, "pvuq": 5}, "seq(p, and(u, v), q)"),
    ({"pquv": 2, "puv": 7, "puvq": 1, "puqv": 1}, "seq(p, and(seq(u, v), xor(q, tau)))"),
    ({"pq": 5, "pqupq": 2, "pqvpqupq": 1}, "loop(seq(p, q), xor(u, v))"),
    ({"p": 1, "pp": 2}, "loop(p, tau)"),
    ({"": 2, "p": 2}, "xor(p, tau)"),
    ({"": 3}, "tau"),
])
def test_miner(words, tree):
    for variant in ("im", "imts"):
        assert str(model.fold(miner.mine_tree(simple(words), variant))) == tree
    with pytest.raises(ValueError):
        miner.mine_tree(simple(words), "imx")


def test_miner_uses_enabled_sets(spark, example):
    both = lg.variants_of(traces(spark, ["a:a b:bc c:c d:d"] * 3))
    assert "and(b, c)" in str(levels.discover_tree(both, "imto"))
    assert str(levels.discover_tree(both, "im")) == "seq(a, b, c, d)"
    trees = levels.mine_groups(vw.assign_views(example, vw.induce_views(example)).select(F.col("label").alias("group_id"), "trace", "n_cases"), "im").collect()
    assert len(trees) == 3


def test_identifiers_as_trees():
    text = "seq(o, and(xor(b, c), xor(d, e)), f, xor(g, h))"
    assert str(model.parse_identifier(text)) == text and str(model.parse_identifier("epsilon")) == "tau"
    replayer = en.Replayer(model.net_of(model.parse_identifier(text)))
    assert replayer.replay(list("obdfg")) is not None and replayer.replay(list("oecfh")) is not None and replayer.replay(list("obcfg")) is None


def net(rows, start, end):
    out = model.PetriNet(initial=((start, 1),), final=None if end is None else ((end, 1),))
    for i, (p, t, q) in enumerate(rows):
        out.add(f"t{i}", t, [p], [q])
    return out


#: A ticket: opened, then either fixed or passed on, which silently may be skipped, and closed.
TICKET = [("new", "open", "known"), ("known", "fix", "done"), ("known", "pass", "asked"), ("asked", None, "done"), ("asked", "answer", "done"), ("done", "close", "end")]


def test_replay(spark):
    ticket = net(TICKET, "new", "end")
    r = en.Replayer(ticket)
    assert r.enabled(ticket.initial) == ["open"] and r.enabled((("asked", 1),)) == ["answer", "close"]
    rows = [("open fix close", 4), ("open pass close", 2), ("open pass answer close", 1), ("open answer close", 5), ("open fix", 3), ("", 1)]
    cases = spark.createDataFrame([(x.split(), n) for x, n in rows], "acts array<string>, n_cases long")
    got = en.enrich(cases, ticket)
    assert sorted((" ".join(x.acts), x.n_cases, ["|".join(e.en) for e in x.trace]) for x in got.collect()) == [
        ("open fix close", 4, ["open", "fix|pass", "close"]),
        ("open pass answer close", 1, ["open", "fix|pass", "answer|close", "close"]),
        ("open pass close", 2, ["open", "fix|pass", "answer|close"]),
    ]
    assert en.enrichment_report(cases, got).first().retention == 0.4375
    part = net([*TICKET[:2], TICKET[5]], "new", "end")
    roles = spark.createDataFrame([(g, x.split(), n) for g in ("all", "part", "none") for x, n in rows], "group_id string, acts array<string>, n_cases long")
    kept = en.split_and_enrich(roles, {"all": ticket, "part": part}).select("group_id", ab.kappa(F.col("trace")).alias("k"), "n_cases").collect()
    assert sorted(map(tuple, kept)) == [("all", "seq(open, xor(fix, pass), and(answer, close))", 1), ("all", "seq(open, xor(fix, pass), close)", 4), ("all", "seq(open, xor(fix, pass), xor(answer, close))", 2), ("part", "seq(open, fix, close)", 4)]


def test_replay_goes_back_where_a_silent_step_was_wrong():
    for order in (1, -1):
        fork = net([("s", None, "l"), ("s", None, "m"), ("s", None, "r"), ("l", "go", "l2"), ("m", "go", "m2"), ("r", "go", "r2"), ("m2", "go", "m3"), ("m3", "stop", "end"), ("r2", "stop", "r3")][::order], "s", "end")
        r = en.Replayer(fork)
        assert r.replay(["go", "go", "stop"]) == [("go", ["go"]), ("go", ["go"]), ("stop", ["stop"])]
        assert r.replay(["go", "stop"]) is None and r.replay([]) is None
        fork.final = None
        r = en.Replayer(fork)
        assert r.replay(["go", "stop"]) is not None and r.replay([]) == []


def random_tree(rng, depth, names):
    if depth == 0 or rng.random() < 0.25:
        return model.leaf(rng.choice([*names, None]))
    return model.Tree(rng.choice(["seq", "xor", "and", "loop"]), None, tuple(random_tree(rng, depth - 1, names) for _ in range(rng.randint(2, 3))))


def depth_first_run(net_, r, acts):
    """The first run that fits, by trying one after the other."""

    def walk(m, i):
        if i == len(acts):
            return [] if r.can_finish(m) else None
        for after in r.after(m, acts[i]):
            rest = walk(after, i + 1)
            if rest is not None:
                return [(acts[i], sorted({acts[i], *r.enabled(m)})), *rest]
        return None

    return walk(net_.initial, 0)


def plain_cost(net_, trace, r, by_sets):
    """Cost of a cheapest alignment, by relaxing all pairs of position and marking until nothing changes."""
    best, todo = {(0, net_.initial): 0.0}, [(0, net_.initial)]

    def offer(state, cost):
        if cost < best.get(state, 1e9) - 1e-12:
            best[state] = cost
            todo.append(state)

    while todo:
        i, m = todo.pop()
        cost = best[i, m]
        if i < len(trace):
            offer((i + 1, m), cost + 1)
        for name in net_.enabled(m):
            label, after = net_.transitions[name][0], net_.fire(m, name)
            offer((i, after), cost + (label is not None))
            if i < len(trace) and label == trace[i][0]:
                able, logged = set(r.enabled(m)), trace[i][1]
                offer((i + 1, after), cost + (1 - len(able & logged) / len(able | logged) if by_sets else 0))
    return best[len(trace), net_.final]


def test_alignments_and_replay_of_random_nets():
    import random

    rng = random.Random(11)
    for _ in range(20):
        net_ = model.net_of(model.fold(random_tree(rng, 3, "abcd")))
        r = en.Replayer(net_)
        log = [[(a := rng.choice("abcde"), frozenset({a, *rng.sample("abcde", rng.randint(0, 2))})) for _ in range(rng.randint(0, 5))] for _ in range(5)]
        for trace in log:
            acts = [a for a, _ in trace]
            assert r.replay(acts) == depth_first_run(net_, r, acts)
        for aligner in (Aligner(net_), Aligner(net_, few=0)):  # by vectors, by A*
            for by_sets in (False, True):
                for trace, (cost, moves) in zip(log, aligner.align(log, by_sets), strict=True):
                    assert abs(cost - plain_cost(net_, trace, r, by_sets)) < 1e-3
                    m, i, paid = net_.initial, 0, 0.0
                    for kind, name, before, at in moves:  # a run of the net and the whole trace
                        assert (before, at) == (m, i)
                        label = net_.transitions[name][0] if name else None
                        paid += {"sync": aligner.distance(trace[i][1], m) if by_sets and kind == "sync" else 0.0, "silent": 0.0}.get(kind, 1.0)
                        assert (label == trace[i][0]) if kind == "sync" else (label is None) == (kind != "model")
                        i += kind in ("sync", "log")
                        m = net_.fire(m, name) if name else m
                    assert m == net_.final and i == len(trace) and abs(cost - paid) < 1e-3


def test_conformance_of_the_example(example):
    """Values worked out by hand from the written formulas."""
    good = model.net_of(model.parse_identifier("seq(o, and(xor(b, c), xor(d, e)), f, xor(g, h))"))
    q = quality.model_quality(example, good).first()
    assert q.fitness == 1.0 and q.simplicity == 0.714286 and 0 < q.precision < 1 and q.translucent_precision == 1.0
    assert q.translucent_fitness < 1
    views = vw.induce_views(example)
    assigned = vw.assign_views(example, views)
    nets = {r.label: model.net_of(levels.view_tree(r.kappa, example)) for r in views.collect()}
    rows = quality.global_vs_views(assigned, good, nets)
    total = {r.model: r for r in rows.where("scope = 'AGGREGATE'").collect()}
    assert total["view"].translucent_fitness == 1.0 > total["global"].translucent_fitness
    assert total["view"].precision >= total["global"].precision
    assert quality.view_minus_global(rows).count() == 7


def test_alignment_costs():
    plain = net([("p0", "a", "p1"), ("p1", "b", "p2")], "p0", "p2")
    r = en.Replayer(plain)
    cost = lambda word: round(Aligner(plain, r).align([[(a, frozenset(a)) for a in word]])[0][0], 3)
    assert [cost(w) for w in ("ab", "a", "b", "", "axb", "ba")] == [0, 1, 1, 2, 1, 2]
    assert quality.shortest_run(plain) == 2


def test_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    shares = (0.0, 0.2, 0.4, 0.5, 0.8, 1.0)
    for x in ([5.0], [1.0, 2.0, 4.0, 8.0], [0.0] * 50 + [1.0], rng.normal(size=3000).tolist(), rng.integers(0, 9, 2000).tolist(), (10.0 ** rng.uniform(-300, 300, 700)).tolist(), [-1e308, 1e308, 0.0, 5e-324]):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
        assert np.allclose(mt.quantiles(df, "v", shares), np.quantile(np.array(x, float), shares), rtol=1e-12)
    assert mt.quantiles(df.where("false"), "v", shares) == []


def test_agreement(spark):
    score = lambda rows: mt.adjusted_rand_index(mt.contingency(spark.createDataFrame(rows, "t string, p string"))).first().ari
    assert score([("a", "x"), ("a", "x"), ("b", "y")]) == 1.0 and score([("a", "x")]) == 1.0 and score([]) == 1.0
    assert score([(str(i % 3), str(i * 7 % 5)) for i in range(60)]) < 0.4
    r = mt.recovery(mt.contingency(spark.createDataFrame([("a", "x"), ("b", "y")], "t string, p string"))).first()
    assert (r.nmi, r.homogeneity, r.completeness, r.v_measure, r.purity) == (1.0,) * 5


@pytest.mark.parametrize("name", ["k_view_k2", "k_view_k5", "partial_parallel", "enterprise", "hidden_context", "task_mining_helpdesk", "task_mining_servicedesk"])
def test_views_find_the_hidden_labels(spark, name):
    make, k = sy.LOGS[name]
    df = make(spark, 0)
    assert lg.invalid_events(df).count() == 0
    cells = mt.contingency(df.select(F.col("label").alias("t"), ab.kappa(F.col("trace")).alias("p")))
    assert mt.adjusted_rand_index(cells).first().ari == 1.0 and cells.select("p").distinct().count() == k


def test_loop_views_are_lengths(spark):
    for most in (0, 3):
        df = sy.loop_process(spark, 300, most)
        assert vw.induce_views(lg.variants_of(df)).count() == most + 1 == df.select(F.size("trace")).distinct().count()


def test_noise_breaks_views_and_support_helps(spark):
    clean = sy.service_desk(spark, 120)
    noisy = sy.perturb_enabled(clean, 0.3).cache()
    assert lg.invalid_events(noisy).count() == 0
    assert 0.2 < lg.changed_share(clean, noisy).first().rate < 0.4
    cells = lambda key: mt.contingency(noisy.select(F.col("label").alias("t"), key.alias("p")))
    assert mt.adjusted_rand_index(cells(ab.kappa(F.col("trace")))).first().ari < 0.5
    mild = sy.perturb_enabled(clean, 0.05, "realistic").cache()
    v = lg.variants_of(mild)
    supported = mild.withColumn("trace_id", F.xxhash64("trace")).join(gr.group_kappa_supported(v), "trace_id").select(F.col("label").alias("t"), F.col("group_id").alias("p"))
    assert mt.adjusted_rand_index(mt.contingency(supported)).first().ari > 0.8
    with pytest.raises(ValueError):
        sy.perturb_enabled(clean, 0.1, "other")


def test_groupings_are_total(spark, example):
    for name, group in gr.PARTITIONS.items():
        got = group(example).collect()
        assert len(got) == len({r.trace_id for r in got}) == 6, name


def test_attributes(spark):
    df = sy.role_log(spark, sy.HIDDEN_ROLES, 300)
    cases = sy.case_attributes(df).join(df.select("case_id", "label"), "case_id").cache()
    value = lambda a: mt.attribute_informativeness(cases, a).first().nmi
    assert value("role") == 1.0 and value("noise_score") < 0.15 and value("weekday") < 0.15 and value("seniority") < 0.999


def test_clusterings(spark):
    v = lg.variants_of(sy.k_views(spark, 3, 30)).cache()
    for features in ("cf", "ctx", "enabled"):
        got = cl.cluster(v, features, 3).collect()
        assert len(got) == v.count() and len({r.group_id for r in got}) == 3
    assert cl.cluster(v, "cf", 3, "ward").count() == v.count()
    with pytest.raises(ValueError):
        cl.cluster(v, "none", 2)


def test_stream_of_closed_cases(spark, tmp_path):
    from optrail.streaming.views import closed_cases

    rows = [("c1", "2024-01-01 10:00:00", "a", ["a"]), ("c1", "2024-01-01 10:05:00", "b", ["b", "c"]), ("c2", "2024-01-01 10:01:00", "a", ["a"]), ("late", "2024-01-03 10:00:00", "z", ["z"])]
    schema = "case_id string, ts timestamp, a string, en array<string>"
    src = str(tmp_path / "in")
    spark.createDataFrame([(c, t, a, e) for c, t, a, e in rows], "case_id string, ts string, a string, en array<string>").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    out = closed_cases(spark.readStream.schema(schema).parquet(src))
    q = out.writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.case_id, r.kappa) for r in spark.table("closed").collect()} == {("c1", "seq(a, xor(b, c))"), ("c2", "a")}


def test_sql_surface_and_weighted_quality(spark, example):
    from optrail.plans.sql import register

    register(sy.running_example(spark), "ex_")
    assert spark.sql("SELECT count(DISTINCT kappa) AS n FROM ex_variants").first().n == 3
    assert spark.sql("SELECT sum(w) AS n FROM ex_edges WHERE kind = 'start'").first().n == 6
    views = vw.induce_views(example)
    grouped = vw.assign_views(example, views).select(F.col("label").alias("group_id"), "trace", "n_cases")
    nets = {r.label: model.net_of(levels.view_tree(r.kappa, example)) for r in views.where("label <> 'C3'").collect()}
    q = quality.weighted_model_quality(grouped, nets).first()
    assert q.fitness == 0.666667 and 0 < q.precision <= q.fitness


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from optrail.__main__ import main

    logs.export_csv(sy.running_example(spark).coalesce(1), str(tmp_path / "log.csv"))
    monkeypatch.setattr("sys.argv", ["optrail", str(tmp_path / "log.csv"), str(tmp_path / "out")])
    main()
    assert capsys.readouterr().out.count("seq(") == 3
    assert lg.traces_of(logs.load_xes(spark, str(tmp_path / "out" / "C1"))).count() == 2


def test_registered_clusterings_and_replay_take_traces_that_occur_once(spark):
    from optrail.plans import experiments as ex
    from optrail.sources.logs import derived_traces

    sf = "/root/testdata/sf0.001"
    traces = derived_traces(spark, sf)
    assert ex.ward_cf(spark, sf).count() == traces.select("trace").distinct().count()
    assert {r.retention for r in ex.replay_report(spark, sf).collect()} == {1.0}
    assert sum(r.cases_in for r in ex.replay_report(spark, sf).collect()) == traces.count()


def test_every_trace_is_aligned_with_a_net_of_very_many_markings(spark):
    acts = list("abcdefghijklm")
    wide = model.net_of(model.parse_identifier(f"and({', '.join(acts)})"))
    rows = [([{"a": a, "en": [a]} for a in acts], 3), ([{"a": "z", "en": ["z"]}] * 6, 1), ([{"a": a, "en": [a]} for a in acts[:-1]], 2)]
    v = spark.createDataFrame(rows, "trace array<struct<a:string,en:array<string>>>, n_cases long")
    q = quality.model_quality(v, wide).first()
    assert q.replayed_share == 0 and q.fitness == round(1 - (19 + 2) / (3 * 26 + 19 + 2 * 25), 6)


def test_loose_nets_may_be_replayed(spark):
    wide = model.net_of(model.Tree("xor", None, tuple(model.leaf(f"a{i}") for i in range(130))))
    v = spark.createDataFrame([([{"a": "a5", "en": ["a5"]}], 3), ([{"a": "b", "en": ["b"]}], 1)], "trace array<struct<a:string,en:array<string>>>, n_cases long")
    rows = v.withColumn("scope", F.lit("s"))
    q = quality.qualities(rows, {"s": {"m": wide}}, replay_loose=True).first()
    assert quality.too_loose(wide) and q.replayed_share == 1 and q.fitness == 0.75 and q.precision is None
    q = quality.qualities(rows, {"s": {"m": wide}}).first()
    assert q.replayed_share == 0 and q.fitness == 0.75 and 0 < q.precision < 0.1


def test_traces_without_a_name_get_their_index(spark, tmp_path):
    """One file is read in order; of several, indexes go on from one to the next."""
    for k in range(4):
        traces = "".join(f'<trace><event><string key="concept:name" value="a{i % 3}"/><string key="enabled_activities" value="a{i % 3}, b"/></event></trace>\n' for i in range(50 + k))
        (tmp_path / f"log{k}.xes").write_text(f"<log>\n{traces}</log>")
    one = logs.load_xes(spark, str(tmp_path / "log3.xes")).orderBy("case_ord").collect()
    assert [(r.case_id, r.a) for r in one] == [(str(i), f"a{i % 3}") for i in range(53)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        events = logs.load_xes(spark, str(tmp_path))
        assert events.rdd.getNumPartitions() > 1
        assert sorted(int(r.case_id) for r in events.collect()) == list(range(206))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rework_and_quick_logs(spark):
    traces = sy.helpdesk(spark, 40, rework=True)
    kappas = traces.select("label", ab.kappa(F.col("trace")).alias("k")).distinct().collect()
    assert sorted(r.label for r in kappas) == ["manager", "teller"]
    assert ["ask_papers" in r.k for r in sorted(kappas)] == [False, True]
    assert set(sy.build_all(spark, quick=True)) == set(sy.QUICK) < set(sy.LOGS)


def test_pairs_of_trees_by_their_runs():
    def runs(t, depth=3):
        if t.kind == "leaf":
            return {() if t.label is None else (t.label,)}
        parts = [runs(c, depth) for c in t.children]
        if t.kind == "xor":
            return set().union(*parts)
        if t.kind == "seq":
            out = {()}
            for p in parts:
                out = {a + b for a in out for b in p}
            return out
        if t.kind == "and":
            out = {()}
            for p in parts:
                out = {c for a in out for b in p for c in shuffles(a, b)}
            return out
        out = done = parts[0]
        for _ in range(depth):
            done = {a + b + c for a in done for b in set().union(*parts[1:]) for c in parts[0]}
            out = out | done
        return out

    def shuffles(a, b):
        if not a or not b:
            return {a + b}
        return {(a[0], *r) for r in shuffles(a[1:], b)} | {(b[0], *r) for r in shuffles(a, b[1:])}

    for text in ("seq(a, xor(tau, b), c)", "and(a, seq(b, c), xor(tau, d))", "loop(a, tau)", "loop(seq(a, b), c, tau)", "loop(tau, a, b)", "seq(xor(tau, a), loop(xor(b, tau), c), xor(d, tau))"):
        tree = model.parse_identifier(text)
        starts, ends, pairs, empty = model.follows(tree)
        known = runs(tree)
        assert starts == {r[0] for r in known if r} and ends == {r[-1] for r in known if r} and empty == (() in known)
        assert pairs == {p for r in known for p in zip(r, r[1:], strict=False)}
