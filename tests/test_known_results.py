"""Results that are known beforehand, on small logs and nets of the tests' own: generators, models, replay and conformance."""

import itertools

import pytest
from pyspark.sql import functions as F

from optrail.functions import abstraction as ab
from optrail.operators import clustering as cl
from optrail.operators import levels, quality
from optrail.operators import log as lg
from optrail.operators import metrics as mt
from optrail.operators.model import PetriNet, net_of, parse_identifier
from optrail.plans import experiments as ex
from optrail.sources import synth as sy

LOG = "group_id string, trace array<struct<a:string,en:array<string>>>, n_cases long"


def plain(sequence):
    return [{"a": a, "en": [a]} for a in sequence.split()]


@pytest.mark.parametrize("name", [n for n, (_, labels) in sy.LOGS.items() if labels])
def test_generated_logs_have_a_view_for_each_label(spark, name):
    make, labels = sy.LOGS[name]
    traces = make(spark, 0).select(F.col("label").alias("t"), ab.kappa(F.col("trace")).alias("p"), ab.variant_text(F.col("trace")).alias("v")).cache()
    cells = mt.contingency(traces)
    assert mt.adjusted_rand_index(cells).first().ari == 1.0
    assert cells.select("t").distinct().count() == cells.select("p").distinct().count() == labels
    shared = traces.groupBy("v").agg(F.count_distinct("p").alias("n")).where("n > 1").count()
    assert (shared > 0) == (not name.startswith("enterprise"))


def test_relations_of_models(spark):
    """Pairs that may follow each other in a mined model are those of its log where the log shows all that the model allows."""
    logs = {"line": ["in look out"], "either": ["in look out", "in skip out"], "any": [f"in {' '.join(p)} out" for p in itertools.permutations(["x", "y"])], "again": ["in look", "in look back in look"]}
    rows = [(g, plain(s), 5) for g, log in logs.items() for s in log]
    got = {}
    for r in levels.mine_follows(spark.createDataFrame(rows, LOG), "im").collect():
        got.setdefault(r.group_id, set()).add((r.x, r.y))
    assert got == {g: {p for s in log for p in itertools.pairwise(s.split())} for g, log in logs.items()}


def test_conformance_by_hand(spark):
    """One net: b or c between a and d, and a silent way around them. Arcs, firings and prefixes are few enough to count."""
    net = PetriNet(initial=(("i", 1),), final=(("o", 1),))
    for name, label, ins, outs in (("t1", "a", "i", "p"), ("t2", "b", "p", "q"), ("t3", "c", "p", "q"), ("t4", None, "p", "q"), ("t5", "d", "q", "o")):
        net.add(name, label, [ins], [outs])
    rows = [("both", plain("a b d"), 3), ("both", plain("a c d"), 1), ("short", plain("a d"), 4), ("off", plain("a x d"), 1)]
    df = spark.createDataFrame(rows, LOG).withColumnRenamed("group_id", "scope")
    got = {r.scope: r for r in quality.qualities(df, {s: {"m": net} for s in ("both", "short", "off")}).collect()}
    assert [got[s].fitness for s in ("both", "short", "off")] == [1.0, 1.0, round(1 - 1 / (3 + 2), 6)]  # the shortest run is a d
    # a: 1 of 1; behind a: b, c or, by the silent step, d: 3 allowed; behind a b: d alone
    assert got["both"].precision == round(1 - 4 * 1 / (4 * 1 + 4 * 3 + 4 * 1), 6)
    assert got["short"].precision == 1.0  # behind the silent step there is d alone
    fired = {"t1": 4, "t2": 3, "t3": 1, "t5": 4}
    assert got["both"].generalization == round(1 - (sum(n**-0.5 for n in fired.values()) + 1) / 5, 6)
    assert got["both"].simplicity == round(1 / (1 + 20 / 9 - 2), 6) and all(r.replayed_share == 0 for r in got.values())


def test_clustering_by_the_label_itself_finds_it(spark):
    traces = sy.hidden_context(spark, 60)
    attributes = traces.select("case_id", "label", F.length("label").cast("double").alias("size"))
    got = ex.attribute_rows(traces, attributes, "roles", {"label": ([], ["label"]), "size": (["size"], [])}, 3).collect()
    ari = {r.method: r.ari for r in got}
    assert ari["label"] == 1.0 > ari["size"]  # two of the labels are as long as each other
    assert cl.cluster_by(traces, attributes, [], ["label"]).select("group_id").distinct().count() == 3  # the silhouette finds three


def test_paragraph_vectors_tell_roles_apart(spark):
    """The nearest trace is one of the same role, more often than by the means of random word vectors."""
    import numpy as np

    traces = sy.k_views(spark, 3, 60)
    role = {r.i: r.label for r in traces.select(F.xxhash64("trace").alias("i"), "label").distinct().collect()}
    v = lg.variants_of(traces).cache()

    def right(rows):
        ids, x = [r.trace_id for r in rows], np.array([r.features for r in rows])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cosine = x @ x.T
        np.fill_diagonal(cosine, -9)
        return np.mean([role[ids[i]] == role[ids[j]] for i, j in enumerate(cosine.argmax(1))])

    words = v.select("trace_id", cl.words_of_trace().alias("w")).collect()
    drawn = {w: np.random.default_rng(i).normal(size=18) for i, w in enumerate(sorted({w for r in words for w in r.w}))}
    means = [type("Row", (), {"trace_id": r.trace_id, "features": np.mean([drawn[w] for w in r.w], 0)}) for r in words]
    assert right(cl.trace2vec(v).collect()) >= max(0.9, right(means))


def test_agreement_of_many_contingencies_is_that_of_each(spark):
    rows = [(k, str(i % 3), str(i * (k + 1) % 4), i % 5 + 1) for k in range(3) for i in range(20)] + [(9, "a", "b", 1)]
    cells = spark.createDataFrame(rows, "k int, t string, p string, n long").groupBy("k", "t", "p").agg(F.sum("n").alias("n"))
    for r in mt.agreement(cells, ["k"]).collect():
        own = cells.where(F.col("k") == r.k).drop("k")
        one = mt.recovery(own).first()
        assert (r.ari, r.nmi, r.homogeneity, r.completeness, r.v_measure, r.purity) == (mt.adjusted_rand_index(own).first().ari, one.nmi, one.homogeneity, one.completeness, one.v_measure, one.purity)


def test_noise_takes_views_apart(spark):
    got = {r.noise: r for r in ex.noise_sweep(sy.service_desk(spark, 60), "desk", (0.0, 0.3), ("balanced",)).collect()}
    assert got[0.0].kept == got[0.0].ari == 1.0 and got[0.0].n_views == 4 and got[0.3].ari < 0.6


def test_results_are_written_once(spark, tmp_path):
    sf, out, names = "/root/testdata/sf0.001", f"file://{tmp_path}/out", ("log_kpis", "start_acts")
    assert ex.write_results(spark, sf, out, names[:1]) == ["log_kpis"]
    assert ex.write_results(spark, sf, out, names) == ["start_acts"]
    assert spark.read.csv(f"{out}/start_acts", header=True).count() == 5 and spark.read.csv(f"{out}/log_kpis", header=True).first().n_activities == "5"


def test_enabled_sets_of_the_model_itself_fit(spark):
    tree = parse_identifier("seq(in, xor(look, skip), out)")
    traces = [([("in", ["in"]), (x, ["look", "skip"]), ("out", ["out"])],) for x in ("look", "skip")]
    v = spark.createDataFrame(traces, "trace array<struct<a:string,en:array<string>>>").withColumn("n_cases", F.lit(2))
    assert quality.available() and quality.translucent_fitness(v, net_of(tree)) == quality.translucent_precision(v, net_of(tree)) == 1.0
    assert quality.translucent_fitness(v.withColumn("trace", F.transform("trace", lambda e: F.struct(e["a"].alias("a"), F.array(e["a"]).alias("en")))), net_of(tree)) == round(1 - 0.5 / 6, 6)


def test_views_of_an_empty_log(spark):
    from optrail.operators import views as vw

    empty = lg.variants_of(sy.running_example(spark).where("false"))
    assert vw.induce_views(empty).count() == 0 and vw.crosstab(vw.assign_views(empty, vw.induce_views(empty))).count() == 0
