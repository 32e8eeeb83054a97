"""Experiments: compositions of the operators over logs derived from the tables, and the queries without a SQL oracle."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import abstraction as ab
from ..functions.checkpoints import written
from ..operators import clustering as cl
from ..operators import enrich as en
from ..operators import grouping as gr
from ..operators import levels
from ..operators import log as lg
from ..operators import metrics as mt
from ..operators import miner, model, quality
from ..operators import relations as rel
from ..operators import views as vw
from ..operators.features import aggregate_attributes
from ..sources import synth as sy
from ..sources.logs import derived_traces, order_traces
from .registry import QUERIES, conversation_traces, query, user_label

T = "trace"


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def labelled_variants(traces: DataFrame) -> DataFrame:
    """(trace_id, trace, label, n_cases, first_ord): variants within each hidden label."""
    return traces.groupBy("label", "trace").agg(F.count(F.lit(1)).alias("n_cases"), F.min("case_ord").alias("first_ord")).withColumn("trace_id", F.xxhash64("trace"))


def recovery_rows(traces: DataFrame, groups: DataFrame, log: str) -> DataFrame:
    """(log, method, agreement): how each grouping (method, trace_id, group_id) agrees with the hidden labels of (trace, label), by cases."""
    return recovery_of(traces.groupBy(F.xxhash64(T).alias("trace_id"), "label").agg(F.count(F.lit(1)).alias("n_cases")), groups, log)


def recovery_of(counted: DataFrame, groups: DataFrame, log: str) -> DataFrame:
    """``recovery_rows`` of (trace_id, label, n_cases)."""
    pairs = counted.select("trace_id", F.col("label").alias("t"), F.col("n_cases").alias("n")).join(groups, "trace_id")
    cells = written(pairs.groupBy("method", "t", F.col("group_id").cast("string").alias("p")).agg(F.sum("n").alias("n")), "cells")
    return mt.agreement(cells, ["method"]).select(F.lit(log).alias("log"), "*")


def counted_once(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled variants and variants of a log, which is read once: cases are counted before anything is written."""
    counted = written(labelled_variants(traces), "labelled")
    return counted, written(counted.groupBy(T).agg(F.sum("n_cases").alias("n_cases"), F.min("first_ord").alias("first_ord")).withColumn("trace_id", F.xxhash64(T)), "variants")


def separation(traces: DataFrame, log: str) -> DataFrame:
    """Every partition method on a labelled log: agreement, number of groups, coherence of enabled sets."""
    counted, v = counted_once(traces)
    groups = written(union_all([group(v).select(F.lit(method).alias("method"), "trace_id", F.col("group_id").cast("string").alias("group_id")) for method, group in gr.PARTITIONS.items()]), "groups")
    texts = v.select("trace_id", "n_cases", ab.variant_text(F.col(T)).alias("variant"), ab.trace_text(F.col(T)).alias("sig"))
    return recovery_of(counted, groups, log).join(mt.incoherence_of(texts.join(groups, "trace_id"), ["method"]), "method")


def clustering_rows(traces: DataFrame, log: str, k: int | None, seed: int = 0, methods: tuple = (("cf", "kmeans"), ("cf", "ward"), ("ctx", "kmeans"), ("enabled", "kmeans"))) -> DataFrame:
    counted, v = counted_once(traces)
    groups = union_all([cl.cluster(v, f, k, m, seed).select(F.lit(f"{f}_{m}").alias("method"), "trace_id", "group_id") for f, m in methods])
    return recovery_of(counted, written(groups, "groups"), log)


def noise_sweep(clean: DataFrame, log: str, steps: tuple[float, ...], modes: tuple[str, ...] = ("balanced", "realistic"), seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """(log, noise, mode, seed, kept, ari, n_views): enabled sets under noise, the agreement of their views with those of the log without it and with the hidden labels."""
    base, keys = written(clean.select("case_id", "label", T, ab.kappa(F.col(T)).alias("clean")), "clean"), ["noise", "mode", "seed"]
    noisy = union_all([sy.perturb_enabled(base, x, mode, seed).select("label", "clean", ab.kappa(F.col(T)).alias("p"), F.lit(x).alias("noise"), F.lit(mode).alias("mode"), F.lit(seed).alias("seed")) for mode in modes for x in steps for seed in seeds])
    counted = written(noisy.groupBy(*keys, "label", "clean", "p").agg(F.count(F.lit(1)).alias("n")), "noisy")
    agree = lambda t: mt.agreement(counted.groupBy(*keys, F.col(t).alias("t"), "p").agg(F.sum("n").alias("n")), keys)
    kept = agree("clean").select(*keys, F.col("ari").alias("kept"))
    return kept.join(agree("label"), keys).select(F.lit(log).alias("log"), *keys, "kept", "ari", F.col("n_groups").alias("n_views"))


def tie_breaks(traces: DataFrame) -> DataFrame:
    """(decomposition, ari, n_views): agreement of the decompositions with the leftmost one, by cases, and their views."""
    v = lg.variants_of(traces).select("n_cases", *(ab.kappa(F.col(T), kind).alias(kind) for kind in ab.DECOMPOSITIONS))
    each = v.select(F.col("leftmost").alias("t"), "n_cases", F.explode(F.array(*(F.struct(F.lit(kind).alias("decomposition"), F.col(kind).alias("p")) for kind in ab.DECOMPOSITIONS))).alias("x"))
    cells = each.groupBy("t", "x.decomposition", "x.p").agg(F.sum("n_cases").alias("n"))
    return mt.agreement(cells, ["decomposition"]).select("decomposition", "ari", F.col("n_groups").alias("n_views"))


def learning_curve(variants: DataFrame, shares: tuple[float, ...] = (0.1, 0.3, 0.7)) -> DataFrame:
    keys = {"kappa": ab.kappa, "variant": ab.variant_text, "constant": lambda t: F.lit("all")}
    return gr.held_out_coverages(variants, keys, shares)


def timed(traces: DataFrame, name: str, repeats: int = 3) -> DataFrame:
    """(log, method, n_traces, seconds): best wall-clock seconds of grouping a log whose variants are written."""
    v = written(lg.variants_of(traces), "variants")
    spark, n, rows = v.sparkSession, v.count(), []
    for method, group in gr.PARTITIONS.items():
        took = []
        for _ in range(repeats):
            begin = time.perf_counter()
            group(v).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        rows.append((name, method, n, min(took)))
    return spark.createDataFrame(rows, "log string, method string, n_traces long, seconds double")


def write_results(spark: SparkSession, sf_dir: str, folder: str, names: tuple[str, ...]) -> list[str]:
    """Write the results of registered queries as CSV, each to a folder of its name, and give the names of those that were not there yet.

    A result that was written whole stays, so a run that was broken off goes on where it ended. Folders may lie in any store that Spark writes to.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fresh = []
    for name in names:
        done = hadoop.Path(f"{folder}/{name}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            QUERIES[name](spark, sf_dir).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
            fresh.append(name)
    return fresh


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of `events` with its hidden label."""
    return derived_traces(spark, sf_dir).withColumn("label", user_label())


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of `lineitem` with the priority of each order as its label."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderpriority").alias("label"))
    return order_traces(spark, sf_dir).join(o, "case_id")


@query
def separation_by_method(spark, sf_dir):
    return separation(labelled_events(spark, sf_dir), "events").unionByName(separation(labelled_orders(spark, sf_dir), "orders"))


@query
def clustering_recovery(spark, sf_dir):
    return clustering_rows(labelled_events(spark, sf_dir), "events", 4)


@query
def noise_by_level(spark, sf_dir):
    return noise_sweep(labelled_events(spark, sf_dir), "events", (0.05, 0.2))


@query
def noise_over_seeds(spark, sf_dir):
    """How views' agreement with those of the log without noise varies over seeds."""
    rows = noise_sweep(labelled_events(spark, sf_dir), "events", (0.1,), ("balanced",), (0, 1, 2))
    return mt.spread(rows, ["noise"], "kept", "seed")


@query
def decompositions_compared(spark, sf_dir):
    return tie_breaks(derived_traces(spark, sf_dir))


@query
def log_overview(spark, sf_dir):
    """Sizes of the logs that the tables give."""
    logs = {"events": derived_traces(spark, sf_dir), "orders": order_traces(spark, sf_dir), "conversations": conversation_traces(spark, sf_dir)}
    return union_all([lg.kpis(lg.variants_of(traces)).select(F.lit(name).alias("log"), "*") for name, traces in logs.items()])


@query
def grouping_seconds(spark, sf_dir):
    return timed(derived_traces(spark, sf_dir), "events", 1)


@query
def views_repeat(spark, sf_dir):
    """Views of the log with its cases dealt in two ways: how many there are, and how many rows of either are not among the other's."""
    traces = derived_traces(spark, sf_dir)
    first, second = (vw.induce_views(lg.variants_of(traces.repartition(n, *key))) for n, key in ((3, ()), (17, ("case_id",))))
    one, other = first.withColumn("side", F.lit(1)), second.withColumn("side", F.lit(-1))
    rows = one.union(other).groupBy(*first.columns).agg(F.sum("side").alias("side"))
    return rows.agg(F.count(F.lit(1)).alias("n_views"), F.coalesce(F.sum(F.abs("side")), F.lit(0)).alias("n_different"))


@query
def coverage_curve(spark, sf_dir):
    return learning_curve(lg.variants_of(derived_traces(spark, sf_dir)))


def attribute_rows(traces: DataFrame, attributes: DataFrame, log: str, sets: dict[str, tuple[list[str], list[str]]], k: int | None, seed: int = 0) -> DataFrame:
    """Agreement of clusterings by named sets of attributes, (numbers, categories) each, with the hidden labels; without ``k`` by silhouette."""
    traces = written(traces.select("case_id", "label", F.xxhash64(T).alias("key")), "traces")
    numbers, names = (sorted({c for own in sets.values() for c in own[i]}) for i in (0, 1))
    per_key = written(aggregate_attributes(traces.select("case_id", "key"), attributes.select("case_id", *numbers, *names), numbers, names), "attributes")
    groups = union_all([cl.by_attributes(per_key, numeric, categorical, k, seed=seed).select(F.lit(name).alias("method"), "trace_id", "group_id") for name, (numeric, categorical) in sets.items()])
    return recovery_of(traces.groupBy(F.col("key").alias("trace_id"), "label").agg(F.count(F.lit(1)).alias("n_cases")), groups, log)


@query
def attribute_clustering(spark, sf_dir):
    """The log of orders, clustered by what is recorded of the orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    sets = {"attr_status": ([], ["status"]), "attr_price": (["price"], []), "attr_all": (["price"], ["status", "priority"])}
    return attribute_rows(labelled_orders(spark, sf_dir), o, "orders", sets, 3)


def quality_rows(traces: DataFrame, log: str, methods: tuple[str, ...]) -> DataFrame:
    """(log, method, n_models, metrics): quality of one mined model for each group, weighted by cases."""
    v, rows = written(lg.variants_of(traces), "variants"), []
    for method in methods:
        grouped = written(v.join(gr.PARTITIONS[method](v), "trace_id").select("group_id", T, "n_cases"), "grouped")
        nets = {g: model.net_of(tree) for g, tree in levels.group_trees(grouped).items()}
        rows.append(quality.weighted_model_quality(grouped, nets).select(F.lit(log).alias("log"), F.lit(method).alias("method"), F.lit(len(nets)).alias("n_models"), "*"))
    return union_all(rows)


@query
def quality_by_grouping(spark, sf_dir):
    return quality_rows(derived_traces(spark, sf_dir), "events", ("global", "kappa_acts"))


def semi_real(traces: DataFrame) -> DataFrame:
    """A plain log split by a recorded label: how far its groups overlap, and what views are worth once enabled sets come from one
    mined model for each group; the control takes the sets from one model of the whole log.

    (method, overlap, retention, n_views, ari): overlap is the share of cases whose sequence lies in several groups.
    """
    plain = traces.select(F.col("label").alias("group_id"), F.transform(T, lambda e: F.struct(e["a"].alias("a"), F.array(e["a"]).alias("en"))).alias(T))
    counted = plain.groupBy("group_id", T).agg(F.count(F.lit(1)).alias("n_cases"))
    counted = written(counted, "counted")
    overlap = rel.variant_overlap(counted)
    nets = {g: model.net_of(tree) for g, tree in levels.group_trees(counted, "im").items()}
    whole = levels.discover_net(counted.groupBy(T).agg(F.sum("n_cases").alias("n_cases")), "im")
    sequences, rows = counted.select("group_id", ab.executed(T).alias("acts"), "n_cases"), []
    for method, used in (("per_group", nets), ("global_model", dict.fromkeys(nets, whole))):
        found = written(en.split_and_enrich(sequences, used), "enriched")
        cells = mt.contingency(found.select(F.col("group_id").alias("t"), ab.kappa(T).alias("p"), F.col("n_cases").alias("n")))
        kept = en.enrichment_report(sequences, found, method).select("retention")
        views = cells.agg(F.count_distinct("p").alias("n_views"))
        rows.append(overlap.crossJoin(kept).crossJoin(views).crossJoin(mt.adjusted_rand_index(cells)).select(F.lit(method).alias("method"), "*"))
    return union_all(rows)


@query
def semi_real_run(spark, sf_dir):
    return semi_real(labelled_events(spark, sf_dir))


@query
def growing_log(spark, sf_dir):
    """Agreement of views with the hidden labels as the log grows by ten days at a time, and its change by day."""
    counted = labelled_events(spark, sf_dir).groupBy(F.substring(F.split("case_id", "-")[1], 7, 2).cast("int").alias("day"), F.col("label").alias("t"), T).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("day", "t", ab.kappa(F.col(T)).alias("p"), "n")  # identifiers first: a generator beside their expression loses the names of its structs
    each = counted.select("*", F.explode(F.array(*(F.lit(d) for d in (10, 20, 31)))).alias("days")).where("day <= days")
    rows = mt.agreement(each.groupBy("days", "t", "p").agg(F.sum("n").alias("n")), ["days"])
    return mt.spread(rows.withColumn("method", F.lit("kappa")), ["method"], "ari", "days")


@query
def clusters_by_silhouette(spark, sf_dir):
    """Groups of the log whose number the silhouette finds."""
    return clustering_rows(labelled_events(spark, sf_dir), "events", None, methods=(("enabled", "kmeans"),))


@query
def kmeans_cf(spark, sf_dir):
    return cl.cluster(lg.variants_of(derived_traces(spark, sf_dir)), "cf", 4)


@query
def ward_cf(spark, sf_dir):
    return cl.cluster(lg.variants_of(derived_traces(spark, sf_dir)), "cf", 4, "ward")


@query
def word2vec_traces(spark, sf_dir):
    return cl.cluster(lg.variants_of(derived_traces(spark, sf_dir)), "trace2vec", 4)


@query
def discover_trees(spark, sf_dir):
    """The model of the log for every miner variant, with and without a noise threshold, level by level."""
    asked = [(variant, noise) for variant in miner.VARIANTS for noise in (0.0, 0.4)]
    trees = levels.discover_each(lg.variants_of(derived_traces(spark, sf_dir)), asked)
    rows = [(variant, noise, str(trees[variant, noise])) for variant, noise in asked]
    return spark.createDataFrame(rows, "variant string, noise double, tree string")


@query
def discover_group_trees(spark, sf_dir):
    grouped = derived_traces(spark, sf_dir).groupBy(user_label().alias("group_id"), "trace").agg(F.count(F.lit(1)).alias("n_cases"))
    return levels.mine_groups(grouped)


@query
def discover_order_trees(spark, sf_dir):
    """Models of the orders of each priority that tolerate rare behaviour."""
    grouped = labelled_orders(spark, sf_dir).groupBy(F.col("label").alias("group_id"), "trace").agg(F.count(F.lit(1)).alias("n_cases"))
    return levels.mine_groups(grouped, "imf", 0.2)


def _group_nets(spark, sf_dir, variant="imf", noise=0.4):
    plain = labelled_events(spark, sf_dir).select(F.col("label").alias("group_id"), F.transform("trace", lambda e: F.struct(e["a"].alias("a"), F.array(e["a"]).alias("en"))).alias("trace"))
    counted = written(plain.groupBy("group_id", "trace").agg(F.count(F.lit(1)).alias("n_cases")), "counted")
    nets = {g: model.net_of(tree) for g, tree in levels.group_trees(counted, variant, noise).items()}
    return counted.select("group_id", ab.executed(T).alias("acts"), "n_cases"), nets


@query
def replay_enrich(spark, sf_dir):
    """The log without enabled sets, split by hidden label, mined and replayed: traces with the model's sets."""
    sequences, nets = _group_nets(spark, sf_dir)
    return en.split_and_enrich(sequences, nets).select("group_id", F.array_join("acts", " -> ").alias("variant"), "n_cases", ab.trace_text(T).alias("trace"))


@query
def replay_report(spark, sf_dir):
    """Cases of each hidden label and those that its model can replay."""
    sequences, nets = _group_nets(spark, sf_dir)
    return en.reports(sequences, en.split_and_enrich(sequences, nets))


@query
def replay_mined(spark, sf_dir):
    """Cases of each hidden label under the model that was mined from them without a threshold, which allows them all."""
    sequences, nets = _group_nets(spark, sf_dir, "im", 0.0)
    return en.reports(sequences, en.split_and_enrich(sequences, nets))


@query
def conformance_mined(spark, sf_dir):
    """Fitness and share of replayed cases of each hidden label under its own mined model: 1 and 0."""
    v = written(labelled_variants(labelled_events(spark, sf_dir)).select(F.col("label").alias("group_id"), T, "n_cases"), "variants")
    nets = {g: model.net_of(tree) for g, tree in levels.group_trees(v, "im").items()}
    return quality.qualities(v.withColumnRenamed("group_id", "scope"), {g: {"own": net} for g, net in nets.items()}).select("scope", "n_cases", "fitness", "replayed_share")


@query
def alignment_quality(spark, sf_dir):
    """Quality of the mined model of the whole log, every trace aligned."""
    v = written(lg.variants_of(derived_traces(spark, sf_dir)), "variants")
    return quality.model_quality(v, levels.discover_net(v))


@query
def global_vs_views(spark, sf_dir):
    """Views of the conversations under the model of all and under their own."""
    v = written(lg.variants_of(conversation_traces(spark, sf_dir)), "variants")
    views = written(vw.induce_views(v), "views")
    nets = {r.label: model.net_of(levels.view_tree(r.kappa, v)) for r in views.select("label", "kappa").collect()}
    return quality.global_vs_views(vw.assign_views(v, views), levels.discover_net(v), nets)
