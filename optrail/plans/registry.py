"""Registered queries of the process-analytics library over the tables of a scale factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import abstraction as ab
from ..functions.checkpoints import written
from ..functions.sets import parse_set
from ..operators import grouping as gr
from ..operators import log as lg
from ..operators import metrics as mt
from ..operators import relations as rel
from ..operators import views as vw
from ..sources.logs import derived_traces, order_traces, top_groups

T, V = "trace", F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def user_label(case_id: str = "case_id"):
    """The hidden label of a derived case: its user modulo 4."""
    return F.concat(F.lit("u"), (F.split(case_id, "-")[0].cast("long") % 4).cast("string"))


def variants(spark, sf_dir):
    return lg.variants_of(derived_traces(spark, sf_dir))


def assigned(spark, sf_dir):
    """Variants with their views' labels; identifiers are worked out once and written."""
    v = written(vw.with_kappa(variants(spark, sf_dir)), "variants")
    return vw.assign_views(v, vw.induce_views(v))


def steps(spark, sf_dir):
    return rel.universe_steps(variants(spark, sf_dir))


def labelled(spark, sf_dir):
    """(group_id, trace, n_cases): variants counted within each hidden label."""
    return derived_traces(spark, sf_dir).groupBy(user_label().alias("group_id"), "trace").agg(F.count(F.lit(1)).alias("n_cases"))


def cells(spark, sf_dir):
    """Contingency of hidden labels and views."""
    counted = labelled(spark, sf_dir)
    return mt.contingency(counted.select(V("group_id").alias("t"), ab.kappa(T).alias("p"), V("n_cases").alias("n")))


@query
def log_kpis(spark, sf_dir):
    return lg.kpis(variants(spark, sf_dir))


@query
def log_validate(spark, sf_dir):
    return lg.invalid_events(derived_traces(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_invalid"))


@query
def trace_variants(spark, sf_dir):
    return variants(spark, sf_dir).select(ab.trace_text(T).alias("trace"), "n_cases", "first_ord")


@query
def classical_variants(spark, sf_dir):
    return lg.classical_variants(variants(spark, sf_dir)).select("variant", "n_cases", "n_traces")


@query
def executed_projection(spark, sf_dir):
    return derived_traces(spark, sf_dir).select("case_id", ab.variant_text(T).alias("variant"))


@query
def executed_activities(spark, sf_dir):
    return lg.activities(variants(spark, sf_dir))


@query
def sublog_top_views(spark, sf_dir):
    found = assigned(spark, sf_dir)
    return lg.sublog(found, found.where(V("label").isin("C1", "C2", "C3")).select("trace_id")).select(ab.trace_text(T).alias("trace"), "n_cases")


@query
def project_log(spark, sf_dir):
    return lg.project_log(variants(spark, sf_dir), ["click", "purchase", "view"]).select(ab.trace_text(T).alias("trace"), "n_cases", "first_ord")


@query
def split_enabled_parse(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat_ws(" | ", "event_type", F.lit(" "), F.when(V("event_id") % 2 == 0, F.lit("view ")), "event_type", F.lit("")).alias("cell"))
    return raw.select("event_id", F.array_join(parse_set(V("cell"), "|"), ",").alias("en"))


@query
def event_records(spark, sf_dir):
    from ..sources.logs import event_records as records

    r = records(derived_traces(spark, sf_dir))
    return r.select(V("`case:concept:name`").alias("case_id"), V("`concept:name`").alias("a"), F.date_format("`time:timestamp`", "yyyy-MM-dd HH:mm:ss").alias("stamp"), V("enabled_activities").alias("en"))


@query
def successor_enabled(spark, sf_dir):
    s = lg.steps_of(variants(spark, sf_dir))
    return s.groupBy("a", F.array_join("en", ",").alias("en"), F.array_join("nx", ",").alias("nx")).agg(F.sum("n_cases").alias("n_cases"))


@query
def local_choice(spark, sf_dir):
    s = variants(spark, sf_dir).select("n_cases", F.explode(ab.steps(T)).alias("s"))
    return s.groupBy(F.array_join("s.c", ",").alias("choice"), F.array_join("s.k", ",").alias("kept")).agg(F.sum("n_cases").alias("n_cases"))


@query
def local_block(spark, sf_dir):
    s = variants(spark, sf_dir).select("n_cases", F.explode(ab.steps(T)).alias("s"))
    return s.groupBy(ab.block(V("s.c")).alias("block")).agg(F.sum("n_cases").alias("n_cases"))


@query
def supports_parallel_pairs(spark, sf_dir):
    v = variants(spark, sf_dir)
    return lg.pair_support(v).join(v.select("trace_id", ab.trace_text(T).alias("trace")), "trace_id").where("ok").select("trace", "i", "j")


def decomposition(kind):
    def run(spark, sf_dir):
        return variants(spark, sf_dir).select(ab.trace_text(T).alias("text"), ab.interval_text(T, kind).alias("intervals")).withColumnRenamed("text", "trace")

    run.__name__ = f"decomposition_{kind}"
    return query(run)


for _kind in ab.DECOMPOSITIONS:
    decomposition(_kind)


@query
def kappa_per_case(spark, sf_dir):
    return derived_traces(spark, sf_dir).select("case_id", ab.kappa(T).alias("kappa"))


@query
def induce_views(spark, sf_dir):
    return vw.induce_views(variants(spark, sf_dir))


@query
def induce_views_rightmost(spark, sf_dir):
    return vw.induce_views(variants(spark, sf_dir), "rightmost").select("label", "kappa", "n_cases")


@query
def induce_views_shortest(spark, sf_dir):
    return vw.induce_views(variants(spark, sf_dir), "shortest").select("label", "kappa", "n_cases")


@query
def order_views(spark, sf_dir):
    return vw.induce_views(lg.variants_of(order_traces(spark, sf_dir))).select("label", "kappa", "n_cases", "n_traces")


@query
def assign_view(spark, sf_dir):
    return assigned(spark, sf_dir).select(ab.trace_text(T).alias("trace"), "label")


@query
def crosstab_long(spark, sf_dir):
    return vw.crosstab(assigned(spark, sf_dir))


@query
def view_coverage(spark, sf_dir):
    return vw.induce_views(variants(spark, sf_dir)).select("label", "coverage")


@query
def view_screen_map(spark, sf_dir):
    return vw.screen_map(assigned(spark, sf_dir))


@query
def only_here(spark, sf_dir):
    return vw.only_here(assigned(spark, sf_dir))


@query
def enabled_heatmap(spark, sf_dir):
    return lg.enabled_by_position(variants(spark, sf_dir))


def coarsening(name):
    def run(spark, sf_dir):
        return variants(spark, sf_dir).groupBy(ab.COARSENINGS[name](T).alias("key")).agg(F.sum("n_cases").alias("n_cases"))

    run.__name__ = name
    return query(run)


for _name in ("kappa_multiset", "kappa_set", "kappa_acts"):
    coarsening(_name)


@query
def start_acts(spark, sf_dir):
    return rel.start_activities(steps(spark, sf_dir))


@query
def end_acts(spark, sf_dir):
    return rel.end_activities(steps(spark, sf_dir))


@query
def end_acts_strict(spark, sf_dir):
    return rel.end_activities(steps(spark, sf_dir), strict=True)


@query
def df_freq(spark, sf_dir):
    return rel.directly_follows(steps(spark, sf_dir))


@query
def choice_freq(spark, sf_dir):
    return rel.choice(steps(spark, sf_dir))


@query
def parallel_freq(spark, sf_dir):
    return rel.parallel(steps(spark, sf_dir))


@query
def classical_dfg(spark, sf_dir):
    return rel.classical_dfg(steps(spark, sf_dir))


@query
def translucent_dfg(spark, sf_dir):
    return rel.translucent_dfg(steps(spark, sf_dir))


@query
def frequent_tdfg(spark, sf_dir):
    return rel.frequent_translucent_dfg(steps(spark, sf_dir))


@query
def filter_infrequent(spark, sf_dir):
    return rel.filter_infrequent(rel.classical_dfg(steps(spark, sf_dir)), 0.8)


@query
def project_dfg(spark, sf_dir):
    return rel.project_dfg(rel.classical_dfg(steps(spark, sf_dir)), ["click", "view"])


@query
def footprint_jaccard(spark, sf_dir):
    by_month = derived_traces(spark, sf_dir).select(F.concat(user_label(), F.lit("-"), F.substring(F.split("case_id", "-")[1], 8, 1)).alias("group_id"), "trace")
    return rel.footprint_jaccard(rel.footprints(by_month))


@query
def variant_overlap(spark, sf_dir):
    return rel.variant_overlap(labelled(spark, sf_dir))


@query
def group_supported(spark, sf_dir):
    v = variants(spark, sf_dir)
    return gr.group_kappa_supported(v).join(v.select("trace_id", ab.trace_text(T).alias("trace")), "trace_id").select("trace", "group_id")


@query
def group_supported_solo(spark, sf_dir):
    v = variants(spark, sf_dir)
    return gr.fold_small(v, ab.kappa_acts, 0.02, "solo").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_traces"))


@query
def group_sizes(spark, sf_dir):
    v, out = variants(spark, sf_dir), None
    for name in ("global", "kappa", "kappa_acts", "classical_variants", "translucent_variants"):
        one = gr.PARTITIONS[name](v).agg(F.count_distinct("group_id").alias("n_groups")).select(F.lit(name).alias("method"), "n_groups")
        out = one if out is None else out.union(one)
    return out


@query
def ari(spark, sf_dir):
    return mt.adjusted_rand_index(cells(spark, sf_dir))


@query
def label_accuracy(spark, sf_dir):
    return mt.label_accuracy(cells(spark, sf_dir))


@query
def nmi_vmeasure(spark, sf_dir):
    return mt.recovery(cells(spark, sf_dir))


@query
def incoherence(spark, sf_dir):
    v = variants(spark, sf_dir)
    return mt.incoherence(v.select(ab.kappa_acts(T).alias("group_id"), "trace", "n_cases"))


@query
def attr_informativeness(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(V("o_orderstatus").alias("label"), "o_orderpriority", V("o_totalprice").cast("double").alias("o_totalprice"))
    return mt.attribute_informativeness(o, "o_orderpriority").union(mt.attribute_informativeness(o, "o_totalprice"))


@query
def attribute_scan(spark, sf_dir):
    """Attributes of orders with 2 to 60 values: their number and the share of the rarest of the four most frequent."""
    o, out = spark.read.parquet(f"{sf_dir}/orders.parquet"), None
    for name in ("o_orderstatus", "o_orderpriority", "o_clerk"):
        if name not in o.columns:
            continue
        counts = o.groupBy(V(name).alias("v")).count()
        ranked = counts.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("v"))))
        one = ranked.agg(F.count(F.lit(1)).alias("n_values"), F.round(F.min(F.when(V("r") <= 4, V("count"))) / F.sum("count"), 6).alias("least_share")).where("n_values between 2 and 60").select(F.lit(name).alias("attribute"), "n_values", "least_share")
        out = one if out is None else out.union(one)
    return out


@query
def top_attr_groups(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/customer.parquet").select(V("c_custkey").alias("case_id"), V("c_mktsegment").alias("value"))
    return top_groups(e, 3).groupBy("value").agg(F.count(F.lit(1)).alias("n_cases"))


@query
def first_attr_per_case(spark, sf_dir):
    from ..sources.logs import first_attribute

    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(V("l_orderkey").alias("case_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("pos"), F.when(V("l_linenumber") % 2 == 0, V("l_returnflag")).alias("flag"))
    return first_attribute(e, "flag")


@query
def two_stage_mean(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderstatus", V("o_totalprice").cast("double").alias("price"))
    return mt.two_stage_mean(o, ["o_orderpriority"], ["o_orderstatus"], "price")


@query
def weighted_mean(spark, sf_dir):
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", V("l_discount").cast("double").alias("discount"), V("l_quantity").cast("double").alias("quantity"))
    return mt.weighted_mean(i, ["l_returnflag"], "discount", "quantity")


@query
def models_to_cov_running(spark, sf_dir):
    views = vw.induce_views(variants(spark, sf_dir)).select(V("kappa").alias("group_id"), "n_cases", F.when(F.length("kappa") % 5 == 0, 0.5).otherwise(1.0).alias("fitness"))
    return mt.models_to_coverage(views)


@query
def view_confusion(spark, sf_dir):
    c = labelled(spark, sf_dir).select(V("group_id").alias("role"), ab.kappa_acts(T).alias("view"), "n_cases")
    return c.groupBy("role", "view").agg(F.sum("n_cases").alias("n_cases"))


@query
def view_lengths(spark, sf_dir):
    """Views per hidden label and trace length."""
    c = labelled(spark, sf_dir).select("group_id", F.size("trace").alias("length"), ab.kappa(T).alias("kappa"))
    return c.groupBy("group_id", "length").agg(F.count_distinct("kappa").alias("n_views"))


@query
def cf_features(spark, sf_dir):
    from ..operators.features import control_flow_tokens

    v = variants(spark, sf_dir)
    return control_flow_tokens(v).groupBy("token").agg(F.round(F.sum("value"), 5).alias("total"), F.count(F.lit(1)).alias("n_traces"))


@query
def en_features(spark, sf_dir):
    from ..operators.features import enabled_tokens

    v = variants(spark, sf_dir)
    return enabled_tokens(v).groupBy("token").agg(F.round(F.sum("value"), 5).alias("total"), F.count(F.lit(1)).alias("n_traces"))


@query
def attr_aggregate(spark, sf_dir):
    """Per variant of the order log: mean price and majority status of its cases."""
    from ..operators.features import aggregate_attributes

    t = order_traces(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(V("o_orderkey").cast("string").alias("case_id"), V("o_totalprice").cast("double").alias("price"), V("o_orderstatus").alias("status"))
    found = aggregate_attributes(t.select("case_id", ab.variant_text(T).alias("key")), o, ["price"], ["status"])
    return found.select("key", F.round("price", 7).alias("price"), "status")


def conversation_traces(spark, sf_dir):
    """The log of the conversations: roles by turn, enabled the role and the next one."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("e"))
    event = lambda e, i: F.struct(e["role"].alias("a"), F.array_sort(F.array_distinct(F.array_compact(F.array(e["role"], F.try_element_at(V("e"), (i + 2).cast("int"))["role"])))).alias("en"))
    return c.select(V("conv_id").cast("string").alias("case_id"), V("conv_id").alias("case_ord"), F.transform("e", event).alias("trace"))


@query
def conversation_views(spark, sf_dir):
    return vw.induce_views(lg.variants_of(conversation_traces(spark, sf_dir))).select("label", "kappa", "n_cases", "n_traces")
