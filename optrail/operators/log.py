"""Event logs as DataFrames: traces, weighted variants and the algebra over them.

events    (case_id, case_ord, pos, a, en)            one row per event
traces    (case_id, case_ord, trace)                 one row per case
variants  (trace_id, trace, n_cases, first_ord[, case_ids])   one row per distinct trace
case_ord is anything that orders cases: row number of the first event, or the case id itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import abstraction as ab
from ..functions.sets import common, empty_set


def traces_of(events: DataFrame) -> DataFrame:
    """One array per case, ordered by position; one shuffle by case."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "a", "en")))
    grouped = events.groupBy("case_id").agg(F.min("case_ord").alias("case_ord"), ordered.alias("_e"))
    return grouped.select("case_id", "case_ord", F.transform("_e", lambda e: F.struct(e["a"].alias("a"), e["en"].alias("en"))).alias("trace"))


def variants_of(traces: DataFrame, with_ids: bool = False) -> DataFrame:
    """Distinct traces with their number of cases: whatever is computed next runs once per variant.

    The counts combine before the shuffle, so a very common trace is no hot key. Case ids are gathered only
    when asked for.
    """
    extra = [F.array_sort(F.collect_list("case_id")).alias("case_ids")] if with_ids else []
    grouped = traces.groupBy("trace").agg(F.count(F.lit(1)).alias("n_cases"), F.min("case_ord").alias("first_ord"), *extra)
    return grouped.withColumn("trace_id", F.xxhash64("trace"))


def events_of(traces: DataFrame) -> DataFrame:
    exploded = traces.select("case_id", "case_ord", F.posexplode("trace").alias("pos", "e"))
    return exploded.select("case_id", "case_ord", (F.col("pos") + 1).alias("pos"), F.col("e.a").alias("a"), F.col("e.en").alias("en"))


def steps_of(variants: DataFrame) -> DataFrame:
    """(trace_id, n_cases, pos, len, a, en, nx): consecutive events of each variant, without a window."""
    trace = F.col("trace")
    indexed = variants.select("trace_id", "n_cases", trace, F.posexplode("trace").alias("i", "e"))
    return indexed.select("trace_id", "n_cases", (F.col("i") + 1).alias("pos"), F.size("trace").alias("len"), F.col("e.a").alias("a"), F.col("e.en").alias("en"), ab.successor_enabled(trace, F.col("i")).alias("nx"), F.try_element_at(trace, (F.col("i") + 2).cast("int"))["a"].alias("next_a"))


def kpis(variants: DataFrame, with_views: bool = True) -> DataFrame:
    """One row: cases, events, executed activities, classical and translucent variants, views, mean length."""
    totals = variants.agg(
        F.sum("n_cases").alias("n_cases"),
        F.sum(F.size("trace") * F.col("n_cases")).alias("n_events"),
        F.count(F.lit(1)).alias("n_traces"),
        F.count_distinct(ab.executed(F.col("trace"))).alias("n_variants"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(ab.executed(F.col("trace"))))))).alias("n_activities"),
        *([F.count_distinct(ab.kappa(F.col("trace"))).alias("n_views")] if with_views else []),
    )
    return totals.withColumn("mean_length", F.round(F.col("n_events") / F.col("n_cases"), 6))


def activities(variants: DataFrame) -> DataFrame:
    """Executed activities; those that are only ever enabled are not among them."""
    return variants.select(F.explode(ab.executed(F.col("trace"))).alias("a")).distinct()


def invalid_events(traces: DataFrame) -> DataFrame:
    """Events whose executed activity is not in their enabled set."""
    return events_of(traces).where(~F.array_contains("en", F.col("a")))


def is_valid(trace: Column) -> Column:
    return F.forall(trace, lambda e: F.array_contains(e["en"], e["a"]))


def classical_variants(variants: DataFrame) -> DataFrame:
    return variants.groupBy(ab.variant_text(F.col("trace")).alias("variant")).agg(F.sum("n_cases").alias("n_cases"), F.count(F.lit(1)).alias("n_traces"), F.min("first_ord").alias("first_ord"))


def sublog(variants: DataFrame, kept: DataFrame) -> DataFrame:
    """The variants whose trace_id is in ``kept``, with their counts."""
    return variants.join(kept.select("trace_id"), "trace_id", "left_semi")


def project_trace(trace: Column, keep: Column) -> Column:
    """Events of kept activities, their enabled sets cut to the kept ones."""
    kept = F.filter(trace, lambda e: F.array_contains(keep, e["a"]))
    return F.transform(kept, lambda e: F.struct(e["a"].alias("a"), common(e["en"], keep).alias("en")))


def project_log(variants: DataFrame, keep: list[str]) -> DataFrame:
    """Projection onto activities; traces that fall together are counted together."""
    wanted = F.array(*(F.lit(x) for x in sorted(keep))) if keep else empty_set()
    ids = [F.array_sort(F.flatten(F.collect_list("case_ids"))).alias("case_ids")] if "case_ids" in variants.columns else []
    moved = variants.withColumn("trace", project_trace(F.col("trace"), wanted))
    return moved.groupBy("trace").agg(F.sum("n_cases").alias("n_cases"), F.min("first_ord").alias("first_ord"), *ids).withColumn("trace_id", F.xxhash64("trace"))


def changed_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of events whose enabled set differs between two logs of the same cases."""
    pair = before.select("case_id", F.col("trace").alias("x")).join(after.select("case_id", F.col("trace").alias("y")), "case_id")
    counted = pair.select(F.size(F.filter(F.zip_with("x", "y", lambda p, q: ~p["en"].eqNullSafe(q["en"])), lambda z: z)).alias("changed"), F.size("x").alias("n"))
    return counted.agg((F.sum("changed") / F.sum("n")).alias("rate"))


def enabled_by_position(variants: DataFrame) -> DataFrame:
    """Cases in which an executed activity is enabled at a position: the heat map of a log."""
    universe = activities(variants)
    cells = variants.select("n_cases", F.posexplode("trace").alias("i", "e")).select("n_cases", (F.col("i") + 1).alias("pos"), F.explode("e.en").alias("a"))
    return cells.join(universe, "a", "left_semi").groupBy("a", "pos").agg(F.sum("n_cases").alias("n_cases"))


def pair_support(variants: DataFrame) -> DataFrame:
    """(trace_id, i, j, ok) of all position pairs i < j of a variant."""
    s = variants.select("trace_id", ab.steps(F.col("trace")).alias("s"))
    left = s.select("trace_id", "s", F.explode("s").alias("x"))
    pairs = left.select("trace_id", "x", F.explode(F.filter("s", lambda y: y["i"] > F.col("x.i"))).alias("y"))
    return pairs.select("trace_id", F.col("x.i").alias("i"), F.col("y.i").alias("j"), ab.supports(F.col("x"), F.col("y")).alias("ok"))
