"""Activity relations over consecutive events, with enabled sets cut to the executed activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import abstraction as ab
from .log import activities, steps_of


def universe_steps(variants: DataFrame) -> DataFrame:
    """Steps with enabled sets cut to the executed activities.

    The universe is the alphabet of the log, one row after aggregation; it joins as a single array.
    """
    universe = activities(variants).agg(F.array_sort(F.collect_list("a")).alias("universe"))
    joined = steps_of(variants).crossJoin(F.broadcast(universe))
    return joined.withColumn("en", F.array_intersect("en", "universe")).withColumn("nx", F.array_intersect("nx", "universe"))


def start_activities(steps: DataFrame) -> DataFrame:
    """(a, w): activities enabled at the first event, by cases."""
    return steps.where("pos = 1").select(F.explode("en").alias("a"), "n_cases").groupBy("a").agg(F.sum("n_cases").alias("w"))


def end_activities(steps: DataFrame, strict: bool = False) -> DataFrame:
    """(a, w): activities enabled at the last event; ``strict`` keeps those that some case really ends with."""
    last = steps.where("pos = len")
    enabled = last.select(F.explode("en").alias("a"), "n_cases").groupBy("a").agg(F.sum("n_cases").alias("w"))
    return enabled.join(last.select("a").distinct(), "a", "left_semi") if strict else enabled


def _pairs(steps: DataFrame, offered) -> DataFrame:
    return steps.where("pos < len").select(F.col("a").alias("x"), F.explode(offered).alias("a"), "n_cases").groupBy("x", "a").agg(F.sum("n_cases").alias("w"))


def directly_follows(steps: DataFrame) -> DataFrame:
    """(x, a, w): a is enabled right after x."""
    return _pairs(steps, F.col("nx"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Symmetric closure by adding both directions; a pair of an activity with itself counts twice."""
    return pairs.union(pairs.select(F.col("a").alias("x"), F.col("x").alias("a"), "w")).groupBy("x", "a").agg(F.sum("w").alias("w"))


def choice(steps: DataFrame) -> DataFrame:
    """(x, a, w): a was enabled with x and is gone after it."""
    return _both_ways(_pairs(steps, F.array_except("en", "nx")))


def parallel(steps: DataFrame) -> DataFrame:
    """(x, a, w): a was enabled with x and still is after it."""
    return _both_ways(_pairs(steps, F.array_intersect("en", "nx")))


def classical_dfg(steps: DataFrame) -> DataFrame:
    """(kind, src, dst, w): executed edges, starts and ends, by cases."""
    edges = steps.where("pos < len").groupBy(F.lit("edge").alias("kind"), F.col("a").alias("src"), F.col("next_a").alias("dst")).agg(F.sum("n_cases").alias("w"))
    starts = steps.where("pos = 1").groupBy(F.lit("start").alias("kind"), F.lit("").alias("src"), F.col("a").alias("dst")).agg(F.sum("n_cases").alias("w"))
    ends = steps.where("pos = len").groupBy(F.lit("end").alias("kind"), F.col("a").alias("src"), F.lit("").alias("dst")).agg(F.sum("n_cases").alias("w"))
    return edges.union(starts).union(ends)


def _marked(kind: str, rows: DataFrame, weight) -> DataFrame:
    if kind == "edge":
        return rows.select(F.lit("edge").alias("kind"), F.col("x").alias("src"), F.col("a").alias("dst"), weight.alias("w"))
    a, none = F.col("a"), F.lit("")
    return rows.select(F.lit(kind).alias("kind"), (none if kind == "start" else a).alias("src"), (a if kind == "start" else none).alias("dst"), weight.alias("w"))


def translucent_dfg(steps: DataFrame, strict_end: bool = False) -> DataFrame:
    """(kind, src, dst, w): directly-follows and parallel pairs, 1 for each of the two relations that holds."""
    one = F.lit(1).cast("long")
    edges = _marked("edge", directly_follows(steps), one).union(_marked("edge", parallel(steps), one)).groupBy("kind", "src", "dst").agg(F.sum("w").alias("w"))
    return edges.union(_marked("start", start_activities(steps), one)).union(_marked("end", end_activities(steps, strict_end), one))


def frequent_translucent_dfg(steps: DataFrame, subtract_choice: bool = True) -> DataFrame:
    """(kind, src, dst, w): directly-follows plus parallel less choice counts, where more than 0 is left.

    Choice only lowers pairs of the other two relations, as signed rows of one aggregation.
    """
    signed = directly_follows(steps).select("x", "a", "w", F.lit(1).alias("named")).union(parallel(steps).select("x", "a", "w", F.lit(1)))
    if subtract_choice:
        signed = signed.union(choice(steps).select("x", "a", -F.col("w"), F.lit(0)))
    edges = signed.groupBy("x", "a").agg(F.sum("w").alias("w"), F.max("named").alias("named")).where("named = 1 and w > 0")
    return _marked("edge", edges, F.col("w")).union(_marked("start", start_activities(steps), F.col("w"))).union(_marked("end", end_activities(steps), F.col("w")))


def filter_infrequent(dfg: DataFrame, threshold: float) -> DataFrame:
    """Edges of at least ``threshold`` times their source's strongest; a node that lost all incoming edges gets its
    strongest back (ties: smaller source); markers by their own maximum. 0 or less changes nothing."""
    if threshold <= 0:
        return dfg
    edges, markers = dfg.where("kind = 'edge'"), dfg.where("kind <> 'edge'")
    strongest = Window.partitionBy("src")
    kept = edges.withColumn("m", F.max("w").over(strongest)).withColumn("keep", F.col("w") >= F.lit(threshold) * F.col("m"))
    incoming = Window.partitionBy("dst")
    ranked = kept.withColumn("any", F.max(F.col("keep").cast("int")).over(incoming)).withColumn("best", F.row_number().over(incoming.orderBy(F.desc("w"), F.asc("src"))))
    good = ranked.where("keep or (any = 0 and best = 1)").select(dfg.columns)
    own = Window.partitionBy("kind")
    return good.union(markers.withColumn("m", F.max("w").over(own)).where(F.col("w") >= F.lit(threshold) * F.col("m")).select(dfg.columns))


def project_dfg(dfg: DataFrame, keep: list[str]) -> DataFrame:
    inside = lambda c: F.col(c).isin([*keep, ""])
    return dfg.where(inside("src") & inside("dst"))


def successors(dfg: DataFrame, a: str) -> DataFrame:
    return dfg.where((F.col("kind") == "edge") & (F.col("src") == a)).select(F.col("dst").alias("a"))


def predecessors(dfg: DataFrame, a: str) -> DataFrame:
    return dfg.where((F.col("kind") == "edge") & (F.col("dst") == a)).select(F.col("src").alias("a"))


def footprints(grouped: DataFrame) -> DataFrame:
    """(group_id, src, dst): distinct executed pairs of each group of traces (group_id, trace)."""
    acts = ab.executed(F.col("trace"))
    pairs = F.arrays_zip(F.slice(acts, 1, F.greatest(F.size(acts) - 1, F.lit(0))).alias("src"), F.slice(acts, 2, F.greatest(F.size(acts) - 1, F.lit(0))).alias("dst"))
    return grouped.select("group_id", F.explode(pairs).alias("p")).select("group_id", F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).distinct()


def footprint_jaccard(prints: DataFrame) -> DataFrame:
    """(g, h, jaccard) of each two groups' footprints; pairs that share nothing included."""
    sizes = prints.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = prints.alias("a"), prints.alias("b")
    shared = a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst")) & (F.col("a.group_id") < F.col("b.group_id"))).groupBy(F.col("a.group_id").alias("g"), F.col("b.group_id").alias("h")).agg(F.count(F.lit(1)).alias("both"))
    left, right = sizes.select(F.col("group_id").alias("g"), F.col("n").alias("n_g")), sizes.select(F.col("group_id").alias("h"), F.col("n").alias("n_h"))
    pairs = left.join(right, F.col("g") < F.col("h")).join(shared, ["g", "h"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return pairs.select("g", "h", F.round(F.col("both") / F.greatest(F.lit(1), F.col("n_g") + F.col("n_h") - F.col("both")), 6).alias("jaccard"))


def variant_overlap(cases: DataFrame) -> DataFrame:
    """Share of cases (group_id, trace, n_cases) whose executed sequence occurs in more than one group."""
    keyed = cases.groupBy(ab.variant_text(F.col("trace")).alias("variant"), "group_id").agg(F.sum("n_cases").alias("n"))
    per = keyed.groupBy("variant").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    return per.agg(F.round(F.sum(F.when(F.col("groups") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("overlap"))
