"""Process views: variants grouped by their identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import abstraction as ab
from ..functions.checkpoints import written
from .log import activities


#: Ranges of first appearance into which views of one size are cut to be numbered.
SLICES = 64


def with_kappa(variants: DataFrame, decomposition: str = "leftmost") -> DataFrame:
    """Variants with their identifier; evaluated once per distinct trace. Variants that carry one keep it."""
    return variants if "kappa" in variants.columns else variants.withColumn("kappa", ab.kappa(F.col("trace"), decomposition))


def induce_views(variants: DataFrame, decomposition: str = "leftmost") -> DataFrame:
    """(label, kappa, n_cases, n_traces, n_variants, coverage): views by falling number of cases, then first appearance.

    Views, of which there are far fewer than variants, are written to the shared folder, and with that the folds are done. Few views are large: numbers
    of views by size are as few as there are sizes, and tell how many views stand before those of a size. Inside a size first appearance is cut into
    ranges, so that the very many views of a few cases are numbered in as many tasks.
    """
    keyed = with_kappa(variants, decomposition).select("kappa", "n_cases", "first_ord", ab.variant_text(F.col("trace")).alias("variant"))
    by_variant = keyed.groupBy("kappa", "variant").agg(F.sum("n_cases").alias("n_cases"), F.count(F.lit(1)).alias("n_traces"), F.min("first_ord").alias("first_ord"))
    views = by_variant.groupBy("kappa").agg(F.sum("n_cases").alias("n_cases"), F.sum("n_traces").alias("n_traces"), F.count(F.lit(1)).alias("n_variants"), F.min("first_ord").alias("first_ord"))
    part = F.lit(0)
    if isinstance(views.schema["first_ord"].dataType, NumericType):
        first, ends = F.col("first_ord").cast("double"), Observation()  # the ends of first appearance come with the job that writes
        views = written(views.observe(ends, F.min(first).alias("low"), F.max(first).alias("high")), "views")
        low, high = ends.get["low"], ends.get["high"]
        if low is not None:
            part = F.floor((first - low) / (high - low + 1) * SLICES).cast("int")
    else:
        views = written(views, "views")
    views = views.withColumn("part", part)
    order = Window.orderBy(F.desc("size"), F.asc("part"))
    sizes = views.groupBy(F.col("n_cases").alias("size"), "part").agg(F.count(F.lit(1)).alias("here"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("here").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(F.col("here") * F.col("size")).over(Window.partitionBy()))
    ranked = views.join(sizes.select(F.col("size").alias("n_cases"), "part", "before", "total"), ["n_cases", "part"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("n_cases", "part").orderBy("first_ord"))
    return ranked.withColumn("label", F.concat(F.lit("C"), place.cast("string"))).withColumn("coverage", F.round(F.coalesce(F.col("n_cases") / F.col("total"), F.lit(0.0)), 6)).select("label", "kappa", "n_cases", "n_traces", "n_variants", "coverage", "first_ord")


def assign_views(variants: DataFrame, views: DataFrame, decomposition: str = "leftmost") -> DataFrame:
    """Variants with the label of their view."""
    return with_kappa(variants, decomposition).join(views.select("kappa", "label"), "kappa")


def cases_by_view(assigned: DataFrame) -> DataFrame:
    """(case_id, label) for variants that carry their case ids."""
    return assigned.select(F.explode("case_ids").alias("case_id"), "label")


def crosstab(assigned: DataFrame) -> DataFrame:
    """(variant, label, n_cases) in long form."""
    return assigned.groupBy(ab.variant_text(F.col("trace")).alias("variant"), "label").agg(F.sum("n_cases").alias("n_cases"))


def crosstab_wide(assigned: DataFrame, labels: list[str]) -> DataFrame:
    """Variants by the given labels, 0 where a view has no case."""
    return assigned.groupBy(ab.variant_text(F.col("trace")).alias("variant")).pivot("label", labels).agg(F.sum("n_cases")).fillna(0).orderBy("variant")


def view_sublogs(assigned: DataFrame) -> DataFrame:
    """Variants keyed by view: one table instead of one log per view."""
    return assigned.select("label", "trace_id", "trace", "n_cases", "first_ord")


def screen_map(assigned: DataFrame) -> DataFrame:
    """(label, a): activities of the log that are enabled somewhere in a view."""
    return assigned.select("label", F.explode(F.flatten(F.transform("trace", lambda e: e["en"]))).alias("a")).distinct().join(activities(assigned), "a", "left_semi").select("label", "a")


def only_here(assigned: DataFrame) -> DataFrame:
    """(label, a): activities enabled in one view and in no other."""
    enabled = assigned.select("label", F.explode(F.flatten(F.transform("trace", lambda e: e["en"]))).alias("a"))
    return enabled.groupBy("a").agg(F.min("label").alias("label"), F.max("label").alias("_last")).where("label = _last").select("label", "a")
