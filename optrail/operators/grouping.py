"""Competing groupings of distinct traces: one row (trace_id, group_id) each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import abstraction as ab
from ..functions.checkpoints import written


def by_key(variants: DataFrame, key: Column) -> DataFrame:
    return variants.select("trace_id", key.alias("group_id"))


def group_global(variants: DataFrame) -> DataFrame:
    return by_key(variants, F.lit("all"))


def group_kappa(variants: DataFrame) -> DataFrame:
    return by_key(variants, ab.kappa(F.col("trace")))


def group_kappa_acts(variants: DataFrame) -> DataFrame:
    return by_key(variants, ab.kappa_acts(F.col("trace")))


def group_classical(variants: DataFrame) -> DataFrame:
    return by_key(variants, ab.variant_text(F.col("trace")))


def group_translucent(variants: DataFrame) -> DataFrame:
    return by_key(variants, ab.trace_text(F.col("trace")))


def profiles(keyed: DataFrame, key: str) -> DataFrame:
    """(key, a, n): how often an activity is enabled over the distinct traces of a key."""
    return keyed.select(key, F.explode(F.flatten(F.transform("trace", lambda e: e["en"]))).alias("a")).groupBy(key, "a").agg(F.count(F.lit(1)).alias("n"))


def fold_small(variants: DataFrame, key: Callable[[Column], Column] = ab.kappa, theta: float = 0.01, fallback: str = "nearest") -> DataFrame:
    """(trace_id, group_id): groups of at least ``theta`` of all cases stay; a trace of another goes to the kept group whose
    profile of enabled activities has the highest cosine with its own (ties: smaller identifier), or, with
    ``fallback`` "solo", keeps its own key. If no group is large enough, the largest stays (ties: larger identifier).

    Kept groups are at most 1 / theta, so their profiles have a size bound: they are one row, which is broadcast, and one expression over a trace finds its
    group. The key is worked out once: traces with their keys are written to the shared folder.
    """
    if fallback not in ("nearest", "solo"):
        raise ValueError(f"unknown fallback {fallback!r}")
    keyed = variants.select("trace_id", "trace", "n_cases", key(F.col("trace")).alias("key"))
    keyed = written(keyed, "keyed")
    sizes = keyed.groupBy("key").agg(F.sum("n_cases").alias("n"))
    whole = sizes.agg(F.sum("n").alias("total"), F.max(F.struct("n", "key")).alias("top"))
    least = F.lit(theta) * F.col("total")
    kept = sizes.crossJoin(F.broadcast(whole)).where((F.col("n") >= least) | ((F.col("top.n") < least) & (F.col("key") == F.col("top.key")))).select("key")
    marked = keyed.join(F.broadcast(kept.withColumn("large", F.lit(True))), "key", "left")
    if fallback == "solo":
        return marked.select("trace_id", F.col("key").alias("group_id"))
    large = profiles(marked.where("large"), "key").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("times"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    known = large.agg(F.collect_list(F.struct("key", "times", "norm")).alias("known"))
    acts = F.flatten(F.transform("trace", lambda e: e["en"]))
    score = lambda g: F.round(F.aggregate(acts, F.lit(0).cast("long"), lambda s, a: s + F.coalesce(F.try_element_at(g["times"], a), F.lit(0))) / g["norm"], 9)
    nearest = F.array_min(F.transform("known", lambda g: F.struct((-score(g)).alias("score"), g["key"].alias("key"))))["key"]
    lowest = kept.agg(F.min("key").alias("low"))  # where no kept group enables anything
    rest = marked.where("large is null").crossJoin(F.broadcast(known)).crossJoin(F.broadcast(lowest))
    moved = rest.select("trace_id", F.coalesce(nearest, "low").alias("group_id"))
    return marked.where("large").select("trace_id", F.col("key").alias("group_id")).union(moved)


def group_kappa_supported(variants: DataFrame, theta: float = 0.01) -> DataFrame:
    return fold_small(variants, ab.kappa, theta)


def case_labels(groups: DataFrame, variants: DataFrame) -> DataFrame:
    """(case_id, group_id) for variants that carry their case ids."""
    return groups.join(variants.select("trace_id", F.explode("case_ids").alias("case_id")), "trace_id").select("case_id", "group_id")


def group_sublogs(groups: DataFrame, variants: DataFrame) -> DataFrame:
    return variants.join(groups, "trace_id")


#: Groupings by name; each takes variants.
PARTITIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "global": group_global,
    "kappa": group_kappa,
    "kappa_supported": group_kappa_supported,
    "kappa_acts": group_kappa_acts,
    "classical_variants": group_classical,
    "translucent_variants": group_translucent,
}


def held_out_draw(trace: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 by a digest of a trace's text; traces below a share are for training."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), ab.trace_text(trace)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1000)) / 1000


def held_out_coverages(variants: DataFrame, keys: dict[str, Callable[[Column], Column]], shares: tuple[float, ...], seed: int = 0) -> DataFrame:
    """(key, share, coverage) for every named key and share: share of held-out cases whose key occurs in training. Keys are worked out once a trace and counted in one pass."""
    trace = F.col("trace")
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), f(trace).alias("key")) for i, f in enumerate(keys.values()))))
    keyed = variants.select("n_cases", held_out_draw(trace, seed).alias("draw"), named.alias("k")).select("n_cases", "draw", "k.i", "k.key")
    held = lambda s: F.sum(F.when(F.col("draw") >= s, F.col("n_cases")))
    per = keyed.groupBy("i", "key").agg(*(F.max(F.col("draw") < s).alias(f"seen{j}") for j, s in enumerate(shares)), *(held(s).alias(f"n{j}") for j, s in enumerate(shares)))
    of = lambda i, j, hit: F.coalesce(F.sum(F.when((F.col("i") == i) & (F.col("key").isNotNull() & F.col(f"seen{j}") if hit else F.lit(True)), F.col(f"n{j}"))), F.lit(0))
    rows = [F.struct(F.lit(name).alias("key"), F.lit(s).alias("share"), of(i, j, True).alias("hit"), of(i, j, False).alias("n")) for i, name in enumerate(keys) for j, s in enumerate(shares)]
    all_ = per.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r"))
    return all_.select("r.key", "r.share", F.when(F.col("r.n") > 0, F.round(F.col("r.hit") / F.col("r.n"), 6)).otherwise(0.0).alias("coverage"))


def held_out_coverage(variants: DataFrame, key: Callable[[Column], Column] = ab.kappa, share: float = 0.7, seed: int = 0) -> DataFrame:
    """One row: share of held-out cases whose key occurs in training, by a split of traces on a digest of their text."""
    return held_out_coverages(variants, {"key": key}, (share,), seed).select("coverage")
