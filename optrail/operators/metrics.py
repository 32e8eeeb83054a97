"""Agreement of partitions, coherence of groups and how attributes inform about labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import abstraction as ab


def contingency(pairs: DataFrame) -> DataFrame:
    """(t, p, n) from one row (t, p) per case, or with weights n."""
    weight = F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))
    return pairs.groupBy("t", "p").agg(weight.alias("n"))


def _choose2(n):
    return n.cast("double") * (n.cast("double") - 1) / 2


def adjusted_rand_index(cells: DataFrame) -> DataFrame:
    """One row (ari); 1 for fewer than two cases or when chance alone explains all agreement."""
    rows, columns = cells.groupBy("t").agg(F.sum("n").alias("n")), cells.groupBy("p").agg(F.sum("n").alias("n"))
    both = cells.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0.0)).alias("idx"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    a, b = rows.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0.0)).alias("a")), columns.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0.0)).alias("b"))
    one = both.crossJoin(a).crossJoin(b).withColumn("pairs", _choose2(F.col("n")))
    expected, most = F.col("a") * F.col("b") / F.col("pairs"), (F.col("a") + F.col("b")) / 2
    return one.select(F.when((F.col("n") < 2) | (F.col("pairs") == 0), 1.0).when(most == expected, 1.0).otherwise(F.round((F.col("idx") - expected) / (most - expected), 6)).alias("ari"))


def label_accuracy(cells: DataFrame) -> DataFrame:
    """Share of cases that carry the majority label of their group; this is also the purity."""
    best = cells.groupBy("p").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.round(F.sum("best") / F.sum("n"), 6).alias("accuracy"))


def entropy_of(column: str = "n"):
    """Entropy of counts, as an aggregate."""
    total = F.sum(column)
    return F.log(total) - F.sum(F.col(column) * F.log(column)) / total


def recovery(cells: DataFrame) -> DataFrame:
    """One row: nmi (arithmetic), homogeneity, completeness, v_measure, purity; natural logarithms throughout."""
    t = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(entropy_of().alias("h_t"))
    p = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(entropy_of().alias("h_p"))
    tp = cells.agg(entropy_of().alias("h_tp"))
    purity = label_accuracy(cells).withColumnRenamed("accuracy", "purity")
    one = t.crossJoin(p).crossJoin(tp).crossJoin(purity).withColumn("mi", F.greatest(F.lit(0.0), F.col("h_t") + F.col("h_p") - F.col("h_tp")))
    tiny = 1e-12
    hom = F.when(F.col("h_t") > tiny, F.col("mi") / F.col("h_t")).otherwise(1.0)
    com = F.when(F.col("h_p") > tiny, F.col("mi") / F.col("h_p")).otherwise(1.0)
    nmi = F.when(F.col("h_t") + F.col("h_p") > tiny, 2 * F.col("mi") / (F.col("h_t") + F.col("h_p"))).otherwise(1.0)
    v = F.when(hom + com > tiny, 2 * hom * com / (hom + com)).otherwise(0.0)
    return one.select(F.round(nmi, 6).alias("nmi"), F.round(hom, 6).alias("homogeneity"), F.round(com, 6).alias("completeness"), F.round(v, 6).alias("v_measure"), "purity")


def agreement(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ari, nmi, homogeneity, completeness, v_measure, purity, n_groups) of many contingencies (keys, t, p, n) at once; the same measures as those of one."""
    size, pairs = F.sum("n"), F.sum(_choose2(F.col("n")))
    own = [F.col(k) for k in keys]
    t = cells.groupBy(*own, "t").agg(size.alias("n")).groupBy(*own).agg(pairs.alias("a"), entropy_of().alias("h_t"))
    p = cells.groupBy(*own, "p").agg(size.alias("n"), F.max("n").alias("best")).groupBy(*own).agg(pairs.alias("b"), entropy_of().alias("h_p"), (F.sum("best") / size).alias("purity"), F.count(F.lit(1)).alias("n_groups"))
    both = cells.groupBy(*own).agg(pairs.alias("idx"), entropy_of().alias("h_tp"), size.alias("n"))
    one = both.join(t, keys).join(p, keys).withColumn("mi", F.greatest(F.lit(0.0), F.col("h_t") + F.col("h_p") - F.col("h_tp")))
    expected, most, tiny = F.col("a") * F.col("b") / F.greatest(_choose2(F.col("n")), F.lit(1.0)), (F.col("a") + F.col("b")) / 2, 1e-12
    ari = F.when((F.col("n") < 2) | (most == expected), 1.0).otherwise((F.col("idx") - expected) / (most - expected))
    hom = F.when(F.col("h_t") > tiny, F.col("mi") / F.col("h_t")).otherwise(1.0)
    com = F.when(F.col("h_p") > tiny, F.col("mi") / F.col("h_p")).otherwise(1.0)
    nmi = F.when(F.col("h_t") + F.col("h_p") > tiny, 2 * F.col("mi") / (F.col("h_t") + F.col("h_p"))).otherwise(1.0)
    v = F.when(hom + com > tiny, 2 * hom * com / (hom + com)).otherwise(0.0)
    named = {"ari": ari, "nmi": nmi, "homogeneity": hom, "completeness": com, "v_measure": v, "purity": F.col("purity")}
    return one.select(*own, *(F.round(c, 6).alias(n) for n, c in named.items()), "n_groups")


def incoherence_by(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """``incoherence`` of many groupings (keys, group_id, trace, n_cases) at once."""
    return incoherence_of(grouped.select(*keys, "group_id", "n_cases", ab.variant_text(F.col("trace")).alias("variant"), ab.trace_text(F.col("trace")).alias("sig")), keys)


def incoherence_of(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """``incoherence_by`` of (keys, group_id, variant, sig, n_cases), the texts of traces."""
    keyed = grouped.groupBy(*keys, "group_id", "variant", "sig").agg(F.sum("n_cases").alias("n"))
    per = keyed.groupBy(*keys, "group_id", "variant").agg(F.count(F.lit(1)).alias("sigs"), F.sum("n").alias("n"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    return per.groupBy(*keys).agg(F.round(F.avg("sigs"), 6).alias("mean_signatures"), F.max("sigs").alias("max_signatures"), F.round(F.sum(F.col("h") * F.col("n")) / F.sum("n"), 6).alias("entropy"))


def incoherence(grouped: DataFrame) -> DataFrame:
    """One row over (group_id, trace, n_cases): mean and largest number of enabled signatures of a group's
    executed variant, and the mean entropy in bits of the signatures of such a variant, by cases."""
    keyed = grouped.groupBy("group_id", ab.variant_text(F.col("trace")).alias("variant"), ab.trace_text(F.col("trace")).alias("sig")).agg(F.sum("n_cases").alias("n"))
    per = keyed.groupBy("group_id", "variant").agg(F.count(F.lit(1)).alias("sigs"), F.sum("n").alias("n"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    return per.agg(F.round(F.avg("sigs"), 6).alias("mean_signatures"), F.max("sigs").alias("max_signatures"), F.round(F.sum(F.col("h") * F.col("n")) / F.sum("n"), 6).alias("entropy"))


#: Parts into which a range is cut to find what lies at a rank.
PARTS = 256


def quantiles(values: DataFrame, column: str, shares: tuple[float, ...]) -> list[float]:
    """Exact quantiles with linear interpolation, as one would read them off the sorted values; none for no values. Null, NaN and infinite values do not count.

    Every rank that is asked for has a range in which its value lies, at first that of all values. A pass counts the values of all ranges by equal parts; the part
    that holds the rank, from its smallest to its largest value, is the range of the next pass, until both are one. A pass sends PARTS rows a range at most.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("abs(v) < double('infinity')")
    whole = v.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole.n:
        return []
    places = [(whole.n - 1) * p for p in shares]
    ranges = {int(r): (whole.lo, whole.hi, 0) for h in places for r in (math.floor(h), math.ceil(h))}  # from, to, values before
    while True:
        open_ = sorted({(lo, hi) for lo, hi, _ in ranges.values() if lo < hi})
        if not open_:
            break
        found: dict[tuple[float, float], list] = {r: [] for r in open_}
        share = lambda lo, hi: (F.col("v") - lo) / (hi - lo) if hi - lo < math.inf else (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
        part = lambda lo, hi: F.when(F.col("v").between(lo, hi), F.least(F.floor(share(lo, hi) * PARTS), F.lit(PARTS - 1)).cast("int"))
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), part(lo, hi).alias("part")) for i, (lo, hi) in enumerate(open_))))
        counted = v.select("v", cells.alias("c")).where("c.part is not null").groupBy("c.i", "c.part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counted.collect()):
            found[open_[r.i]].append((r.lo, r.hi, r.n))
        for rank, (lo, hi, before) in ranges.items():
            for low, high, n in found.get((lo, hi), ()):
                if rank < before + n:
                    ranges[rank] = low, high, before
                    break
                before += n
    at = lambda h: ranges[math.floor(h)][0] + (ranges[math.ceil(h)][0] - ranges[math.floor(h)][0]) * (h - math.floor(h))
    return [at(h) for h in places]


def quantile_bins(values: DataFrame, column: str) -> DataFrame:
    """``values`` with ``bin``: right-open intervals between the distinct 20, 40, 60 and 80 % quantiles."""
    cuts = sorted(set(quantiles(values, column, (0.2, 0.4, 0.6, 0.8))))
    return values.withColumn("bin", sum((F.when(F.col(column) >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("string"))


def attribute_informativeness(cases: DataFrame, attribute: str, label: str = "label") -> DataFrame:
    """(attribute, nmi): what an attribute tells about the label; numbers are binned by quantiles."""
    numeric = dict(cases.dtypes)[attribute] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(cases.dtypes)[attribute].startswith("decimal")
    values = quantile_bins(cases.where(F.col(attribute).isNotNull()), attribute) if numeric else cases.withColumn("bin", F.col(attribute).cast("string"))
    return recovery(contingency(values.select(F.col(label).alias("t"), F.col("bin").alias("p")))).select(F.lit(attribute).alias("attribute"), "nmi")


def harmonic(a, b):
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(2 * a * b / (a + b))


def models_to_coverage(models: DataFrame, share: float = 0.9, fit: float = 0.98) -> DataFrame:
    """(rank, group_id, n_cases, covered, needed) of models by size; fitting models count until ``share`` is covered.

    One row per model passes through the window.
    """
    order = Window.orderBy(F.desc("n_cases"), F.asc("group_id"))
    usable = models.withColumn("good", F.when(F.col("fitness") >= fit, F.col("n_cases")).otherwise(0))
    run = usable.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("covered", F.sum("good").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n_cases").over(Window.partitionBy()))
    return run.withColumn("needed", (F.col("covered") - F.col("good")) <= F.col("total") * share).select("rank", "group_id", "n_cases", "covered", "needed")


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(F.sum(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)) * F.col(weight)) / F.sum(weight), 6).alias(value))


def two_stage_mean(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean over ``outer`` of the means over ``inner``."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.round(F.avg("_m"), 6).alias(value))


def spread(rows: DataFrame, keys: list[str], value: str, along: str) -> DataFrame:
    """(keys, mean, std, max_deviation, slope): how a value varies over runs, and how it changes along a number such as a seed or a size."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    joined = rows.join(mean, keys) if keys else rows.crossJoin(mean)
    return joined.groupBy(*keys).agg(
        F.round(F.first("mean"), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), 6).alias("std"),
        F.round(F.max(F.abs(F.col(value) - F.col("mean"))), 6).alias("max_deviation"),
        F.round(F.coalesce(F.regr_slope(value, along), F.lit(0.0)), 6).alias("slope"),
    )


def combined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two summaries side by side; keys that only one of them has stay, with nulls in the other's columns."""
    return left.join(right, keys, "full_outer")


def pivoted(rows: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Means of a value with one column for each of the given ``values``."""
    return rows.groupBy(*keys).agg(*(F.round(F.avg(F.when(F.col(column) == v, F.col(value))), 6).alias(v) for v in values))
