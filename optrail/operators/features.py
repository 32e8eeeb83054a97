"""Features of distinct traces as sparse (trace_id, token, value) rows, and dense standardised vectors of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import abstraction as ab


def _counted(variants: DataFrame, tokens) -> DataFrame:
    rows = variants.select("trace_id", F.greatest(F.size("trace"), F.lit(1)).alias("n"), F.explode(tokens).alias("token"))
    return rows.groupBy("trace_id", "token").agg((F.count(F.lit(1)) / F.first("n")).alias("value"))


def control_flow_tokens(variants: DataFrame) -> DataFrame:
    """Shares of activities and of executed pairs, and the length."""
    acts = ab.executed(F.col("trace"))
    rest = F.greatest(F.size(acts) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(acts, 1, rest), F.slice(acts, 2, rest), lambda x, y: F.concat(F.lit("df:"), x, F.lit(">"), y))
    tokens = F.concat(F.transform(acts, lambda a: F.concat(F.lit("a:"), a)), pairs)
    length = variants.select("trace_id", F.lit("len").alias("token"), F.size("trace").cast("double").alias("value"))
    return _counted(variants, tokens).union(length)


def enabled_tokens(variants: DataFrame) -> DataFrame:
    """Shares of enabled activities and of enabled sets."""
    bags = F.transform(F.flatten(F.transform("trace", lambda e: e["en"])), lambda a: F.concat(F.lit("en:"), a))
    sets = F.transform("trace", lambda e: F.concat(F.lit("sig:"), F.array_join(e["en"], "+")))
    return _counted(variants, F.concat(bags, sets))


def standardised(tokens: DataFrame, traces: DataFrame) -> DataFrame:
    """(trace_id, features): dense z-scores with population deviations, 0 deviation counting as 1.

    Tokens are the vocabulary of a log, in order; with their means and deviations they are one row, which is broadcast, and one
    expression over it makes a vector. A token that a trace does not have counts as 0.
    """
    ids = traces.select("trace_id").distinct()
    count = ids.agg(F.count(F.lit(1)).alias("count"))
    stats = tokens.groupBy("token").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(F.broadcast(count))
    mean = F.col("s") / F.col("count")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("count") - mean * mean, F.lit(0.0)))
    vocabulary = stats.select("token", mean.alias("mean"), F.when(spread > 1e-9, spread).otherwise(1.0).alias("spread")).agg(F.array_sort(F.collect_list(F.struct("token", "mean", "spread"))).alias("vocabulary"))
    cells = tokens.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("own"))
    score = lambda x: (F.coalesce(F.try_element_at("own", x["token"]), F.lit(0.0)) - x["mean"]) / x["spread"]
    return ids.join(cells, "trace_id", "left").crossJoin(F.broadcast(vocabulary)).select("trace_id", F.transform("vocabulary", score).alias("features"))


def context_vectors(variants: DataFrame) -> DataFrame:
    """Control-flow and enabled features side by side."""
    both = control_flow_tokens(variants).union(enabled_tokens(variants))
    return standardised(both, variants)


def aggregate_attributes(keyed: DataFrame, attributes: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Per key of (case_id, key): means of numbers and majorities of categories (ties: smaller); missing 0.0 and "?"."""
    rows = keyed.join(attributes, "case_id", "left")
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in numeric]
    modes = [F.coalesce(F.mode(c, True), F.lit("?")).alias(c) for c in categorical]
    return rows.groupBy("key").agg(*means, *modes)


def attribute_tokens(per_key: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(trace_id, token, value) of aggregated attributes, categories as one-hot."""
    parts = [F.struct(F.lit(f"num:{c}").alias("token"), F.col(c).cast("double").alias("value")) for c in numeric]
    parts += [F.struct(F.concat(F.lit(f"cat:{c}="), F.col(c)).alias("token"), F.lit(1.0).alias("value")) for c in categorical]
    return per_key.select(F.col("key").alias("trace_id"), F.explode(F.array(*parts)).alias("p")).select("trace_id", "p.token", "p.value")
