"""Peak concurrency: how many intervals are open at every moment, by group, from two levels of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted

MINUTE, DAY, WEEK = 60, 86_400, 7 * 86_400
#: The group that counts all intervals, and the group of those without one.
ALL, NONE = -2, -1
#: A key with more than one row in so many is hot: there are fewer hot keys than that, so their values may be broadcast.
HOT_SHARE = 256


def utc_seconds(name: str, step: int = MINUTE) -> Column:
    """Seconds since 1970 of a time without a zone, taken as UTC, rounded down to multiples of ``step``, before 1970 too."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {quoted(name)})")
    return F.floor(micros / F.lit(step * 1_000_000)).cast("long") * step


def look_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row a key at most; null where there is none and for null keys.

    Values of hot keys, of which there are fewer than HOT_SHARE whatever the input, are broadcast to wherever their rows
    are. Other rows are joined by key; rows of hot and of null keys pass through that join dealt by their whole content.
    """
    names = [c for c in values.columns if c != key]
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * HOT_SHARE > F.col("_total")).select(key)
    hot = hot.join(values, key, "left").select(F.col(key).alias("_hot_key"), *(F.col(c).alias(f"_hot_{c}") for c in names))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    marked = marked.withColumn("_cold", F.when(F.col("_hot_key").isNull(), F.col(key)))
    marked = marked.withColumn("_deal", F.when(F.col("_cold").isNull(), F.xxhash64(*(quoted(c) for c in rows.columns))).otherwise(F.xxhash64("_cold")))
    own = values.select(F.xxhash64(key).alias("_own_deal"), F.col(key).alias("_own_key"), *(F.col(c).alias(f"_own_{c}") for c in names))
    found = marked.join(own, (F.col("_deal") == F.col("_own_deal")) & (F.col("_cold") == F.col("_own_key")), "left")
    picked = (F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_own_{c}")).alias(c) for c in names)
    return found.select(*(F.col(quoted(c)) for c in rows.columns), *picked)


def sweep(intervals: DataFrame, bucket: int = DAY) -> DataFrame:
    """(nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak) of intervals (nation_id, from_s, to_s, cents).

    An interval is open from ``from_s``, included, until ``to_s``, excluded, or for ever if that is null; one without a start, or
    with an end that is not after it, takes no part. A null nation counts as -1, and every interval counts again for nation -2. A row
    stands for each moment at which starts and ends together change the number open or their cents; moments that cancel out give none.

    Starts and ends are added up by nation and moment before anything is shuffled. Buckets of a nation and a day hold a row for each
    of their moments, at most 1,440 if these are minutes, however many intervals there are. Their subtotals, one row for each bucket, are scanned into what
    is carried into a bucket; joined back, running sums start from that inside each bucket. Largest values, first and last moments of
    buckets are scanned in the same way. So no window holds more than a bucket's moments or a nation's days. Equal rows are
    intervals of their own. An empty table gives none.
    """
    whole = intervals.where("from_s is not null and (to_s is null or to_s > from_s)")
    group = F.coalesce(F.col("nation_id").cast("int"), F.lit(NONE))
    point = lambda at, sign: F.struct(F.col(at).alias("from_s"), F.lit(sign).cast("long").alias("n"), (F.col("cents") * sign).alias("cents"))
    ends = whole.select(group.alias("nation_id"), F.explode(F.array(point("from_s", 1), point("to_s", -1))).alias("p")).select("nation_id", "p.*").where("from_s is not null")
    by_moment = ends.groupBy("nation_id", "from_s").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    both = by_moment.select(F.explode(F.array("nation_id", F.lit(ALL))).alias("nation_id"), "from_s", "n", "cents")
    changes = both.groupBy("nation_id", "from_s").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).where("n <> 0 or cents <> 0")
    changes = materialize(changes.withColumn("bucket", F.floor(F.col("from_s") / bucket)), "changes")

    days = Window.partitionBy("nation_id").orderBy("bucket")
    before, later = days.rowsBetween(Window.unboundedPreceding, -1), days.rowsBetween(1, 1)
    subtotals = changes.groupBy("nation_id", "bucket").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.min("from_s").alias("first_s"))
    carries = subtotals.select(
        "nation_id", "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("cents").over(before), F.lit(0)).alias("cents_before"),
        F.first("first_s").over(later).alias("next_first"),
    )
    inside = Window.partitionBy("nation_id", "bucket").orderBy("from_s")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    running = changes.join(carries.hint("merge"), ["nation_id", "bucket"]).select(
        "nation_id", "bucket", "from_s",
        F.coalesce(F.lead("from_s").over(inside), F.col("next_first")).alias("to_s"),
        (F.col("n_before") + F.sum("n").over(so_far)).alias("n_open"),
        (F.col("cents_before") + F.sum("cents").over(so_far)).alias("open_cents"),
    )
    running = materialize(running, "running")
    tops = running.groupBy("nation_id", "bucket").agg(F.max("n_open").alias("n_top"), F.max("open_cents").alias("cents_top"))
    highs = tops.select("nation_id", "bucket", F.max("n_top").over(before).alias("high_before"), F.max("cents_top").over(Window.partitionBy("nation_id")).alias("peak_cents"))
    high = F.greatest(F.max("n_open").over(so_far), F.col("high_before"))
    return running.join(highs.hint("merge"), ["nation_id", "bucket"]).select("nation_id", "from_s", "to_s", "n_open", "open_cents", high.alias("high_open"), (F.col("open_cents") == F.col("peak_cents")).alias("is_peak"))


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, stay: int = WEEK) -> DataFrame:
    """(nation_id, from_s, to_s, cents) of every sale: open from sold_at until its earliest shipped_at plus ``stay``.

    Each row of ``sales`` is a sale. Lines are brought to one time a sale before they are joined, so a sale with very many
    lines is no hot key; clients with very many sales are looked up as hot keys. Null ids match nothing; of several
    rows of one client the smallest nation counts. cents is floor(100 * total + 0.5), 0 for null, NaN and infinite totals.
    """
    shipped = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg((F.min(utc_seconds("shipped_at")) + stay).alias("to_s"))
    nations = clients.where("client_id is not null").groupBy("client_id").agg(F.min(F.col("nation_id").cast("int")).alias("nation_id"))
    total = F.col("total").cast("double")
    cents = F.when(F.abs(total) < float("inf"), F.floor(total * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
    sold = sales.where("sold_at is not null").select("sale_id", "client_id", utc_seconds("sold_at").alias("from_s"), F.coalesce(cents, F.lit(0)).alias("cents"))
    dated = look_up(sold, shipped, "sale_id")
    return look_up(dated.where("to_s is null or to_s > from_s").select("client_id", "from_s", "to_s", "cents"), nations, "client_id").select("nation_id", "from_s", "to_s", "cents")
