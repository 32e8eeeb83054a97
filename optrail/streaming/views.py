"""Views of a stream of events: a case gets its identifier once it is closed, for the last position sees no successor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import abstraction as ab


def closed_cases(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(case_id, closed, trace, kappa) of cases without an event for ``gap``, from a stream (case_id, ts, a, en).

    Session windows keep an open case's events as state, which the watermark bounds: events later than ``late`` are
    dropped and a case is sent out, once, when the watermark passes its end.
    """
    sessions = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "case_id").agg(F.collect_list(F.struct("ts", "a", "en")).alias("e"))
    trace = F.transform(F.array_sort("e"), lambda x: F.struct(x["a"].alias("a"), x["en"].alias("en")))
    traces = sessions.select("case_id", F.col("w.end").alias("closed"), trace.alias("trace"))
    return traces.select("case_id", "closed", ab.variant_text(F.col("trace")).alias("variant"), ab.kappa(F.col("trace")).alias("kappa"))


def write_view_counts(closed: DataFrame, path: str, checkpoint: str):
    """Append each batch's views and counts; a batch that is repeated writes over its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy("kappa").agg(F.count(F.lit(1)).alias("n_cases")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
