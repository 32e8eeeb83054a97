"""Sources: event tables, CSV and XES files, and the logs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sets import as_set, detect_enabled, parse_set, with_executed

CASE, ACTIVITY, TIME = "case:concept:name", "concept:name", "time:timestamp"
#: Activities of the derived log, in the order in which decoys are drawn from them.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def from_table(df: DataFrame, enabled: str | None = None, separator: str = ",", case: str = CASE, activity: str = ACTIVITY, timestamp: str = TIME, order: str | None = None) -> DataFrame:
    """A flat event table as events (case_id, case_ord, pos, a, en).

    The enabled column is found by name if it is not given; its cells are separated text or arrays, null is empty,
    and the executed activity always belongs to the set. With a timestamp column events are ordered by case and
    time, ties and tables without one by ``order``, a column that numbers the rows of the source (made from the
    file's own order if it is not given). Cases come in the order of their ids with timestamps, else of their
    first rows. Rows without a case vanish.
    """
    enabled = enabled or detect_enabled(df.columns)
    if enabled is None:
        raise ValueError(f"no enabled column among {df.columns}")
    numbered = df.withColumn("_row", F.col(f"`{order}`") if order else F.monotonically_increasing_id()).where(F.col(f"`{case}`").isNotNull())
    cell = F.col(f"`{enabled}`")
    kind = dict(df.dtypes)[enabled]
    parsed = as_set(cell.cast("array<string>")) if kind.startswith("array") else parse_set(cell.cast("string"), separator)
    act = F.col(f"`{activity}`").cast("string")
    timed = timestamp in df.columns
    in_case = Window.partitionBy("case_id").orderBy(*([F.col("_ts"), F.col("_row")] if timed else [F.col("_row")]))
    rows = numbered.select(F.col(f"`{case}`").cast("string").alias("case_id"), F.col("_row"), *([F.col(f"`{timestamp}`").alias("_ts")] if timed else []), act.alias("a"), with_executed(parsed, act).alias("en"), F.col(f"`{case}`").alias("_case"))
    placed = rows.withColumn("pos", F.row_number().over(in_case)).withColumn("case_ord", F.col("_case") if timed else F.min("_row").over(Window.partitionBy("case_id")))
    return placed.select("case_id", "case_ord", "pos", "a", "en")


def load_csv(spark: SparkSession, path: str, enabled: str | None = None, separator: str = ",", case: str = CASE, activity: str = ACTIVITY, timestamp: str = TIME) -> DataFrame:
    """A CSV file of events; all columns are read as text, so timestamps order as text."""
    return from_table(spark.read.csv(path, header=True), enabled, separator, case, activity, timestamp)


_VALUE = "array<struct<_key:string,_value:string>>"
XES = f"string {_VALUE}, event array<struct<string:{_VALUE},date:{_VALUE}>>"


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, case_ord, attributes, event) per trace of an XES file, also gzipped; the schema is fixed, for
    inference would make a single attribute a struct. A trace without a name gets its index in the log, which is its
    place in its partition after the traces of the partitions before."""
    rows = spark.read.format("xml").option("rowTag", "trace").schema(XES).load(path).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row for each partition of the input
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), F.col("_part") == part).withColumn("_n", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1))
    attributes = F.map_from_entries(F.transform(F.coalesce("string", F.array().cast(_VALUE)), lambda x: F.struct(x["_key"], x["_value"])))
    return rows.select(F.col("_n").alias("case_ord"), attributes.alias("attributes"), F.coalesce("event", F.array().cast(f"array<struct<string:{_VALUE},date:{_VALUE}>>")).alias("event")).withColumn("case_id", F.coalesce(F.try_element_at("attributes", F.lit("concept:name")), F.col("case_ord").cast("string")))


def load_xes(spark: SparkSession, path: str, enabled: str = "enabled_activities", separator: str = ",") -> DataFrame:
    """Events of an XES file; the enabled attribute has a fixed name and is not searched for."""
    traces = read_xes(spark, path).select("case_id", "case_ord", F.posexplode("event").alias("i", "e"))
    pick = lambda key: F.get(F.filter(F.col("e.string"), lambda x: x["_key"] == key), F.lit(0))["_value"]
    act = pick("concept:name")
    return traces.select("case_id", "case_ord", (F.col("i") + 1).alias("pos"), act.alias("a"), with_executed(parse_set(pick(enabled), separator), act).alias("en"))


def event_records(traces: DataFrame, enabled: str = "enabled_activities", separator: str = ",") -> DataFrame:
    """One record per event, sets joined with separator and space, times made up from 2000-01-01 by minutes."""
    flat = traces.select("case_id", F.posexplode("trace").alias("i", "e"))
    return flat.select(F.col("case_id").alias(CASE), F.col("e.a").alias(ACTIVITY), F.timestamp_add("MINUTE", F.col("i"), F.lit("2000-01-01").cast("timestamp")).alias(TIME), F.array_join("e.en", f"{separator} ").alias(enabled))


def export_csv(traces: DataFrame, path: str, enabled: str = "enabled_activities", separator: str = ",") -> None:
    event_records(traces, enabled, separator).write.csv(path, header=True)


def export_xes(traces: DataFrame, path: str, enabled: str = "enabled_activities", separator: str = ",") -> None:
    """XES files, one per partition, through the XML writer."""
    pair = lambda key, value: F.struct(F.lit(key).alias("_key"), value.alias("_value"))
    time = lambda i: F.date_format(F.timestamp_add("MINUTE", i, F.lit("2000-01-01").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    events = F.transform("trace", lambda e, i: F.struct(F.array(pair("concept:name", e["a"]), pair(enabled, F.array_join(e["en"], f"{separator} "))).alias("string"), F.array(pair("time:timestamp", time(i))).alias("date")))
    rows = traces.select(F.array(pair("concept:name", F.col("case_id").cast("string"))).alias("string"), events.alias("event"))
    rows.write.format("xml").option("rowTag", "trace").option("rootTag", "log").save(path)


def first_attribute(events: DataFrame, attribute: str) -> DataFrame:
    """(case_id, value): first non-null value of an attribute in each case, by position."""
    return events.groupBy("case_id").agg(F.min_by(attribute, F.when(F.col(attribute).isNotNull(), F.col("pos"))).alias("value"))


def top_groups(cases: DataFrame, top: int = 4) -> DataFrame:
    """Cases whose value is one of the ``top`` most frequent; ties go to the smaller value."""
    kept = cases.where("value is not null").groupBy("value").count().orderBy(F.desc("count"), F.asc("value")).limit(top)
    return cases.join(F.broadcast(kept.select("value")), "value", "left_semi")


def load_classical(df: DataFrame, attribute: str, keep: list[str], case: str = CASE, activity: str = ACTIVITY, timestamp: str = TIME) -> DataFrame:
    """(case_id, value, acts) of a plain log: activities by parsed time, the case's first attribute value, kept values only.

    Events of one time go by activity, then by value."""
    rows = df.select(F.col(f"`{case}`").cast("string").alias("case_id"), F.try_to_timestamp(F.col(f"`{timestamp}`")).alias("ts"), F.col(f"`{activity}`").alias("a"), F.col(f"`{attribute}`").alias("v")).where("ts is not null and case_id is not null")
    packed = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ts", "a", "v"))).alias("e"))
    packed = packed.withColumn("value", F.get(F.filter("e", lambda x: x["v"].isNotNull()), F.lit(0))["v"])
    return packed.where(F.col("value").isin(keep)).select("case_id", "value", F.transform("e", lambda x: x["a"]).alias("acts"))


def sequences_of(cases: DataFrame) -> DataFrame:
    """(acts, case_ids, n_cases) of a plain log."""
    return cases.groupBy("acts").agg(F.array_sort(F.collect_list("case_id")).alias("case_ids"), F.count(F.lit(1)).alias("n_cases"))


def derived_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log derived from table `events`: a case is a user's day, ordered by time; enabled are the activity, the next one of
    the case, and for every third event a decoy. One shuffle, no window: the case is an array before sets are made. Cases are
    keyed and ordered by one number, user and day, so later minima stay in hash aggregates."""
    day = F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") * 100_000_000 + day).cast("long").alias("case_ord"), "ts", "event_id", "event_type")
    cases = raw.groupBy("case_ord").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    case_id = F.concat(F.floor(F.col("case_ord") / 100_000_000).cast("string"), F.lit("-"), (F.col("case_ord") % 100_000_000).cast("string"))
    decoys = F.array(*(F.lit(x) for x in EVENT_TYPES))

    def event(e, i):
        following = F.try_element_at(F.col("e"), (i + 2).cast("int"))["event_type"]
        decoy = F.when(e["event_id"] % 3 == 0, F.element_at(decoys, (e["event_id"] % len(EVENT_TYPES)).cast("int") + 1))
        return F.struct(e["event_type"].alias("a"), F.array_sort(F.array_distinct(F.array_compact(F.array(e["event_type"], following, decoy)))).alias("en"))

    return cases.select(case_id.alias("case_id"), "case_ord", F.transform("e", event).alias("trace"))


def order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log derived from table `lineitem`: a case is an order, activities are return flag and status, enabled the
    activity and the next one."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.concat("l_returnflag", "l_linestatus").alias("a")).alias("s"))
    cases = raw.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("e"))

    def event(e, i):
        return F.struct(e["a"].alias("a"), F.array_sort(F.array_distinct(F.array_compact(F.array(e["a"], F.try_element_at(F.col("e"), (i + 2).cast("int"))["a"])))).alias("en"))

    return cases.select(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_orderkey").alias("case_ord"), F.transform("e", event).alias("trace"))
