"""What the operators of this package share: shared storage, tables read defensively, components."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as bytes and as a class for regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the context's checkpoint folder. Where
    neither is set, one is made on a local master; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/optrail-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at replicated storage,
    so a lost executor costs only the tasks that read from it."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, rows: int, most: int, salt: str) -> DataFrame:
    """At most ``most`` of the ``rows`` rows of ``df``, those of smallest hash of the key. Rows beyond twice the
    share that is wanted are dropped where they are read, so partitions send no more than their part."""
    draw = F.xxhash64(F.lit(salt), key)
    if rows > 2 * most:
        df = df.where(F.pmod(draw, F.lit(1 << 30)) < int(2 * most / rows * (1 << 30)))
        draw = F.pmod(draw, F.lit(1 << 30))
    return df.orderBy(draw, key).limit(most)


#: Rows and bytes that Spark hands to a Python worker at a time, at most (one longer row comes alone), and that a worker hands back.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES: buffers on both sides grow with a batch's texts."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(name)) or 0) <= most or not spark.conf.get(name).isdigit():
            spark.conf.set(name, str(most))


def slices(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(most, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def giving_back(batches: Iterator[pa.RecordBatch], every: int = 4 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches; memory is given back after about ``every`` bytes."""
    seen = 0
    for batch in batches:
        seen += batch.nbytes
        yield batch
        del batch
        if seen >= every:
            seen = 0
            give_back()


def give_back() -> None:
    """Return freed memory to the system: workers stay alive between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back between batches and at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(giving_back(batches))
        give_back()

    return whole


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run``, giving memory back after each group."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return whole


def lean_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``run``, giving memory back after each pair of groups."""

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return whole


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; sessions that read one also bound their batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 40) -> DataFrame:
    """(node, component): smallest node reachable, for every node of an edge, by alternating large and small stars.

    Each round halves the depth of what is left and is written to the shared folder. No group of
    neighbours is ever gathered: a node's neighbours meet only in a minimum and in a join on the node,
    whose large side Spark may split. Rows with a null end are left out; self-links give a component of one.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    both = links.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
    loops = materialize(both.distinct(), "links")
    state = loops.where("hi <> lo")
    for _ in range(rounds):
        around = state.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(state.select("lo", "hi"))
        least = around.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = around.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(lowest, "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).union(lowest).distinct()
        state = materialize(small, "stars")
        ends = state.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hi").alias("heads")).first()
        if ends.n == ends.heads and state.join(state.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty():
            break  # every node points at one smallest node, which points nowhere
    else:
        raise RuntimeError("components did not settle")
    members = state.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    roots = state.select(F.col("lo").alias("node")).union(loops.where("hi = lo").select("hi")).distinct()
    rest = roots.join(members.select("node"), "node", "left_anti")
    return members.union(rest.select("node", F.col("node").alias("component")))


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_block))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` with other names than ``names``; names that differ in case are one for Spark."""
    taken = {n.lower() for n in names}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in taken]


def private(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_of(df: DataFrame, *added: tuple[str, str]) -> str:
    """The frame's schema with columns added, for functions over batches."""
    return ", ".join(f"{quoted(n)} {t}" for n, t in [*df.dtypes, *added])


ARROW = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}


def schema_text(fields: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def batch_of(rows: list[tuple], fields: tuple[tuple[str, str], ...]) -> pa.RecordBatch:
    """A batch from rows, which may be none."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
