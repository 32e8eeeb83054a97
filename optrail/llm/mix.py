"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialize, private, quoted, words_count


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) per source.

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes; a target
    stops at ``most`` times its source's size and what it leaves goes to the others by weight. The level
    at which the targets stop is found in closed form: sources fill in order of most * size / weight, so one
    running sum tells which are full. Only source totals pass through this single ordered window.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), turn.cast("int") + 1)
    full = F.col("source_size") * F.lit(float(most))
    by_level = Window.orderBy("level", F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("level", full / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full_before", F.coalesce(F.sum(full).over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("own_level", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
        # the first source, in this order, that is not full sets the level of all after it; of equals it has the highest
        .withColumn("cut", F.min(F.when(F.col("level") > F.col("own_level"), F.struct("level", (-F.col("own_level")).alias("below")))).over(everything))
    )
    target = F.when(F.col("cut").isNull() | (F.col("level") < F.col("cut.level")), full).otherwise(F.least(full, F.col("weight") * -F.col("cut.below")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


#: Slices of a unit of virtual time. All sources together serve as many words in one slice as in another.
SLICES = 4096


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document with the words that the mix takes from it.

    Every source's documents are shuffled by a seeded digest, once for ``most`` rounds. An entry's virtual
    finish time is its source's running size divided by the source's target, taken at the entry's middle, for
    documents are taken whole and by their ends every source would fall short by half a document. Entries of all
    sources are then put in one order by finish time and cut where their running size reaches the total budget, the sum of
    all targets: entries whose middle lies before it are taken.

    No running size is made in one task. Within a source it is the sum of earlier slices, of fixed number, plus a window
    inside a slice. Over all sources the order is cut into ranges of virtual time, which hold like numbers of words; ranges before
    the one where the budget ends are taken whole, and only in that one entries are sorted and summed up. ``in_mix_order``
    range-sorts what is taken.

    Null text has size 0 and is never taken; null sources form one source; repeated rows with one doc_id
    are separate documents, ordered by size, text and source, and of those alike in all of these any may come first, so where the budget ends one of them may be taken and another not; an empty table gives
    no rows. Columns of ``docs`` other than doc_id, text and source are ignored.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = docs.select("doc_id", "source", words_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")).withColumn("draw", draw).withColumn("slice", F.shiftright("draw", 60 - 12).cast("int"))
    sized = materialize(sized, "sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)

    in_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("here")).withColumn("earlier", F.coalesce(F.sum("here").over(in_source), F.lit(0)))
    plan = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.slice", "s.earlier", "t.source_size", "t.weight", "t.target")
    in_slice = Window.partitionBy("source", "slice").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("within", F.sum("size").over(in_slice))
        .alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slice") == F.col("p.slice")))
        .select("d.doc_id", "d.source", "d.size", "d.mark", "d.draw", "p.source_size", "p.weight", "p.target", (F.col("p.earlier") + F.col("d.within")).alias("reached"))
    )
    placed = materialize(placed, "placed")

    def finish(nth: int | Column) -> Column:
        return F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("reached") + F.lit(nth) * F.col("source_size") - F.col("size") / 2) / F.col("target"))

    last = budget_end(placed, finish, most)
    taken = sum((F.when(F.lit(True) if last is None else before(finish(i), i, last), F.col("size")).otherwise(0) for i in range(most)), F.lit(0))
    taken = F.when(finish(0).isNotNull(), taken).otherwise(F.lit(0)).cast("long")
    return placed.select("doc_id", "source", "size", "mark", "source_size", "weight", "target", finish(0).alias("finish"), taken.alias("taken"))


def tie_break() -> list[Column]:
    """What orders entries of one finish time, before their round."""
    return [F.col("draw"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.col("size"), F.col("mark"), F.xxhash64("source")]


def before(finish: Column, nth: int, last: Row) -> Column:
    """Whether an entry stands before ``last`` in the order of all entries."""
    out = F.lit(nth < last.nth)
    for own, end in zip(reversed([finish, *tie_break()]), reversed([last.finish, *last.ties]), strict=True):
        out = (own < F.lit(end)) | ((own == F.lit(end)) & out)
    return out


def budget_end(placed: DataFrame, finish: Callable[[int | Column], Column], most: int) -> Row | None:
    """(finish, ties, nth) of the first entry that the budget does not reach, in the order of all entries; None if it
    reaches all. At most 2 * SLICES sums of ranges and one row reach the driver."""
    entries = placed.withColumn("nth", F.explode(F.array(*(F.lit(i) for i in range(most))))).withColumn("finish", finish(F.col("nth"))).where("finish is not null")
    entries = entries.withColumn("range", F.least(F.floor(F.col("finish") * SLICES), F.lit(2 * SLICES - 1)).cast("int"))
    budget = math.fsum(r.target for r in placed.groupBy("source").agg(F.first("target").alias("target")).agg(F.sum("target").alias("target")).collect() if r.target)
    reached = 0
    for r in sorted(entries.groupBy("range").agg(F.sum("size").alias("size")).collect()):
        if reached + r["size"] > budget:
            break
        reached += r["size"]
    else:
        return None
    order = Window.partitionBy("range").orderBy("finish", *tie_break(), "nth").rowsBetween(Window.unboundedPreceding, 0)
    beyond = entries.where(F.col("range") == r["range"]).withColumn("middle", F.sum("size").over(order) + reached - F.col("size") / 2).where(F.col("middle") >= budget)
    key = beyond.select(F.struct("finish", F.array(*(c.cast("long") for c in tie_break())).alias("ties"), "nth").alias("e")).agg(F.min("e").alias("e")).first().e
    if key is not None:
        return key
    later = entries.where(F.col("range") > r["range"])  # the range's last entry's middle lies before the budget
    return later.select(F.struct("finish", F.array(*(c.cast("long") for c in tie_break())).alias("ties"), "nth").alias("e")).agg(F.min("e").alias("e")).first().e


def in_mix_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, range-sorted by virtual finish time.

    Rows are told apart by doc_id, source and text; of several with the same, all go as the first one goes. Null ids
    and null sources match nulls; null texts are never taken; an empty table gives none; other columns are passed through.
    """
    times = (F.col("taken") / F.col("size")).cast("int")
    taken = mixed.where("taken > 0").groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("mark").alias("m")).agg(F.min(F.struct("finish", times.alias("times"), (F.col("source_size") / F.col("target")).alias("step"))).alias("t"))
    own = private(docs, "_finish")
    same = docs["doc_id"].eqNullSafe(taken["id"]) & docs["source"].eqNullSafe(taken["of"]) & (F.xxhash64(docs["text"]) == taken["m"])
    rounds = F.transform(F.sequence(F.lit(0), taken["t.times"] - 1), lambda r: taken["t.finish"] + r * taken["t.step"])
    rows = docs.join(taken, same).select(*(docs[quoted(c)] for c in docs.columns), F.explode(rounds).alias(own))
    return rows.repartitionByRange(own).sortWithinPartitions(own).drop(own)
