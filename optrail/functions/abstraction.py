"""From a trace to its canonical identifier over seq, xor and and: Column expressions only.

A trace is array<struct<a,en>>. Position i offers the choice set c = {a} + (en - en of the next position) and keeps
k = en * (en of the next). Positions i < j may run in parallel if their choice sets are disjoint and the
later one's is within k of the earlier; an interval is parallel if all its pairs are. As that is a condition on all
pairs, every part of a parallel interval is parallel, so a single fold that extends an interval until the first
failure finds the largest one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import empty_set

STEP = "struct<i:int,c:array<string>,k:array<string>>"
EPSILON = "epsilon"


def executed(trace: Column) -> Column:
    return F.transform(trace, lambda e: e["a"])


def successor_enabled(trace: Column, index: Column) -> Column:
    """Enabled set after the 0-based position ``index``; empty at the end."""
    return F.coalesce(F.try_element_at(trace, (index + 2).cast("int"))["en"], empty_set())


def choice(a: Column, en: Column, following: Column) -> Column:
    return F.array_sort(F.array_union(F.array(a), F.array_except(en, following)))


def steps(trace: Column) -> Column:
    """(i, c, k) of each position, i from 1."""
    return F.transform(
        trace,
        lambda e, i: F.struct(
            (i + 1).cast("int").alias("i"),
            choice(e["a"], e["en"], successor_enabled(trace, i)).alias("c"),
            F.array_intersect(e["en"], successor_enabled(trace, i)).alias("k"),
        ),
    )


def supports(earlier: Column, later: Column) -> Column:
    """Whether two positions may run in parallel."""
    return ~F.arrays_overlap(earlier["c"], later["c"]) & (F.size(F.array_except(later["c"], earlier["k"])) == 0)


def _fold(items: Column, joins: Callable[[Column, Column], Column], closes: Callable[[Column], Column] | None = None) -> Column:
    """Intervals of ``items``: an item joins the open interval or opens the next; one that ``closes`` takes no more."""
    none, nothing = F.array().cast(f"array<array<{STEP}>>"), F.array().cast(f"array<{STEP}>")
    state = F.struct(none.alias("done"), nothing.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["open"]) > 0) & joins(acc["open"], x)
        if closes is not None:
            fits = fits & ~closes(acc["open"])
        shut = F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"))).otherwise(F.struct(shut.alias("done"), F.array(x).alias("open")))

    finish = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(items, state, step, finish)


def leftmost(items: Column) -> Column:
    """From left to right, the largest parallel interval at each start."""
    return _fold(items, lambda taken, x: F.forall(taken, lambda y: supports(y, x)))


def rightmost(items: Column) -> Column:
    """From right to left, the largest parallel interval at each end."""
    backwards = _fold(F.reverse(items), lambda taken, x: F.forall(taken, lambda y: supports(x, y)))
    return F.reverse(F.transform(backwards, lambda interval: F.reverse(interval)))


def shortest(items: Column) -> Column:
    """From left to right, two positions if they are parallel, else one."""
    return _fold(items, lambda taken, x: supports(F.element_at(taken, 1), x), closes=lambda taken: F.size(taken) > 1)


DECOMPOSITIONS: dict[str, Callable[[Column], Column]] = {"leftmost": leftmost, "rightmost": rightmost, "shortest": shortest}


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is worked out a single time however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def compound(kind: str, parts: Column) -> Column:
    """kind(...) over sorted distinct parts; a single part stands for itself."""
    return once(F.array_sort(F.array_distinct(parts)), lambda p: F.when(F.size(p) == 1, F.element_at(p, 1)).otherwise(F.concat(F.lit(f"{kind}("), F.array_join(p, ", "), F.lit(")"))))


def block(c: Column) -> Column:
    return compound("xor", c)


def interval_identifier(interval: Column) -> Column:
    return compound("and", F.transform(interval, lambda s: block(s["c"])))


def sequence(parts: Column) -> Column:
    return once(parts, lambda p: F.when(F.size(p) == 0, F.lit(EPSILON)).when(F.size(p) == 1, F.element_at(p, 1)).otherwise(F.concat(F.lit("seq("), F.array_join(p, ", "), F.lit(")"))))


def decompose(trace: Column, decomposition: str = "leftmost") -> Column:
    if decomposition not in DECOMPOSITIONS:
        raise ValueError(f"unknown decomposition {decomposition!r}; one of {sorted(DECOMPOSITIONS)}")
    return DECOMPOSITIONS[decomposition](steps(trace))


def kappa(trace: Column, decomposition: str = "leftmost") -> Column:
    """The canonical identifier of a trace."""
    return sequence(F.transform(decompose(trace, decomposition), interval_identifier))


def interval_text(trace: Column, decomposition: str = "leftmost") -> Column:
    """A decomposition as text: [1][2,3][4]."""
    return F.array_join(F.transform(decompose(trace, decomposition), lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda s: s["i"].cast("string")), ","), F.lit("]"))), "")


def choice_texts(trace: Column) -> Column:
    return F.transform(steps(trace), lambda s: F.array_join(s["c"], "+"))


def kappa_multiset(trace: Column) -> Column:
    """Choice sets without their order."""
    return F.array_join(F.array_sort(choice_texts(trace)), "|")


def kappa_set(trace: Column) -> Column:
    """Choice sets without order and repetition."""
    return F.array_join(F.array_sort(F.array_distinct(choice_texts(trace))), "|")


def kappa_acts(trace: Column) -> Column:
    """The activities of all choice sets."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(steps(trace), lambda s: s["c"])))), "|")


COARSENINGS: dict[str, Callable[[Column], Column]] = {"kappa": kappa, "kappa_multiset": kappa_multiset, "kappa_set": kappa_set, "kappa_acts": kappa_acts}


def trace_text(trace: Column) -> Column:
    """A trace as text: a{a,b} b{b}."""
    return F.array_join(F.transform(trace, lambda e: F.concat(e["a"], F.lit("{"), F.array_join(e["en"], ","), F.lit("}"))), " ")


def variant_text(trace: Column) -> Column:
    return F.array_join(executed(trace), " -> ")
