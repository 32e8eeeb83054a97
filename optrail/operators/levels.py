"""The inductive miner level by level: all open parts of all logs in one table, one pass over it for each level of the trees.

A row is a trace of a part with its number of cases. A pass adds up what is to be known of every part: which activities follow or
exclude each other, how traces begin and end, what occurs once in each. Only these sums, of a size that the alphabet gives, reach the
driver, which looks for cuts; how a part is split is an expression over its traces, and traces that fall together are counted together before the next pass.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import abstraction as ab
from ..functions.checkpoints import written
from .miner import Graph, Log, Split, decide, known_variant, mine_tree
from .model import PetriNet, Tree, fold, follows, net_of, parse_identifier

#: Rows up to which what is left of all logs is mined where it is collected.
SMALL = 2000


class Sums:
    """What a pass found of one part."""

    def __init__(self):
        self.of: dict[str, Counter] = defaultdict(Counter)

    def part(self) -> SimpleNamespace:
        """What ``miner.Part`` tells of a log in memory."""
        acts, total = self.of["act"], self.of["traces"]["", ""]
        nodes = sorted(a for a, _ in acts)
        pick = lambda kind: {a: w for (a, _), w in self.of[kind].items() if w}
        classical = Graph(nodes, dict(self.of["edge"]), pick("start"), pick("end"))
        starts, ends = pick("start_en"), pick("end_en")
        follows, both, less = self.of["follow"], self.of["both"], self.of["less"]
        frequent = {p: follows[p] + both[p] - less[p] for p in follows.keys() | both.keys()}
        once = [a for a in nodes if self.of["with"][a, ""] == total and self.of["twice"][a, ""] == 0]
        return SimpleNamespace(
            nodes=nodes,
            empty=self.of["empty"]["", ""],
            filled=total,
            single=self.of["long"]["", ""] == 0,
            classical=classical,
            translucent=Graph(nodes, {p: (p in follows) + (p in both) for p in follows.keys() | both.keys()}, dict.fromkeys(starts, 1), dict.fromkeys(ends, 1)),
            frequent=Graph(nodes, {p: w for p, w in frequent.items() if w > 0}, starts, ends),
            once=once,
        )


def sums_of(parts: DataFrame) -> DataFrame:
    """(part, kind, x, y, n) of (part, trace, n_cases): everything that ``Sums`` holds, added up where the traces are before it is sent."""
    t, none = F.col("trace"), F.lit("")
    last = F.element_at("trace", -1)
    acts = ab.executed(t)
    fact = lambda kind, x=none, y=none: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    filled = F.size(t) > 0
    inside = lambda en: F.filter(en, lambda a: F.array_contains(F.col("names"), a))
    pairs = F.zip_with(F.slice("trace", 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice("trace", 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda p, q: F.struct(p["a"].alias("x"), q["a"].alias("y"), p["en"].alias("en"), q["en"].alias("nx")))
    of_pair = lambda p: F.concat(
        F.array(fact("edge", p["x"], p["y"])),
        F.transform(inside(p["nx"]), lambda a: fact("follow", p["x"], a)),
        F.flatten(F.transform(inside(F.array_intersect(p["en"], p["nx"])), lambda a: F.array(fact("both", p["x"], a), fact("both", a, p["x"])))),
        F.flatten(F.transform(inside(F.array_except(p["en"], p["nx"])), lambda a: F.array(fact("less", p["x"], a), fact("less", a, p["x"])))),
    )
    names = parts.where(filled).select("part", F.explode(acts).alias("a")).groupBy("part").agg(F.collect_set("a").alias("names"))  # the alphabet of each part
    known = parts.join(names, "part", "left")
    facts = F.when(~filled, F.array(fact("empty"))).otherwise(
        F.concat(
            F.array(fact("traces"), fact("start", F.try_element_at(t, F.lit(1))["a"]), fact("end", last["a"])),
            F.when(F.size(t) > 1, F.array(fact("long"))).otherwise(F.array().cast("array<struct<kind:string,x:string,y:string>>")),
            F.transform(F.array_distinct(acts), lambda a: fact("with", a)),
            F.transform(F.array_distinct(acts), lambda a: fact("act", a)),
            F.transform(F.filter(F.array_distinct(acts), lambda a: F.size(F.filter(acts, lambda b: b == a)) > 1), lambda a: fact("twice", a)),
            F.transform(inside(F.try_element_at(t, F.lit(1))["en"]), lambda a: fact("start_en", a)),
            F.transform(inside(last["en"]), lambda a: fact("end_en", a)),
            F.flatten(F.transform(pairs, of_pair)),
        )
    )
    return known.select("part", "n_cases", F.explode(facts).alias("f")).groupBy("part", "f.kind", "f.x", "f.y").agg(F.sum("n_cases").alias("n"))


EVENTS = "array<struct<a:string,en:array<string>>>"
PIECE = f"struct<child:int,trace:{EVENTS}>"


def kept_in(trace: Column, keep: Column) -> Column:
    events = F.filter(trace, lambda e: F.array_contains(keep, e["a"]))
    return F.transform(events, lambda e: F.struct(e["a"].alias("a"), F.array_intersect(e["en"], keep).alias("en")))


def piece(child: Column | int, trace: Column) -> Column:
    return F.struct((F.lit(child) if isinstance(child, int) else child.cast("int")).alias("child"), trace.cast(EVENTS).alias("trace"))


def pieces_of(trace: Column, how: Column, filled: Column, groups: Column) -> Column:
    """What ``miner.split_trace`` gives, as an expression."""
    nothing, no_piece = F.array().cast(EVENTS), F.array().cast(f"array<{PIECE}>")
    first, second = F.get(groups, F.lit(0)), F.get(groups, F.lit(1))

    each = F.transform(groups, lambda s, j: piece(j, kept_in(trace, s)))
    counts = F.transform(groups, lambda s: F.size(F.filter(trace, lambda e: F.array_contains(s, e["a"]))))
    place = F.array_position(counts, F.array_max(counts))
    most = F.array(piece(place - 1, kept_in(trace, F.get(groups, (place - 1).cast("int")))))

    def cut(acc: Column, e: Column, parts: Column, event: Column, child: int | Column) -> Column:
        """One more event: begin a new piece, or go on with the open one."""
        done = F.when(parts, F.concat(acc["done"], F.array(piece(child, acc["open"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(F.when(parts, nothing).otherwise(acc["open"]), F.array(event)).cast(EVENTS).alias("open"))

    def again(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc["open"], F.lit(-1))["a"]
        begins = (F.size(acc["open"]) > 0) & F.array_contains(first, e["a"]) & (second.isNull() | F.array_contains(second, last))
        return cut(acc, e, F.coalesce(begins, F.lit(False)), e, 0)

    start = F.struct(no_piece.alias("done"), nothing.alias("open"))
    restarted = F.aggregate(trace, start, again, lambda acc: F.concat(acc["done"], F.array(piece(0, acc["open"]))))

    def turn(acc: Column, e: Column) -> Column:
        doing = F.array_contains(first, e["a"])
        event = F.struct(e["a"].alias("a"), F.array_intersect(e["en"], F.when(doing, first).otherwise(second)).alias("en"))
        after = cut(acc, e, doing != acc["doing"], event, F.when(acc["doing"], 0).otherwise(1))
        return F.struct(after["done"].alias("done"), after["open"].alias("open"), doing.alias("doing"))

    begin = F.struct(no_piece.alias("done"), nothing.alias("open"), F.lit(True).alias("doing"))
    looped = F.aggregate(trace, begin, turn, lambda acc: F.concat(acc["done"], F.when(acc["doing"], F.array(piece(0, acc["open"]))).otherwise(F.array(piece(1, acc["open"]), piece(0, nothing)))))

    def further(acc: Column, e: Column) -> Column:
        """The best ways to have come to each group: as many events as possible in their own."""
        offer = lambda s, j: F.array_max(F.transform(F.slice(acc, 1, j + 1), lambda b: F.struct((b["score"] + F.when(F.array_contains(s, e["a"]), 1).otherwise(0)).cast("int").alias("score"), F.concat(b["path"], F.array(j)).alias("path"))))
        return F.transform(groups, offer)

    ways = F.transform(groups, lambda s: F.struct(F.lit(0).alias("score"), F.array().cast("array<int>").alias("path")))
    path = F.aggregate(trace, ways, further, lambda acc: F.array_max(acc)["path"])
    in_turn = F.transform(groups, lambda s, j: piece(j, kept_in(F.filter(trace, lambda e, i: F.get(path, i) == j), s)))
    return (
        F.when(how == "xor", most).when(how == "segments", in_turn).when(how == "restart", restarted).when(how == "loop", looped)
        .when(filled & (F.size(trace) == 0), no_piece).otherwise(each)
    )


Asked = tuple[str, float]


def mine_parts(parts: DataFrame, roots: list[int], variant: str = "imtf", noise: float = 0.0, small: int = SMALL) -> dict[int, Tree]:
    """The tree of each part of (part, trace, n_cases), parts numbered from 0; one without traces is silent."""
    return {p: tree for (p, _), tree in mine_each(parts, {p: [(variant, noise)] for p in roots}, small).items()}


def mine_each(parts: DataFrame, roots: dict[int, list[Asked]], small: int = SMALL) -> dict[tuple[int, Asked], Tree]:
    """The trees of parts of (part, trace, n_cases) by each miner variant and threshold that is asked for. What is known of a part does not depend on
    these, and those that split it alike share its pieces, so there is one pass a level for all.

    The driver holds trees, and for each open part the sums of a pass. When at most ``small`` rows are left in all, they are collected
    and mined there, by the same decisions.
    """
    spark, splits, trees, below, depth = parts.sparkSession, {}, {}, {}, 0
    open_ = {p: [(a, (known_variant(a[0]), a[1])) for a in asked] for p, asked in roots.items()}
    rows = written(parts.groupBy("part", "trace").agg(F.sum("n_cases").alias("n_cases")), "parts")
    following = max(roots, default=-1) + 1
    while open_:
        if rows.count() <= small:
            logs: dict[int, Log] = {p: Counter() for p in open_}
            for r in rows.collect():
                logs[r.part][tuple((e.a, frozenset(e.en)) for e in r.trace)] += r.n_cases
            trees |= {(p, a): mine_tree(logs[p], *how, depth) for p, asked in open_.items() for a, how in asked}
            break
        sums: dict[int, Sums] = defaultdict(Sums)
        for r in sums_of(rows).collect():
            sums[r.part].of[r.kind][r.x, r.y] += r.n
        fresh, children, after = [], {}, {}
        for p, asked in open_.items():
            for a, how in asked:
                found = decide(sums[p].part(), *how, depth)
                if isinstance(found, Tree):
                    trees[p, a] = found
                    continue
                alike = (p, found.how, found.filled, tuple(map(tuple, found.groups)), found.children())
                if alike not in children:
                    children[alike] = list(range(following, following + found.children()))
                    following += found.children()
                    fresh.append((p, found.how, found.filled, found.groups, children[alike]))
                splits[p, a], below[p, a] = found, children[alike]
                for c in below[p, a]:
                    after.setdefault(c, []).append((a, how))
        open_, depth = after, depth + 1
        if open_:
            plan = spark.createDataFrame(fresh, "part int, how string, filled boolean, groups array<array<string>>, children array<int>")
            cut = rows.join(F.broadcast(plan), "part").select("children", "n_cases", F.explode(pieces_of(F.col("trace"), F.col("how"), F.col("filled"), F.col("groups"))).alias("x"))
            moved = cut.select(F.get("children", F.col("x.child")).alias("part"), F.col("x.trace").alias("trace"), "n_cases")
            rows = written(moved.groupBy("part", "trace").agg(F.sum("n_cases").alias("n_cases")), "parts")

    def whole(p: int, a: Asked) -> Tree:
        if (p, a) not in trees:
            trees[p, a] = splits[p, a].tree([whole(c, a) for c in below[p, a]])
        return trees[p, a]

    return {(p, a): fold(whole(p, a)) for p, asked in roots.items() for a in asked}


def discover_each(variants: DataFrame, asked: list[Asked], small: int = SMALL) -> dict[Asked, Tree]:
    """The models of a log of weighted variants by several miner variants and thresholds."""
    return {a: tree for (_, a), tree in mine_each(variants.select(F.lit(0).alias("part"), "trace", "n_cases"), {0: asked}, small).items()}


def discover_tree(variants: DataFrame, variant: str = "imtf", noise: float = 0.0, small: int = SMALL) -> Tree:
    """The model of a log of weighted variants (trace, n_cases), of any number."""
    return mine_parts(variants.select(F.lit(0).alias("part"), "trace", "n_cases"), [0], variant, noise, small)[0]


def discover_net(variants: DataFrame, variant: str = "imtf", noise: float = 0.0) -> PetriNet:
    return net_of(discover_tree(variants, variant, noise))


def view_tree(kappa: str, variants: DataFrame, mode: str = "identifier") -> Tree:
    """A view's model: its identifier, or mined from its variants with or without enabled sets."""
    if mode == "identifier":
        return fold(parse_identifier(kappa))
    if mode not in ("translucent_im", "classic_im"):
        raise ValueError(f"unknown mode {mode!r}")
    return discover_tree(variants, "imtf" if mode == "translucent_im" else "im")


def group_trees(grouped: DataFrame, variant: str = "imtf", noise: float = 0.0, small: int = SMALL) -> dict[str, Tree]:
    """The model of each group of (group_id, trace, n_cases), all of them level by level together. Group ids and trees reach the driver."""
    counted = written(grouped.groupBy("group_id", "trace").agg(F.sum("n_cases").alias("n_cases")), "grouped")
    names = sorted((r.group_id for r in counted.select("group_id").distinct().collect()), key=lambda g: (g is not None, g))
    numbers = counted.sparkSession.createDataFrame(list(enumerate(names)), f"part int, group_id {dict(counted.dtypes)['group_id']}")
    numbered = counted.alias("c").join(numbers.alias("n"), F.col("c.group_id").eqNullSafe(F.col("n.group_id"))).select("part", "trace", "n_cases")
    found = mine_parts(numbered, list(range(len(names))), variant, noise, small)
    return {g: found[i] for i, g in enumerate(names)}


def mine_groups(grouped: DataFrame, variant: str = "imtf", noise: float = 0.0) -> DataFrame:
    """(group_id, tree): one model for each group of (group_id, trace, n_cases)."""
    rows = [(g, str(tree)) for g, tree in group_trees(grouped, variant, noise).items()]
    return grouped.sparkSession.createDataFrame(rows, "group_id string, tree string")


def mine_follows(grouped: DataFrame, variant: str = "imtf", noise: float = 0.0) -> DataFrame:
    """(group_id, x, y): pairs that may follow each other directly in the runs of each group's model."""
    rows = [(g, x, y) for g, tree in group_trees(grouped, variant, noise).items() for x, y in sorted(follows(tree)[2])]
    return grouped.sparkSession.createDataFrame(rows, "group_id string, x string, y string")
