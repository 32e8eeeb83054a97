"""Conformance of a log and a net: fitness, precision, generalization, simplicity and their enabled-set versions.

Alignments run in workers, over the prefix trees of distinct traces, and come back as counters that add up over traces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import abstraction as ab
from ..functions.checkpoints import written
from .align import Aligner, Event, Move
from .enrich import MOST_STATES, Replayer, Unbounded
from .metrics import harmonic
from .model import Firing, PetriNet

#: Nets larger than this (visible, all transitions, places) may be replayed without alignments, if asked for.
LOOSE = (120, 260, 200)

FACTS = "kind string, key string, label string, a double, b double"


def too_loose(net: PetriNet) -> bool:
    return sum(t[0] is not None for t in net.transitions.values()) > LOOSE[0] or len(net.transitions) > LOOSE[1] or len(net.places()) > LOOSE[2]


def shortest_run(net: PetriNet) -> int:
    """Fewest visible steps from the initial to the final marking."""
    queue, seen, order, firing = [(0, 0, net.initial)], set(), 0, Firing(net)
    while queue:
        cost, _, m = heapq.heappop(queue)
        if m in seen:
            continue
        seen.add(m)
        if m == net.final:
            return cost
        if len(seen) > MOST_STATES:
            raise Unbounded("no end within the bound on states")
        for _, label, after in firing.steps(m):
            order += 1
            heapq.heappush(queue, (cost + (label is not None), order, after))
    raise Unbounded("the final marking cannot be reached")


def prefix_name(before: str, label: str) -> str:
    """The name of a prefix of labels, from that of the prefix without the last one: 128 bits, however long the prefix is."""
    return hashlib.blake2b(f"{before}\t{label}".encode(), digest_size=16).hexdigest()


def trace_facts(net: PetriNet, aligner: Aligner, moves: list[Move], traces: list[list[Event]], n: int) -> list[tuple[str, str, str, float, float]]:
    """Counters of traces of the same activities, aligned alike: executions, visited prefixes with what the model allowed there, and enabled sets by marking."""
    out = []
    prefix = ""
    for kind, name, marking, i in moves:
        if name is None:
            continue
        out.append(("fired", name, "", float(n), 0.0))
        label = net.transitions[name][0]
        if label is None:
            continue
        allowed = aligner.enabled(marking)
        out.append(("visit", prefix, "", float(n), float(len(allowed))))
        out.append(("went", prefix, label, 1.0, 0.0))
        if kind == "sync":
            state = "|".join(f"{p}:{c}" for p, c in marking)
            logged = set().union(*(trace[i][1] for trace in traces))
            out += [("able", state, a, 1.0, 0.0) for a in allowed] + [("logged", state, a, 1.0, 0.0) for a in logged] + [("state", state, "", float(n), 0.0)]
        prefix = prefix_name(prefix, label)
    return out


def aligned_facts(net: PetriNet, aligner: Aligner, traces: list[list[Event]], counts: list[int], least: int) -> list[tuple[str, str, str, float, float]]:
    """Counters of traces: costs without and with enabled sets, against the worst costs, and those of each alignment. Sets aside, traces of the same
    activities have one alignment."""
    out, alike = [], {}
    for trace, n, by_sets in zip(traces, counts, aligner.costs(traces), strict=True):
        out.append(("fit_sets", "", "", n * by_sets, float(n * (len(trace) + least))))
        alike.setdefault(tuple(a for a, _ in trace), []).append((trace, n))
    for (acts, own), (cost, moves) in zip(alike.items(), aligner.align([own[0][0] for own in alike.values()]), strict=True):
        n = sum(n for _, n in own)
        out += [("aligned", "", "", float(n), 0.0), ("fit", "", "", n * float(round(cost)), float(n * (len(acts) + least)))]
        out += trace_facts(net, aligner, moves, [trace for trace, _ in own], n)
    return out


def replayed_facts(replayer: Replayer, traces: list[list[Event]], counts: list[int]) -> list[tuple[str, str, str, float, float]]:
    return [("replayed", "", "", n * float(replayer.replay([a for a, _ in trace]) is not None), float(n)) for trace, n in zip(traces, counts, strict=True)]


def simplicity(net: PetriNet) -> float:
    """1 / (1 + the mean number of arcs of places and transitions beyond two)."""
    degree = Counter()
    for n, (_, ins, outs) in net.transitions.items():
        degree[n, "t"] += len(ins) + len(outs)
        for p in (*ins, *outs):
            degree[p, "p"] += 1
    for p in net.places():
        degree[p, "p"] += 0
    return 1 / (1 + max(sum(degree.values()) / max(1, len(degree)) - 2, 0))


METRICS = ("fitness", "precision", "generalization", "translucent_fitness", "translucent_precision", "simplicity", "f1", "replayed_share")


def qualities(rows: DataFrame, nets: dict[str, dict[str, PetriNet]], replay_loose: bool = False) -> DataFrame:
    """(scope, model, n_cases, METRICS) of (scope, trace, n_cases): each scope's traces under each of its models.

    fitness = 1 - cost / worst cost; precision = 1 - escaping / allowed over visited prefixes, by visits; generalization
    = 1 - mean over transitions of 1 / sqrt(executions); translucent precision unites logged sets per marking of the model. Every trace is
    aligned, unless ``replay_loose`` asks for nets beyond LOOSE to be replayed: their fitness is the share of cases that fit, replayed_share 1.

    All models travel to the workers. Traces are dealt by ranges of their activities, so that those which begin alike meet in one task and share the
    search for their beginning; into ranges by the cores there are, for the traces are few bytes and much work. One pass makes the counters of all scopes, and one grouping each metric, however many scopes there are.
    """
    least = {(s, m): shortest_run(net) for s, own in nets.items() for m, net in own.items()}

    def run(batches):
        import pandas as pd

        aligners: dict[tuple[str, str], Aligner] = {}
        for pdf in batches:
            facts: dict[tuple[str, str, str, str, str], list[float]] = {}
            for scope, own in pdf.groupby("scope"):
                traces = [[(e["a"], frozenset(e["en"])) for e in t] for t in own["trace"]]
                counts = [int(n) for n in own["n_cases"]]
                for model, net in nets.get(scope, {}).items():
                    if (scope, model) not in aligners:
                        aligners[scope, model] = Replayer(net) if replay_loose and too_loose(net) else Aligner(net)
                    known = aligners[scope, model]
                    found = replayed_facts(known, traces, counts) if isinstance(known, Replayer) else aligned_facts(net, known, traces, counts, least[scope, model])
                    for kind, key, label, a, b in found:
                        held = facts.setdefault((scope, model, kind, key, label), [0.0, 0.0])
                        held[0], held[1] = (held[0] + a, max(held[1], b) if kind == "visit" else held[1] + b)
            yield pd.DataFrame([(*names, *v) for names, v in facts.items()], columns=["scope", "model", "kind", "key", "label", "a", "b"])

    by = ["scope", "model"]
    dealt = rows.select("scope", "trace", "n_cases").repartitionByRange(3 * rows.sparkSession.sparkContext.defaultParallelism, "scope", ab.executed(F.col("trace")))
    facts = dealt.mapInPandas(run, f"scope string, model string, {FACTS}")
    summed = facts.groupBy(*by, "kind", "key", "label").agg(F.sum("a").alias("a"), F.when(F.col("kind") == "visit", F.max("b")).otherwise(F.sum("b")).alias("b"))
    summed = written(summed, "facts")
    total = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    went = summed.where("kind = 'went'").groupBy(*by, "key").agg(F.count(F.lit(1)).alias("went"))
    etc = summed.where("kind = 'visit'").join(went, [*by, "key"]).groupBy(*by).agg((1 - F.sum(F.col("a") * (F.col("b") - F.least("went", "b"))) / F.sum(F.col("a") * F.col("b"))).alias("precision"))
    able, logged = (summed.where(F.col("kind") == k).select(*by, F.col("key").alias("s"), "label") for k in ("able", "logged"))
    sizes = able.groupBy(*by, "s").agg(F.count(F.lit(1)).alias("able"))
    hits = able.join(logged, [*by, "s", "label"], "left_semi").groupBy(*by, "s").agg(F.count(F.lit(1)).alias("hit"))
    weights = summed.where("kind = 'state'").select(*by, F.col("key").alias("s"), F.col("a").alias("w"))
    trans = weights.join(sizes, [*by, "s"]).join(hits, [*by, "s"], "left").groupBy(*by).agg((F.sum(F.col("w") * F.coalesce("hit", F.lit(0)) / F.col("able")) / F.sum("w")).alias("translucent_precision"))
    base = summed.groupBy(*by).agg(
        (1 - total("fit", F.col("a")) / total("fit", F.col("b"))).alias("aligned"),
        (total("replayed", F.col("a")) / total("replayed", F.col("b"))).alias("replayed"),
        F.coalesce(total("aligned", F.col("a")), F.lit(0.0)).alias("n_aligned"),
        F.coalesce(total("replayed", F.col("b")), F.lit(0.0)).alias("n_replayed"),
        (1 - total("fit_sets", F.col("a")) / total("fit_sets", F.col("b"))).alias("translucent_fitness"),
        F.coalesce(total("fired", 1 / F.sqrt("a")), F.lit(0.0)).alias("spread"),
        F.coalesce(total("fired", F.lit(1)), F.lit(0)).alias("used"),
    )
    known = rows.sparkSession.createDataFrame([(s, m, len(net.transitions), float(simplicity(net))) for s, own in nets.items() for m, net in own.items()], "scope string, model string, n_transitions int, simplicity double")
    cases = rows.groupBy("scope").agg(F.sum("n_cases").alias("n_cases"))
    one = known.join(cases, "scope").join(base, by, "left").join(etc, by, "left").join(trans, by, "left")
    went_by = F.col("n_aligned") + F.col("n_replayed")
    fitness = F.when(F.col("n_replayed") == 0, F.col("aligned")).when(F.col("n_aligned") == 0, F.col("replayed")).otherwise((F.col("aligned") * F.col("n_aligned") + F.col("replayed") * F.col("n_replayed")) / went_by)
    most = F.greatest("n_transitions", F.lit(1))
    one = one.withColumn("fitness", fitness).withColumn("generalization", 1 - (F.coalesce("spread", F.lit(0.0)) + F.col("n_transitions") - F.coalesce("used", F.lit(0))) / most).withColumn("f1", harmonic(F.col("fitness"), F.col("precision"))).withColumn("replayed_share", F.col("n_replayed") / went_by)
    return one.select(*by, "n_cases", *(F.round(c, 6).alias(c) for c in METRICS))


def model_quality(variants: DataFrame, net: PetriNet) -> DataFrame:
    """One row of METRICS of a log and a net."""
    return qualities(variants.select(F.lit("log").alias("scope"), "trace", "n_cases"), {"log": {"model": net}}).select(*METRICS)


def translucent_conformance(variants: DataFrame, net: PetriNet) -> DataFrame:
    """One row (translucent_fitness, translucent_precision): how far logged enabled sets are those of the model."""
    return model_quality(variants, net).select("translucent_fitness", "translucent_precision")


def translucent_fitness(variants: DataFrame, net: PetriNet) -> float:
    return translucent_conformance(variants, net).first().translucent_fitness


def translucent_precision(variants: DataFrame, net: PetriNet) -> float:
    return translucent_conformance(variants, net).first().translucent_precision


def available() -> bool:
    """Whether the measures of enabled sets can be worked out; they need nothing that is not here."""
    return True


def weighted(name: str, total: Column) -> Column:
    """The mean of a metric by cases, a missing value counting as 0."""
    return F.sum(F.coalesce(F.nanvl(name, F.lit(0.0)), F.lit(0.0)) * F.col("n_cases")) / total


def view_quality(assigned: DataFrame, view_nets: dict[str, PetriNet]) -> DataFrame:
    """(scope, n_cases, METRICS): every view under its own model."""
    return qualities(assigned.select(F.col("label").alias("scope"), "trace", "n_cases"), {label: {"view": net} for label, net in view_nets.items()}).drop("model")


def global_vs_views(assigned: DataFrame, global_net: PetriNet, view_nets: dict[str, PetriNet]) -> DataFrame:
    """(scope, model, n_cases, METRICS): every view under the global model and under its own, and two AGGREGATE rows
    by cases, a missing value counting as 0."""
    rows = qualities(assigned.select(F.col("label").alias("scope"), "trace", "n_cases"), {label: {"global": global_net, "view": net} for label, net in view_nets.items()})
    total = rows.groupBy("model").agg(*(F.round(weighted(c, F.sum("n_cases")), 6).alias(c) for c in METRICS), F.sum("n_cases").alias("n_cases"))
    return rows.union(total.select(F.lit("AGGREGATE").alias("scope"), "model", *rows.columns[2:]))


def view_minus_global(rows: DataFrame) -> DataFrame:
    """Per-view less global value of each metric of the AGGREGATE rows."""
    total = rows.where("scope = 'AGGREGATE'")
    metrics = [c for c in METRICS if c != "replayed_share"]
    long = total.select("model", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics))).alias("x")).select("model", "x.*")
    return long.groupBy("metric").agg(F.round(F.sum(F.when(F.col("model") == "view", F.col("value")).otherwise(-F.col("value"))), 6).alias("difference"))


def weighted_model_quality(grouped: DataFrame, nets: dict[str, PetriNet]) -> DataFrame:
    """One row over (group_id, trace, n_cases): metrics of each group's own model weighted by its share of all cases.

    A group without a model counts in the total but adds nothing; f1 is that of the weighted fitness and precision.
    """
    total = grouped.agg(F.sum("n_cases").alias("total"))
    rows = qualities(grouped.select(F.col("group_id").alias("scope"), "trace", "n_cases"), {g: {"own": net} for g, net in nets.items()})
    mean = rows.crossJoin(F.broadcast(total)).agg(*(F.round(weighted(c, F.first("total")), 6).alias(c) for c in METRICS if c != "f1"))
    return mean.withColumn("f1", F.round(harmonic(F.col("fitness"), F.col("precision")), 6)).select(*METRICS)
