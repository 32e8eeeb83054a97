"""Enabled sets for plain logs, by replaying distinct sequences on a Petri net in workers, over sets of markings."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Firing, Marking, PetriNet

#: Markings that one closure, and sets of markings that the replays of a net may visit; a net without that bound raises instead of running on.
MOST_STATES = 100_000

ENRICHED = "acts array<string>, n_cases long, trace array<struct<a:string,en:array<string>>>"


class Unbounded(RuntimeError):
    pass


class Replayer:
    """Searches on one net, with what was found kept for the next trace."""

    def __init__(self, net: PetriNet):
        self.net, self.firing, self._closure, self._steps, self._enabled = net, Firing(net), {}, {}, {}
        self._sets: list[tuple[Marking, ...]] = [(net.initial,)]
        self._numbers: dict[tuple[Marking, ...], int] = {self._sets[0]: 0}
        self._moves: dict[tuple[int, str], int] = {}
        self._ends: dict[int, tuple[Marking, ...]] = {}

    def silent_closure(self, marking: Marking) -> list[Marking]:
        """Markings reachable by silent steps, fewest first."""
        if marking not in self._closure:
            seen, queue = {marking: None}, deque([marking])
            while queue:
                m = queue.popleft()
                for _, label, after in self.firing.steps(m):
                    if label is None and after not in seen:
                        if len(seen) >= MOST_STATES:
                            raise Unbounded(f"over {MOST_STATES} markings by silent steps")
                        seen[after] = None
                        queue.append(after)
            self._closure[marking] = list(seen)
        return self._closure[marking]

    def enabled(self, marking: Marking) -> list[str]:
        """Labels that can happen next, silent steps aside."""
        if marking not in self._enabled:
            self._enabled[marking] = sorted({label for m in self.silent_closure(marking) for _, label, _ in self.firing.steps(m) if label is not None})
        return self._enabled[marking]

    def after(self, marking: Marking, label: str) -> list[Marking]:
        """Distinct markings after silent steps and then ``label``, those with fewest silent steps first."""
        if (marking, label) not in self._steps:
            found = dict.fromkeys(after for m in self.silent_closure(marking) for _, own, after in self.firing.steps(m) if own == label)
            self._steps[marking, label] = list(found)
        return self._steps[marking, label]

    def can_finish(self, marking: Marking) -> bool:
        return self.net.final is None or self.net.final in self.silent_closure(marking)

    def move(self, state: int, label: str) -> int:
        """The set of markings after ``label`` from a set of markings, both by number; sets are made when they are first met."""
        key = state, label
        if key not in self._moves:
            after = tuple(dict.fromkeys(x for m in self._sets[state] for x in self.after(m, label)))
            if after not in self._numbers:
                if len(self._sets) >= MOST_STATES:
                    raise Unbounded(f"over {MOST_STATES} sets of markings")
                self._numbers[after] = len(self._sets)
                self._sets.append(after)
            self._moves[key] = self._numbers[after]
        return self._moves[key]

    def replay(self, acts: list[str]) -> list[tuple[str, list[str]]] | None:
        """Events with enabled sets along a run that fits, or None.

        Sets of markings are followed forward, in an automaton that all sequences share. Backward, those that cannot get to the end go; forward again the run takes of
        the markings that are left the first by its silent steps. This is the run that a search depth first would find, without its detours.
        """
        states = [0]
        for a in acts:
            states.append(self.move(states[-1], a))
            if not self._sets[states[-1]]:
                return None
        last = states[-1]
        if last not in self._ends:
            self._ends[last] = tuple(m for m in self._sets[last] if self.can_finish(m))
        alive = self._ends[last]
        if not alive:
            return None
        kept = [alive]
        for state, a in zip(states[-2::-1], reversed(acts), strict=True):
            here = self._sets[state]
            alive = here if len(here) == 1 else tuple(m for m in here if any(x in kept[-1] for x in self.after(m, a)))
            kept.append(alive)
        m, out = self.net.initial, []
        for a, left in zip(acts, kept[-2::-1], strict=True):
            out.append((a, sorted({a, *self.enabled(m)})))
            m = next(x for x in self.after(m, a) if x in left)
        return out


def enrich(sequences: DataFrame, net: PetriNet) -> DataFrame:
    """(acts, n_cases, trace) of distinct sequences that the net can replay; others are left out."""

    def run(batches):
        import pandas as pd

        replayer = Replayer(net)
        for pdf in batches:
            rows = [(acts, n, replayer.replay(list(acts))) for acts, n in zip(pdf["acts"], pdf["n_cases"], strict=True)]
            yield pd.DataFrame([(list(acts), int(n), [{"a": a, "en": en} for a, en in t]) for acts, n, t in rows if t is not None], columns=["acts", "n_cases", "trace"])

    return sequences.select("acts", "n_cases").mapInPandas(run, ENRICHED)


def enrichment_report(sequences: DataFrame, enriched: DataFrame, group: str = "") -> DataFrame:
    """One row: group, cases in and kept, retention (0.0 on empty)."""
    before, after = sequences.agg(F.coalesce(F.sum("n_cases"), F.lit(0)).alias("cases_in")), enriched.agg(F.coalesce(F.sum("n_cases"), F.lit(0)).alias("cases_kept"))
    return before.crossJoin(after).select(F.lit(group).alias("group_id"), "cases_in", "cases_kept", F.when(F.col("cases_in") > 0, F.round(F.col("cases_kept") / F.col("cases_in"), 6)).otherwise(0.0).alias("retention"))


def reports(sequences: DataFrame, enriched: DataFrame) -> DataFrame:
    """(group_id, cases_in, cases_kept, retention) of each group of (group_id, n_cases) and what was kept of it."""
    before = sequences.groupBy("group_id").agg(F.sum("n_cases").alias("cases_in"))
    after = enriched.groupBy("group_id").agg(F.sum("n_cases").alias("cases_kept"))
    kept = F.coalesce("cases_kept", F.lit(0))
    return before.join(after, "group_id", "left").select("group_id", "cases_in", kept.alias("cases_kept"), F.when(F.col("cases_in") > 0, F.round(kept / F.col("cases_in"), 6)).otherwise(0.0).alias("retention"))


def split_and_enrich(grouped: DataFrame, nets: dict[str, PetriNet]) -> DataFrame:
    """(group_id, acts, n_cases, trace) of (group_id, acts, n_cases), each group replayed on its own net.

    Nets travel with the function: one small value per group.
    """

    def run(batches):
        import pandas as pd

        own = {g: Replayer(n) for g, n in nets.items()}
        for pdf in batches:
            rows = [(g, list(acts), int(n), own[g].replay(list(acts)) if g in own else None) for g, acts, n in zip(pdf["group_id"], pdf["acts"], pdf["n_cases"], strict=True)]
            yield pd.DataFrame([(g, acts, n, [{"a": a, "en": en} for a, en in t]) for g, acts, n, t in rows if t is not None], columns=["group_id", "acts", "n_cases", "trace"])

    return grouped.select("group_id", "acts", "n_cases").mapInPandas(run, f"group_id string, {ENRICHED}")
