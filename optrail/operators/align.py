"""Cheapest alignments of many traces with one net, searched over the prefix tree of the traces.

A log move and a visible move of the model cost 1, silent moves nothing (a trifle, so that of equal alignments the one with fewer of them wins), a synchronous
move nothing, or the Jaccard distance of the logged and the model's enabled set. Traces that begin alike share all that is worked out for
their common beginning. Both searches are exact, for any trace: nets with few markings by dynamic programming over vectors of costs, one for each
node of the prefix tree; others by A* over pairs of node and marking. Where costs alone are asked for, vectors of beginnings meet those of endings, which many
traces share too.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable

import numpy as np

from .enrich import MOST_STATES, Replayer, Unbounded
from .model import Marking, PetriNet

#: Markings up to which costs between all pairs of them are worked out beforehand.
FEW = 1500
#: What a silent move adds, and by how much equal costs may differ.
SILENT, NEAR = 1e-6, 1e-9
#: Moves that are tried at once, and the numbers in vectors of endings that are kept from one batch of traces to the next.
AT_ONCE, KEPT = 16, 1 << 23

Event = tuple[str, frozenset[str]]
#: (kind, transition, marking before, position): "sync", "model", "silent", "log".
Move = tuple[str, str | None, Marking, int]


class Prefixes:
    """The prefix tree of traces: parents, the events that lead to nodes, depths, and the node where each trace ends."""

    def __init__(self, traces: list[list[Event]], by_sets: bool):
        self.parent, self.event, self.depth = [-1], [None], [0]
        known: dict[tuple[int, Hashable], int] = {}
        self.end = []
        for trace in traces:
            at = 0
            for e in trace:
                key = (at, e if by_sets else e[0])
                if key not in known:
                    known[key] = len(self.parent)
                    self.parent.append(at)
                    self.event.append(e)
                    self.depth.append(self.depth[at] + 1)
                at = known[key]
            self.end.append(at)


class Aligner:
    """Alignments with one net; what is known of the net is kept from one batch of traces to the next."""

    def __init__(self, net: PetriNet, replayer: Replayer | None = None, few: int = FEW):
        self.net, self.replayer = net, replayer or Replayer(net)
        self.firing = self.replayer.firing
        self.able: dict[Marking, frozenset[str]] = {}
        self.markings = self._all_markings(few)
        if self.markings is not None:
            self._between()
            self.toward = np.ascontiguousarray(self.far.T)
        self.endings: dict[tuple[Event, ...], np.ndarray] = {}
        self.sync: dict[Hashable, tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]] = {}
        self.labels: dict[str, frozenset[str]] | None = None

    def align(self, traces: list[list[Event]], by_sets: bool = False) -> list[tuple[float, list[Move]]]:
        """Cost and moves of a cheapest alignment of each trace."""
        tree = Prefixes(traces, by_sets)
        return self._by_vectors(tree, by_sets) if self.markings is not None else self._by_search(tree, by_sets)

    def costs(self, traces: list[list[Event]]) -> list[float]:
        """Costs of cheapest alignments by sets, without their moves."""
        return [cost for cost, _ in self.align(traces, by_sets=True)] if self.markings is None else self._by_halves(traces)

    # few markings

    def _all_markings(self, few: int) -> list[Marking] | None:
        """All markings within reach, the initial one first, or None if there are more than ``few``."""
        seen, todo = {self.net.initial: 0}, [self.net.initial]
        for m in todo:
            for _, _, after in self.firing.steps(m):
                if after not in seen:
                    if len(seen) >= few:
                        return None
                    seen[after] = len(seen)
                    todo.append(after)
        self.index = seen
        if self.net.final not in seen:
            raise Unbounded("the final marking cannot be reached")
        return todo

    def _between(self) -> None:
        """Costs of the model's moves between all markings: all sources at once are relaxed over all steps until nothing changes."""
        n = len(self.markings)
        self.steps = [[(SILENT if label is None else 1.0, name, label, self.index[after]) for name, label, after in self.firing.steps(m)] for m in self.markings]
        arcs = sorted((j, i, cost) for i, own in enumerate(self.steps) for cost, _, _, j in own)
        self.far = np.full((n, n), np.inf)
        np.fill_diagonal(self.far, 0.0)
        if not arcs:
            return
        into, out_of, costs = (np.array(x) for x in zip(*arcs, strict=True))
        first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
        rows, ends = np.arange(n), into[first]
        while len(rows):  # sources from which something became cheaper
            far = self.far[rows]
            old = far[:, ends]
            better = np.minimum(old, np.minimum.reduceat(far[:, out_of] + costs, first, axis=1))
            far[:, ends] = better
            self.far[rows] = far
            rows = rows[(better < old).any(1)]

    def enabled(self, m: Marking) -> frozenset[str]:
        if m not in self.able:
            self.able[m] = frozenset(self.replayer.enabled(m))
        return self.able[m]

    def distance(self, logged: frozenset[str], m: Marking) -> float:
        able = self.enabled(m)
        return 1 - len(logged & able) / len(logged | able) if logged or able else 0.0

    def _synchronous(self, event: Event, by_sets: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Markings before and after each firing with the event's label, their costs and transitions."""
        key = event if by_sets else event[0]
        if key not in self.sync:
            moves = [(i, j, self.distance(event[1], m) if by_sets else 0.0, name) for i, m in enumerate(self.markings) for _, name, label, j in self.steps[i] if label == event[0]]
            before, after, cost, names = zip(*moves, strict=True) if moves else ((), (), (), ())
            self.sync[key] = np.array(before, int), np.array(after, int), np.array(cost, float), list(names)
        return self.sync[key]

    def _by_vectors(self, tree: Prefixes, by_sets: bool) -> list[tuple[float, list[Move]]]:
        closed: list[np.ndarray | dict[int, float]] = [self.far[0]]
        inner, final = set(tree.parent), self.index[self.net.final]
        for at, (parent, event) in enumerate(zip(tree.parent[1:], tree.event[1:], strict=True), 1):
            before, after, cost, _ = self._synchronous(event, by_sets)
            own = closed[parent] + 1.0  # a log move; the model's moves behind it are no better than before it
            offers = closed[parent][before] + cost
            if at not in inner:  # of a leaf one cost is looked at
                closed.append({final: min(own[final], (offers + self.far[after, final]).min(initial=np.inf))})
                continue
            useful = offers < own[after]
            if useful.any():
                offers, after = offers[useful], after[useful]
                own = np.minimum(own, (offers[:, None] + self.far[after]).min(0))
            closed.append(own)
        found = {end: self._moves_back(tree, closed, end, by_sets) for end in dict.fromkeys(tree.end)}
        return [found[end] for end in tree.end]

    @staticmethod
    def _closed(own: np.ndarray, offers: np.ndarray, places: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The least of costs ``own`` and of ``offers`` at places with the model's moves from there. Of offers few count: some of the cheapest are taken at a
        time, and those go that are no cheaper than what was found."""
        left = np.flatnonzero(offers < own[places])
        left = left[np.argsort(offers[left], kind="stable")]
        while len(left):
            now, left = left[:AT_ONCE], left[AT_ONCE:]
            own = np.minimum(own, (offers[now, None] + far[places[now]]).min(0))
            left = left[offers[left] < own[places[left]]]
        return own

    def _by_halves(self, traces: list[list[Event]]) -> list[float]:
        """Costs by sets: vectors of traces without their last events meet those of these endings. There are as many last events as make the fewest vectors."""
        if len(self.endings) * len(self.markings) > KEPT:
            self.endings.clear()

        def parted(last: int) -> tuple[int, Prefixes, list[tuple[Event, ...]], set[tuple[Event, ...]]]:
            tree, ends = Prefixes([t[: max(0, len(t) - last)] for t in traces], True), [tuple(t[-last:]) for t in traces]
            new = {e[i:] for e in set(ends) for i in range(len(e) + 1)} - self.endings.keys()
            return len(tree.parent) + len(new), tree, ends, new

        last, found = 1, parted(1)
        while (more := parted(last + 1))[0] < found[0]:
            last, found = last + 1, more
        _, tree, ends, new = found
        for e in sorted(new, key=len):
            if not e:
                self.endings[e] = self.toward[self.index[self.net.final]]
                continue
            (before, after, cost, _), closed = self._synchronous(e[0], True), self.endings[e[1:]]
            self.endings[e] = self._closed(closed + 1.0, closed[after] + cost, before, self.toward)
        closed = [self.far[0]]
        for parent, event in zip(tree.parent[1:], tree.event[1:], strict=True):
            before, after, cost, _ = self._synchronous(event, True)
            closed.append(self._closed(closed[parent] + 1.0, closed[parent][before] + cost, after, self.far))
        return [float((closed[at] + self.endings[e]).min()) for at, e in zip(tree.end, ends, strict=True)]

    def _moves_back(self, tree: Prefixes, closed: list[np.ndarray | dict[int, float]], at: int, by_sets: bool) -> tuple[float, list[Move]]:
        m = self.index[self.net.final]
        cost, moves = float(closed[at][m]), []
        while at:
            parent, event, i = tree.parent[at], tree.event[at], tree.depth[at]
            before, after, extra, names = self._synchronous(event, by_sets)
            totals = closed[parent][before] + extra + self.far[after, m]
            best = int(np.argmin(totals)) if len(totals) else -1
            if best >= 0 and totals[best] <= closed[at][m] + NEAR:
                moves += self._way(int(after[best]), m, i)[::-1]
                m = int(before[best])
                moves.append(("sync", names[best], self.markings[m], i - 1))
            else:
                moves.append(("log", None, self.markings[m], i - 1))
            at = parent
        moves += self._way(0, m, 0)[::-1]
        return cost, moves[::-1]

    def _way(self, k: int, m: int, i: int) -> list[Move]:
        """The model's moves from one marking to another at place ``i`` of the trace."""
        way = []
        while k != m:
            name, label, following = next((name, label, j) for cost, name, label, j in self.steps[k] if cost + self.far[j, m] <= self.far[k, m] + NEAR)
            way.append(("silent" if label is None else "model", name, self.markings[k], i))
            k = following
        return way

    # many markings

    def _reachable_labels(self, m: Marking) -> frozenset[str]:
        """Labels that may still be produced from a marking, synchronisation aside."""
        if self.labels is None:
            ahead: dict[str, set[str]] = {}
            free = {label for label, ins, _ in self.net.transitions.values() if label is not None and not ins}
            changed = True
            while changed:
                changed = False
                for label, ins, outs in self.net.transitions.values():
                    new = ({label} if label is not None else set()).union(*(ahead.get(p, ()) for p in outs))
                    for p in ins:
                        if not new <= ahead.setdefault(p, set()):
                            ahead[p] |= new
                            changed = True
                    if not ins and not new <= free:
                        free |= new
                        changed = True
            self.labels = {p: frozenset(x | free) for p, x in ahead.items()} | {"": frozenset(free)}
        return self.labels[""].union(*(self.labels.get(p, ()) for p, _ in m))

    def _by_search(self, tree: Prefixes, by_sets: bool) -> list[tuple[float, list[Move]]]:
        """A* from the root to the end of every trace. An event that is left and whose label the net cannot produce any more costs a log move, so of
        the fewest such events over the traces below a node there are at least as many moves to come."""
        least: list[dict[str, int] | None] = [None] * len(tree.parent)  # of each label, events to come in every trace below
        for end in tree.end:
            least[end] = {}
        for at in range(len(tree.parent) - 1, 0, -1):
            up, label = tree.parent[at], tree.event[at][0]
            own = dict(least[at])
            own[label] = own.get(label, 0) + 1
            least[up] = own if least[up] is None else {a: min(n, own[a]) for a, n in least[up].items() if a in own}
        children: list[list[int]] = [[] for _ in tree.parent]
        for at, up in enumerate(tree.parent[1:], 1):
            children[up].append(at)
        producible: dict[Marking, frozenset[str]] = {}

        def to_come(at: int, m: Marking) -> float:
            if m not in producible:
                producible[m] = self._reachable_labels(m)
            return float(sum(n for a, n in least[at].items() if a not in producible[m]))

        order, root = 0, (0, self.net.initial)
        queue = [(to_come(*root), 0, 0.0, root, None, None)]
        back, ends, found = {}, set(tree.end), {}
        while len(found) < len(ends):
            if not queue:
                raise Unbounded("the final marking cannot be reached")
            _, _, cost, state, before, move = heapq.heappop(queue)
            if state in back:
                continue
            if len(back) > 50 * MOST_STATES:
                raise Unbounded(f"over {50 * MOST_STATES} pairs of prefix and marking")
            back[state] = before, move
            at, m = state
            if m == self.net.final and at in ends and at not in found:
                found[at] = cost
            i = tree.depth[at]
            steps = [(1.0, (child, m), ("log", None, m, i)) for child in children[at]]
            for name, label, after in self.firing.steps(m):
                steps.append((SILENT if label is None else 1.0, (at, after), ("silent" if label is None else "model", name, m, i)))
                if label is not None:
                    steps += [(self.distance(tree.event[child][1], m) if by_sets else 0.0, (child, after), ("sync", name, m, i)) for child in children[at] if tree.event[child][0] == label]
            for more, following, how in steps:
                if following not in back:
                    order += 1
                    heapq.heappush(queue, (cost + more + to_come(*following), order, cost + more, following, state, how))
        out = []
        for end in tree.end:
            moves, state = [], (end, self.net.final)
            while back[state][0] is not None:
                state, move = back[state]
                moves.append(move)
            out.append((found[end], moves[::-1]))
        return out
