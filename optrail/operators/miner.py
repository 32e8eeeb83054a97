"""Inductive miner over weighted traces: graphs, cuts, splits, and the recursion over a log that is held in memory.

``levels`` runs the same decisions over tables, for logs of any size, and comes here with what is small.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from .model import TAU, Tree, leaf, node

#: By directly-follows pairs, by enabled sets, one after the other, and tolerant of rare behaviour.
VARIANTS = ("im", "imto", "imts", "imtf", "imf")
#: Deepest recursion; below it a flower stands. Every cut takes activities away and every other split is followed by one, so a log of fewer than half as many activities does not get there.
DEEPEST = 500

Trace = tuple[tuple[str, frozenset[str]], ...]
Log = dict[Trace, int]


@dataclass
class Graph:
    """Directly-follows graph over the activities of a log."""

    nodes: list[str]
    edges: dict[tuple[str, str], float]
    starts: dict[str, float]
    ends: dict[str, float]


def alphabet(log: Log) -> list[str]:
    return sorted({a for trace in log for a, _ in trace})


def classical_graph(log: Log) -> Graph:
    edges, starts, ends = Counter(), Counter(), Counter()
    for trace, n in log.items():
        acts = [a for a, _ in trace]
        if acts:
            starts[acts[0]] += n
            ends[acts[-1]] += n
            for pair in zip(acts, acts[1:], strict=False):
                edges[pair] += n
    return Graph(alphabet(log), edges, starts, ends)


def translucent_graph(log: Log, by_frequency: bool = False) -> Graph:
    """Pairs that follow or run in parallel by the enabled sets: one for each relation, or counts less those of choice."""
    nodes = alphabet(log)
    known, follows, both, less, starts, ends = set(nodes), Counter(), Counter(), Counter(), Counter(), Counter()
    for trace, n in log.items():
        sets = [en & known for _, en in trace]
        if not trace:
            continue
        starts.update({a: n for a in sets[0]})
        ends.update({a: n for a in sets[-1]})
        for (x, _), here, after in zip(trace, sets, sets[1:], strict=False):
            follows.update({(x, a): n for a in after})
            for a in here:
                target = both if a in after else less
                target[x, a] += n
                target[a, x] += n
    if by_frequency:
        edges = {p: follows[p] + both[p] - less[p] for p in follows.keys() | both.keys()}
        return Graph(nodes, {p: w for p, w in edges.items() if w > 0}, starts, ends)
    edges = Counter(dict.fromkeys(follows, 1))
    edges.update(dict.fromkeys(both, 1))
    return Graph(nodes, edges, dict.fromkeys(starts, 1), dict.fromkeys(ends, 1))


def without_rare(g: Graph, threshold: float, with_ends: bool = False) -> Graph:
    """Edges under a share of their source's strongest go; a node left without incoming edges gets its strongest back. ``with_ends`` counts ending as an
    edge, and starting as an incoming one."""
    if threshold <= 0:
        return g
    top: dict[str, float] = dict(g.ends) if with_ends else {}
    for (a, _), w in g.edges.items():
        top[a] = max(w, top.get(a, 0))
    kept = {p: w for p, w in g.edges.items() if w >= threshold * top[p[0]]}
    fed = {b for _, b in kept} | (set(g.starts) if with_ends else set())
    for b in {b for _, b in g.edges} - fed:
        a = min((a for a, x in g.edges if x == b), key=lambda a: (-g.edges[a, b], a))
        kept[a, b] = g.edges[a, b]
    cut = lambda m: {a: w for a, w in m.items() if w >= threshold * max(m.values())}
    return Graph(g.nodes, kept, cut(g.starts), cut(g.ends))


class Part:
    """What decides how a part of a log is split; here from the part itself."""

    def __init__(self, log: Log):
        self.log = {t: n for t, n in log.items() if t}
        self.empty, self.filled = log.get((), 0), sum(self.log.values())

    @cached_property
    def nodes(self) -> list[str]:
        return alphabet(self.log)

    @cached_property
    def single(self) -> bool:
        """Whether all traces with events have one."""
        return all(len(t) == 1 for t in self.log)

    @cached_property
    def once(self) -> list[str]:
        """Activities that occur exactly once in each trace with events."""
        return [a for a in self.nodes if all(sum(x == a for x, _ in t) == 1 for t in self.log)]

    @cached_property
    def classical(self) -> Graph:
        return classical_graph(self.log)

    @cached_property
    def translucent(self) -> Graph:
        return translucent_graph(self.log)

    @cached_property
    def frequent(self) -> Graph:
        return translucent_graph(self.log, True)


def graphs(part: Part, variant: str, noise: float) -> list[Graph]:
    """The graphs to look for cuts in, in order."""
    classical = lambda: without_rare(part.classical, noise)
    translucent = lambda: without_rare(part.frequent, noise) if noise > 0 else part.translucent
    tolerant = [lambda: part.classical, *([lambda: without_rare(part.classical, noise, True)] if noise > 0 else [])]
    makers = {"im": [classical], "imto": [translucent], "imts": [classical, translucent], "imtf": [translucent, classical], "imf": tolerant}
    return [make() for make in makers[variant]]


def known_variant(variant: str) -> str:
    if variant.lower() not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; one of {VARIANTS}")
    return variant.lower()


@dataclass
class Split:
    """How a part is split: the operator above its children, leaves among them that are known already, and what goes into the others.

    ``how`` is one of "xor", "project", "segments" (in their order, with least loss), "loop" (body and redo) and "restart" (before ``groups[0]``, behind
    ``groups[1]`` if there is one). "project" takes traces with events alone if ``filled`` says so.
    """

    kind: str
    how: str
    groups: list[list[str]]
    before: tuple[Tree, ...] = ()
    after: tuple[Tree, ...] = ()
    filled: bool = False

    def children(self) -> int:
        return {"loop": 2, "restart": 1}.get(self.how, len(self.groups))

    def tree(self, children: list[Tree]) -> Tree:
        parts = (*self.before, *children, *self.after)
        return Tree("loop", None, parts) if self.kind == "loop" else node(self.kind, *parts)


def decide(part: Part, variant: str, noise: float, depth: int) -> Tree | Split:
    """The tree of a part, or how to split it."""
    if not part.filled:
        return leaf(TAU)
    if depth >= DEEPEST:
        return flower(part.nodes)
    if part.empty:
        if variant == "imf" and part.empty < noise * (part.empty + part.filled):  # so few empty traces that they are noise
            return Split("seq", "project", [part.nodes], filled=True)
        return Split("xor", "project", [part.nodes], before=(leaf(TAU),), filled=True)
    if len(part.nodes) == 1 and part.single:
        return leaf(part.nodes[0])
    for g in graphs(part, variant, noise):
        cut = find_cut(g)
        if cut:
            kind, groups = cut
            if kind == "loop":
                groups = [groups[0], sorted(set().union(*groups[1:]))]
            how = {"xor": "xor", "loop": "loop", "seq": "segments" if variant == "imf" else "project"}.get(kind, "project")
            return Split(kind, how, groups)
    if len(part.nodes) > 1 and part.once:
        return Split("and", "project", [[a for a in part.nodes if a != part.once[0]]], before=(leaf(part.once[0]),))
    g = part.classical
    for limits in (set(g.ends), None):
        if any(y in g.starts and (limits is None or x in limits) for x, y in g.edges):
            return Split("loop", "restart", [sorted(g.starts), *([sorted(limits)] if limits else [])], after=(leaf(TAU),))
    return flower(part.nodes)


def groups_of(nodes: list[str], linked) -> list[list[str]]:
    """Connected groups of nodes under a symmetric relation, by smallest member."""
    left, out = list(nodes), []
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            a = todo.pop()
            group.append(a)
            near = [b for b in left if linked(a, b)]
            left = [b for b in left if b not in near]
            todo += near
        out.append(sorted(group))
    return sorted(out)


def reach(g: Graph) -> dict[str, set[str]]:
    """Nodes reachable over one edge or more."""
    ahead = {a: {b for x, b in g.edges if x == a and b != a} for a in g.nodes}
    out = {}
    for a in g.nodes:
        seen, todo = set(), list(ahead[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += ahead.get(b, ())
        out[a] = seen
    return out


def find_cut(g: Graph) -> tuple[str, list[list[str]]] | None:
    """The first of exclusive, sequential, parallel and loop cuts that applies."""
    if len(g.nodes) < 2:
        return None
    edge = lambda a, b: (a, b) in g.edges
    apart = groups_of(g.nodes, lambda a, b: edge(a, b) or edge(b, a))
    if len(apart) > 1:
        return "xor", apart
    far = reach(g)
    together = groups_of(g.nodes, lambda a, b: (b in far[a]) == (a in far[b]))
    if len(together) > 1:
        # between two groups reachability goes one way; the earlier reaches more
        return "seq", sorted(together, key=lambda grp: (-len(far[grp[0]] - set(grp)), grp))
    parts = groups_of(g.nodes, lambda a, b: not (edge(a, b) and edge(b, a)))
    if len(parts) > 1 and all(set(p) & set(g.starts) and set(p) & set(g.ends) for p in parts):
        return "and", parts
    return loop_cut(g)


def loop_cut(g: Graph) -> tuple[str, list[list[str]]] | None:
    """The body around starts and ends, and parts that lead only from ends back to starts."""
    body = set(g.starts) | set(g.ends)
    rest = [a for a in g.nodes if a not in body]
    redo = []
    for part in groups_of(rest, lambda a, b: (a, b) in g.edges or (b, a) in g.edges):
        own = set(part)
        into = {(a, b) for a, b in g.edges if b in own and a not in own}
        back = {(a, b) for a, b in g.edges if a in own and b not in own}
        good = into and back and all(a in g.ends for a, _ in into) and all(b in g.starts for _, b in back)
        if good:
            redo.append(part)
        else:
            body |= own
    return ("loop", [sorted(body), *redo]) if redo else None


def kept(trace: Trace, keep: set[str]) -> Trace:
    return tuple((a, en & keep) for a, en in trace if a in keep)


def segments(trace: Trace, sets: list[set[str]]) -> list[int]:
    """The group of each event, never falling along the trace, so that the most events lie in their own; of equals the last in order."""
    best: list[tuple[int, list[int]]] = [(0, [])] * len(sets)
    for a, _ in trace:
        best = [max((best[i][0] + (a in s), [*best[i][1], j]) for i in range(j + 1)) for j, s in enumerate(sets)]
    return max(best)[1]


def split_trace(trace: Trace, split: Split) -> list[tuple[int, Trace]]:
    """(child, trace) of all that one trace gives."""
    sets = [set(x) for x in split.groups]
    if split.how == "xor":
        counts = [sum(a in s for a, _ in trace) for s in sets]
        k = counts.index(max(counts))
        return [(k, kept(trace, sets[k]))]
    if split.how == "segments":
        path = segments(trace, sets)
        return [(j, tuple((a, en & s) for (a, en), k in zip(trace, path, strict=True) if k == j and a in s)) for j, s in enumerate(sets)]
    if split.how == "project":
        return [(j, kept(trace, s)) for j, s in enumerate(sets)] if trace or not split.filled else []
    out, part = [], []
    if split.how == "restart":
        for a, en in trace:
            if part and a in sets[0] and (len(sets) == 1 or part[-1][0] in sets[1]):
                out.append((0, tuple(part)))
                part = []
            part.append((a, en))
        return [*out, (0, tuple(part))]
    doing = True
    for a, en in trace:
        if (a in sets[0]) != doing:
            out.append((0 if doing else 1, tuple(part)))
            part, doing = [], not doing
        part.append((a, en & sets[0 if doing else 1]))
    return [*out, (0, tuple(part))] if doing else [*out, (1, tuple(part)), (0, ())]


def mine_tree(log: Log, variant: str = "imtf", noise: float = 0.0, depth: int = 0) -> Tree:
    """The process tree of a log of weighted traces."""
    variant = known_variant(variant)
    found = decide(Part(log), variant, noise, depth)
    if isinstance(found, Tree):
        return found
    logs: list[Log] = [Counter() for _ in range(found.children())]
    for trace, n in log.items():
        for k, part in split_trace(trace, found):
            logs[k][part] += n
    return found.tree([mine_tree(x, variant, noise, depth + 1) for x in logs])


def flower(names: list[str]) -> Tree:
    """Any activities in any order."""
    return Tree("loop", None, (leaf(TAU), *map(leaf, names)))
