"""Process trees and Petri nets: small driver-side values, whatever the size of the log."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

TAU = None


@dataclass(frozen=True)
class Tree:
    """A leaf (kind "leaf", label or None for silent) or an operator: seq, xor, and, loop(do, redo...)."""

    kind: str
    label: str | None = None
    children: tuple[Tree, ...] = ()

    def __str__(self) -> str:
        if self.kind == "leaf":
            return "tau" if self.label is None else self.label
        return f"{self.kind}({', '.join(map(str, self.children))})"

    def labels(self) -> set[str]:
        return ({self.label} if self.label is not None else set()) if self.kind == "leaf" else set().union(*(c.labels() for c in self.children))


def leaf(label: str | None) -> Tree:
    return Tree("leaf", label)


def node(kind: str, *children: Tree) -> Tree:
    return children[0] if len(children) == 1 and kind != "loop" else Tree(kind, None, children)


def fold(tree: Tree) -> Tree:
    """Equal operators merged into their parents, silent steps dropped from seq and and, choices and parallels in one order."""
    if tree.kind == "leaf":
        return tree
    parts: list[Tree] = []
    for child in map(fold, tree.children):
        parts += child.children if child.kind == tree.kind and tree.kind != "loop" else (child,)
    if tree.kind in ("seq", "and"):
        parts = [p for p in parts if p != leaf(TAU)] or [leaf(TAU)]
    if tree.kind == "xor":
        parts = sorted(set(parts), key=str)
        nested = [p for p in parts if p.kind == "loop" and leaf(TAU) == p.children[0]]
        if nested and leaf(TAU) in parts:  # a loop over a silent step may do nothing anyway
            parts.remove(leaf(TAU))
    if tree.kind == "and":
        parts = sorted(parts, key=str)
    if tree.kind == "loop":
        return Tree("loop", None, (parts[0], *sorted(parts[1:], key=str)))
    return node(tree.kind, *parts)


def parse_identifier(text: str, names: set[str] | None = None) -> Tree:
    """The tree of an identifier or of a tree's text; ``epsilon`` and ``tau`` are silent. A text in ``names`` is an activity,
    whatever it looks like."""
    if names and text in names:
        return leaf(text)
    if text in ("epsilon", "tau"):
        return leaf(TAU)
    for kind in ("seq", "xor", "and", "loop"):
        if text.startswith(f"{kind}(") and text.endswith(")"):
            parts, depth, start, inner = [], 0, 0, text[len(kind) + 1 : -1]
            for i, c in enumerate(inner):
                depth += (c == "(") - (c == ")")
                if depth == 0 and inner.startswith(", ", i):
                    parts.append(inner[start:i])
                    start = i + 2
            parts.append(inner[start:])
            return Tree(kind, None, tuple(parse_identifier(p, names) for p in parts))
    return leaf(text)


def follows(tree: Tree) -> tuple[set[str], set[str], set[tuple[str, str]], bool]:
    """First and last activities of a tree's runs, pairs that may follow each other directly, and whether a run may be empty."""
    if tree.kind == "leaf":
        own = set() if tree.label is None else {tree.label}
        return own, own, set(), tree.label is None
    parts = [follows(c) for c in tree.children]
    pairs = set().union(*(p for _, _, p, _ in parts))
    if tree.kind == "xor":
        return set().union(*(s for s, *_ in parts)), set().union(*(e for _, e, _, _ in parts)), pairs, any(empty for *_, empty in parts)
    if tree.kind == "and":
        for i, a in enumerate(tree.children):
            for b in tree.children[:i]:
                pairs |= {(x, y) for x in a.labels() for y in b.labels()} | {(y, x) for x in a.labels() for y in b.labels()}
        return set().union(*(s for s, *_ in parts)), set().union(*(e for _, e, _, _ in parts)), pairs, all(empty for *_, empty in parts)
    if tree.kind == "loop":
        (starts, ends, _, empty), redo = parts[0], parts[1:]
        again, back = set().union(*(s for s, *_ in redo)), set().union(*(e for _, e, _, _ in redo))
        skips = any(x for *_, x in redo)
        pairs |= {(x, y) for x in ends for y in again} | {(x, y) for x in back for y in starts}
        if skips:
            pairs |= {(x, y) for x in ends for y in starts}
        if empty:
            pairs |= {(x, y) for x in back for y in again}
        return starts | (again if empty else set()), ends | (back if empty else set()), pairs, empty
    starts: set[str] = set()
    ends: set[str] = set()
    whole = True
    for s, e, _, empty in parts:
        pairs |= {(x, y) for x in ends for y in s}
        starts |= s if whole else set()
        ends = e | (ends if empty else set())
        whole = whole and empty
    return starts, ends, pairs, whole


Marking = tuple[tuple[str, int], ...]


@dataclass
class PetriNet:
    """Transitions by name with label (None: silent), input and output places; initial and final marking."""

    transitions: dict[str, tuple[str | None, tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    initial: Marking = ()
    final: Marking | None = None

    def add(self, name: str, label: str | None, inputs: list[str], outputs: list[str]) -> None:
        self.transitions[name] = (label, tuple(inputs), tuple(outputs))

    def places(self) -> set[str]:
        return {p for _, i, o in self.transitions.values() for p in (*i, *o)} | {p for p, _ in self.initial} | {p for p, _ in self.final or ()}

    def enabled(self, marking: Marking) -> list[str]:
        """Names of enabled transitions: silent ones first, then by label, places and name."""
        tokens = dict(marking)
        able = [n for n, (_, i, _) in self.transitions.items() if all(tokens.get(p, 0) >= c for p, c in Counter(i).items())]
        return sorted(able, key=lambda n: (self.transitions[n][0] is not None, self.transitions[n][0] or "", self.transitions[n][1], self.transitions[n][2], n))

    def fire(self, marking: Marking, name: str) -> Marking:
        tokens = Counter(dict(marking))
        _, inputs, outputs = self.transitions[name]
        tokens.subtract(inputs)
        tokens.update(outputs)
        return tuple(sorted((p, c) for p, c in tokens.items() if c))


class Firing:
    """What may happen at the markings of a net that is not changed any more; each marking is worked out once."""

    def __init__(self, net: PetriNet):
        order = sorted(net.transitions, key=lambda n: (net.transitions[n][0] is not None, net.transitions[n][0] or "", *net.transitions[n][1:], n))
        self.order = [(n, net.transitions[n][0], Counter(net.transitions[n][1]), Counter(net.transitions[n][2])) for n in order]
        self.known: dict[Marking, list[tuple[str, str | None, Marking]]] = {}

    def steps(self, marking: Marking) -> list[tuple[str, str | None, Marking]]:
        """(transition, label, marking after) of all that are enabled, in the order of ``PetriNet.enabled``."""
        if marking not in self.known:
            tokens, out = dict(marking), []
            for name, label, ins, outs in self.order:
                if all(tokens.get(p, 0) >= c for p, c in ins.items()):
                    after = dict(tokens)
                    for p, c in ins.items():
                        after[p] -= c
                    for p, c in outs.items():
                        after[p] = after.get(p, 0) + c
                    out.append((name, label, tuple(sorted((p, c) for p, c in after.items() if c))))
            self.known[marking] = out
        return self.known[marking]


def net_of(tree: Tree) -> PetriNet:
    """An accepting net of a tree, with silent splits and joins merged into neighbours where behaviour allows."""
    net, counter = PetriNet(), [0]

    def fresh(kind: str) -> str:
        counter[0] += 1
        return f"{kind}{counter[0]}"

    def build(t: Tree, start: str, end: str) -> None:
        if t.kind == "leaf":
            net.add(fresh("t"), t.label, [start], [end])
        elif t.kind == "seq":
            stops = [start, *(fresh("p") for _ in t.children[:-1]), end]
            for child, a, b in zip(t.children, stops, stops[1:], strict=False):
                build(child, a, b)
        elif t.kind == "xor":
            for child in t.children:
                build(child, start, end)
        elif t.kind == "and":
            ins, outs = [fresh("p") for _ in t.children], [fresh("p") for _ in t.children]
            net.add(fresh("t"), TAU, [start], ins)
            for child, a, b in zip(t.children, ins, outs, strict=True):
                build(child, a, b)
            net.add(fresh("t"), TAU, outs, [end])
        else:
            a, b = fresh("p"), fresh("p")
            net.add(fresh("t"), TAU, [start], [a])
            build(t.children[0], a, b)
            for child in t.children[1:]:
                build(child, b, a)
            net.add(fresh("t"), TAU, [b], [end])

    build(tree, "source", "sink")
    net.initial, net.final = (("source", 1),), (("sink", 1),)
    return reduce_silent(net)


def reduce_silent(net: PetriNet) -> PetriNet:
    """Merge a silent transition into the only transition before its only input, or after its only output."""
    changed = True
    while changed:
        changed = False
        producers: dict[str, list[str]] = {}
        consumers: dict[str, list[str]] = {}
        for n, (_, ins, outs) in net.transitions.items():
            for p in ins:
                consumers.setdefault(p, []).append(n)
            for p in outs:
                producers.setdefault(p, []).append(n)
        marked = {p for p, _ in (*net.initial, *(net.final or ()))}
        for n, (label, ins, outs) in list(net.transitions.items()):
            if label is not None:
                continue
            if len(ins) == 1 and ins[0] not in marked and consumers[ins[0]] == [n] and len(producers.get(ins[0], [])) == 1 and producers[ins[0]] != [n]:
                other = producers[ins[0]][0]
                lab, i, o = net.transitions[other]
                net.transitions[other] = (lab, i, tuple(sorted((*(p for p in o if p != ins[0]), *outs))))
            elif len(outs) == 1 and outs[0] not in marked and producers[outs[0]] == [n] and len(consumers.get(outs[0], [])) == 1 and consumers[outs[0]] != [n]:
                other = consumers[outs[0]][0]
                lab, i, o = net.transitions[other]
                net.transitions[other] = (lab, tuple(sorted((*(p for p in i if p != outs[0]), *ins))), o)
            else:
                continue
            del net.transitions[n]
            changed = True
            break
    return net
