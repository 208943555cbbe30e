"""A population of trees as one program: nodes interned, constants of alike trees stacked.

Trees go into a directed graph in which equal subtrees are one node, equal up to the order of commutative operands. Trees that differ in
their constants alone have one topology; a topology's trees are evaluated together, their constants a column of a matrix, and what
holds no constant is evaluated once for all. Nodes know their uses, so values are given back after the last one, and a node that
many trees use is known as one that is worth a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from galena.functions.pointwise import COMMUTATIVE, NP_BINARY, NP_UNARY
from galena.operators import tree as T
from galena.operators.tree import BinOp, Const, FunctionalOp, FunctionalOp2D, Node, UnOp, Var, children, with_children

#: Trees of one topology that are evaluated together, rows of a step, and values held at once, in the processor's cache.
TOGETHER, CHUNK, HELD = 8, 4096, 1 << 21


def ordered(node: Node) -> Node:
    """The tree with operands of commutative operators in one order: of trees equal up to that order, one. Values do not change."""
    return _ordered(node)[0]


def _ordered(node: Node) -> tuple[Node, str, str]:
    """(the tree, the key of its topology, its key); operands stand by topology first, so constants do not move what they stand for."""
    made = [_ordered(c) for c in children(node)]
    if isinstance(node, BinOp) and node.op in COMMUTATIVE:
        made.sort(key=lambda m: m[1:])
    if made:
        node = with_children(node, tuple(m[0] for m in made))
    match node:
        case Var(name):
            return node, f"v:{name}", ""
        case Const(value):
            return node, "c", repr(value)
        case BinOp(op) | UnOp(op):
            head = op
        case FunctionalOp(f):
            head = repr(f)
        case FunctionalOp2D(m):
            head = repr(m)
    return node, f"{head}({','.join(m[1] for m in made)})", f"({','.join(m[2] for m in made)})"


def canonical_key(node: Node) -> str:
    """A text that is equal for trees that are equal up to the order of commutative operands, and for no others."""
    return T.key(ordered(node))


def topology_key(node: Node) -> str:
    """The same, with all constants alike."""
    return _ordered(node)[1]


class Dag:
    """Interned nodes of trees in canonical order. add() gives a tree's number; numbers of operands are below that of what uses them."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.uses: list[int] = []
        self.added = 0

    def _number(self, what: tuple) -> int:
        """what: a kind, what it holds, and the numbers of its operands."""
        found = self.numbers.get(what)
        if found is None:
            found = self.numbers[what] = len(self.nodes)
            self.nodes.append(what)
            self.uses.append(0)
            for i in what[2]:
                self.uses[i] += 1
        return found

    def add(self, node: Node, constant: Callable[[float], tuple] | None = None) -> int:
        """constant: the node that stands for a constant, from left to right; without it, itself."""
        self.added += 1
        args = tuple(self.add(c, constant) for c in children(node))
        match node:
            case Var(name):
                return self._number(("var", name, ()))
            case Const(value):
                return self._number(constant(value) if constant else ("const", repr(value), ()))
            case BinOp(op):
                return self._number(("bin", op, args))
            case UnOp(op):
                return self._number(("un", op, args))
            case FunctionalOp(f):
                return self._number(("functional", f, args))
            case FunctionalOp2D(m):
                return self._number(("field", m, args))
        raise TypeError(node)

    def shared(self, least: int = 2) -> list[int]:
        """Operator nodes of at least so many uses: what is worth a column."""
        return [i for i, (kind, _, _) in enumerate(self.nodes) if kind not in ("var", "const", "slot") and self.uses[i] >= least]


class Population:
    """Pointwise trees, ready to be evaluated over arrays again and again.

    Trees of one topology are dealt into groups of TOGETHER; a tree alone in its topology keeps its constants as numbers.
    """

    def __init__(self, trees: list[Node], stack: bool = True) -> None:
        self.size = len(trees)
        self.dag = Dag()
        alike: dict[str, dict[tuple, tuple[Node, list[int]]]] = {}
        for i, t in enumerate(trees):
            t, shape, _ = _ordered(t)
            alike.setdefault(shape, {}).setdefault(tuple(map(repr, T.constants(t))), (t, []))[1].append(i)
        self.topologies = len(alike)
        self.distinct = sum(map(len, alike.values()))
        #: root node -> for each of its rows the trees that have these values
        self.roots: dict[int, list[list[int]]] = {}
        self.slots: dict[tuple[int, int], np.ndarray] = {}
        for members in alike.values():
            members = list(members.values())
            if not stack or len(members) == 1:
                for t, places in members:
                    self.roots.setdefault(self.dag.add(t), [[]])[0].extend(places)
                continue
            for at in range(0, len(members), TOGETHER):
                self._group(members[at : at + TOGETHER])
        last: dict[int, int] = {}
        self.steps = [(i, kind, what, args) for i, (kind, what, args) in enumerate(self.dag.nodes)]
        for i, _, _, args in self.steps:
            for a in args:
                last[a] = i
        self.gone: list[list[int]] = [[] for _ in self.steps]
        for a, i in last.items():
            self.gone[i].append(a)
        self.rows = int(min(CHUNK, max(256, HELD // max(1, self._most_held()))))

    def _group(self, members: list[tuple[Node, list[int]]]) -> None:
        group = len(self.slots)
        values = np.array([T.constants(t) for t, _ in members], float)
        count = iter(range(values.shape[1]))

        def slot(_: float) -> tuple:
            return ("slot", (group, next(count)), ())

        root = self.dag.add(members[0][0], slot)
        for j, column in enumerate(values.T):
            self.slots[group, j] = column[:, None]
        self.roots[root] = [places for _, places in members]

    def _most_held(self) -> int:
        """Values of a row that are held at once at most."""
        held = most = 0
        width = [1] * len(self.steps)
        for i, kind, what, args in self.steps:
            width[i] = len(self.slots[what]) if kind == "slot" else max((width[a] for a in args), default=1)
            if args:
                held += width[i]
                most = max(most, held)
                held -= sum(width[a] for a in self.gone[i] if self.steps[a][3])
            if i in self.roots and not self.dag.uses[i] and args:
                held -= width[i]
        return most

    def run(self, env: dict[str, np.ndarray]) -> Iterator[tuple[list[list[int]], np.ndarray]]:
        """(trees of each row, values), as roots come up: a row of values for each of the group's constants, or one for all."""
        values: list = [None] * len(self.steps)
        with np.errstate(all="ignore"):
            for i, kind, what, args in self.steps:
                if kind == "bin":
                    values[i] = NP_BINARY[what](values[args[0]], values[args[1]])
                elif kind == "un":
                    values[i] = NP_UNARY[what](values[args[0]])
                elif kind == "var":
                    values[i] = env[what]
                elif kind == "slot":
                    values[i] = self.slots[what]
                elif kind == "const":
                    values[i] = np.float64(what)
                else:
                    raise ValueError("measures must be columns first")
                if i in self.roots:
                    yield self.roots[i], values[i]
                    if not self.dag.uses[i]:
                        values[i] = None
                for a in self.gone[i]:
                    values[a] = None

    def predictions(self, env: dict[str, np.ndarray]) -> np.ndarray:
        """All trees' values, a row each, over arrays that fit in memory."""
        n = len(next(iter(env.values())))
        out = np.empty((self.size, n))
        for trees, values in self.run(env):
            rows = np.broadcast_to(values, (len(trees), n))
            for places, row in zip(trees, rows, strict=True):
                out[places] = row
        return out


__all__ = ["Dag", "Population", "canonical_key", "ordered", "topology_key"]
