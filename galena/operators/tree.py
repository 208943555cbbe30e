"""Expression trees: immutable nodes, structure, keys, tapes and evaluation in memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

from galena.functions.pointwise import BINARY, NP_BINARY, NP_REDUCE, NP_UNARY, REDUCE, UNARY
from galena.operators.measures import AXES, Functional, Linear, Measure2D


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: float

    def __str__(self) -> str:
        return f"{self.value:.6g}"


@dataclass(frozen=True)
class BinOp:
    op: str
    a: Node
    b: Node

    def __post_init__(self) -> None:
        if self.op not in BINARY:
            raise ValueError(f"no binary operator {self.op!r}")

    def __str__(self) -> str:
        return f"{self.op}({self.a}, {self.b})"


@dataclass(frozen=True)
class UnOp:
    op: str
    a: Node

    def __post_init__(self) -> None:
        if self.op not in UNARY and self.op not in REDUCE:
            raise ValueError(f"no unary operator {self.op!r}")

    def __str__(self) -> str:
        return f"{self.op}({self.a})"


@dataclass(frozen=True)
class FunctionalOp:
    functional: Functional
    args: tuple[Node, ...]

    def __post_init__(self) -> None:
        if len(self.args) != self.functional.arity:
            raise ValueError(f"this functional takes {self.functional.arity} arguments")

    def __str__(self) -> str:
        return f"{self.functional}[{', '.join(map(str, self.args))}]"


@dataclass(frozen=True)
class FunctionalOp2D:
    measure: Measure2D
    arg: Node

    def __str__(self) -> str:
        return f"{self.measure}[{self.arg}]"


Node = Var | Const | BinOp | UnOp | FunctionalOp | FunctionalOp2D


def children(node: Node) -> tuple[Node, ...]:
    match node:
        case BinOp(_, a, b):
            return (a, b)
        case UnOp(_, a):
            return (a,)
        case FunctionalOp(_, args):
            return args
        case FunctionalOp2D(_, arg):
            return (arg,)
    return ()


def with_children(node: Node, new: tuple[Node, ...]) -> Node:
    match node:
        case BinOp():
            return replace(node, a=new[0], b=new[1])
        case UnOp():
            return replace(node, a=new[0])
        case FunctionalOp():
            return replace(node, args=tuple(new))
        case FunctionalOp2D():
            return replace(node, arg=new[0])
    return node


def subtrees(node: Node) -> Iterator[Node]:
    """The node, then its children's subtrees from the left."""
    yield node
    for c in children(node):
        yield from subtrees(c)


def complexity(node: Node) -> int:
    """The number of nodes; a measure's parameters cost nothing."""
    return sum(1 for _ in subtrees(node))


def depth(node: Node) -> int:
    return 1 + max((depth(c) for c in children(node)), default=0)


def used_features(node: Node) -> set[str]:
    return {n.name for n in subtrees(node) if isinstance(n, Var)}


def replace_at(node: Node, index: int, new: Node) -> Node:
    """The tree with its subtree number `index` (in the order of subtrees) replaced."""
    if index == 0:
        return new
    index -= 1
    made = []
    for c in children(node):
        size = complexity(c)
        made.append(replace_at(c, index, new) if 0 <= index < size else c)
        index -= size
    return with_children(node, tuple(made))


def constants(node: Node) -> list[float]:
    return [n.value for n in subtrees(node) if isinstance(n, Const)]


def with_constants(node: Node, values: list[float]) -> Node:
    left = iter(values)

    def put(n: Node) -> Node:
        return Const(float(next(left))) if isinstance(n, Const) else with_children(n, tuple(put(c) for c in children(n)))

    out = put(node)
    if next(left, None) is not None:
        raise ValueError("more values than constants")
    return out


def topology(node: Node) -> Node:
    """The tree with all constants alike: equal for trees that differ in constants alone."""
    return with_constants(node, [0.0] * len(constants(node)))


def key(node: Node) -> str:
    """A text that is equal for equal trees only: constants with all their digits."""
    match node:
        case Var(name):
            return f"v:{name}"
        case Const(value):
            return f"c:{value!r}"
        case BinOp(op, a, b):
            return f"{op}({key(a)},{key(b)})"
        case UnOp(op, a):
            return f"{op}({key(a)})"
        case FunctionalOp(f, args):
            return f"{f!r}({','.join(map(key, args))})"
        case FunctionalOp2D(m, arg):
            return f"{m!r}({key(arg)})"
    raise TypeError(node)


def is_pointwise(node: Node) -> bool:
    """Whether each row's value needs that row alone."""
    return not any(isinstance(n, FunctionalOp | FunctionalOp2D) or isinstance(n, UnOp) and n.op in REDUCE for n in subtrees(node))


def evaluate(node: Node, env: dict[str, np.ndarray], fill: float = float("nan"), memo: dict | None = None) -> np.ndarray | float:
    """In memory, over arrays of one length (or fields of one shape). memo: results of measures by node, kept between trees."""
    memo = {} if memo is None else memo
    match node:
        case Var(name):
            if name not in env:
                raise KeyError(f"no column {name!r}")
            return env[name]
        case Const(value):
            return value
        case BinOp(op, a, b):
            with np.errstate(all="ignore"):
                return NP_BINARY[op](np.asarray(evaluate(a, env, fill, memo), float), np.asarray(evaluate(b, env, fill, memo), float))
        case UnOp(op, a):
            x = np.asarray(evaluate(a, env, fill, memo), float)
            with np.errstate(all="ignore"):
                return NP_REDUCE[op](x) if op in NP_REDUCE else NP_UNARY[op](x)
        case FunctionalOp(f, args):
            if node not in memo:
                shape = next(iter(env.values())).shape
                values = [np.broadcast_to(np.asarray(evaluate(x, env, fill, memo), float), shape) for x in args]
                out = np.ones(shape)
                for mu, i in f.parts():
                    half = FunctionalOp(Linear(mu, f.axis), (args[i],))
                    if half not in memo:
                        memo[half] = mu.apply(values[i], fill) if f.axis is None else np.apply_along_axis(mu.apply, AXES.index(f.axis), values[i], fill)
                    out = out * memo[half]
                memo[node] = out
            return memo[node]
        case FunctionalOp2D(m, arg):
            if node not in memo:
                shape = next(iter(env.values())).shape
                memo[node] = m.apply(np.broadcast_to(np.asarray(evaluate(arg, env, fill, memo), float), shape), fill)
            return memo[node]
    raise TypeError(node)


# --- tapes: post-order programs, how trees travel in rows


def to_tape(node: Node) -> list[tuple[str, str, float]]:
    """(kind, name, value) in post-order; only pointwise and reducing nodes have tapes."""
    match node:
        case Var(name):
            return [("var", name, 0.0)]
        case Const(value):
            return [("const", "", value)]
        case BinOp(op, a, b):
            return [*to_tape(a), *to_tape(b), ("bin", op, 0.0)]
        case UnOp(op, a):
            return [*to_tape(a), ("un", op, 0.0)]
    raise ValueError("a measure has no tape; make its column first")


def from_tape(tape: list[tuple[str, str, float]]) -> Node:
    stack: list[Node] = []
    for kind, name, value in tape:
        if kind == "var":
            stack.append(Var(name))
        elif kind == "const":
            stack.append(Const(value))
        elif kind == "bin":
            b, a = stack.pop(), stack.pop()
            stack.append(BinOp(name, a, b))
        else:
            stack.append(UnOp(name, stack.pop()))
    (node,) = stack
    return node


def run_tape(tape: list[tuple[str, str, float]], env: dict[str, np.ndarray]) -> np.ndarray | float:
    """A stack machine over arrays."""
    stack: list = []
    with np.errstate(all="ignore"):
        for kind, name, value in tape:
            if kind == "var":
                stack.append(env[name])
            elif kind == "const":
                stack.append(np.float64(value))
            elif kind == "bin":
                b, a = stack.pop(), stack.pop()
                stack.append(NP_BINARY[name](a, b))
            else:
                stack.append(NP_REDUCE[name](stack.pop()) if name in NP_REDUCE else NP_UNARY[name](stack.pop()))
    (out,) = stack
    return out
