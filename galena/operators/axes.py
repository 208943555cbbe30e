"""What the axes of columns mean, and whether a tree respects it: a check at bind time, before any plan is made."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.pointwise import REDUCE
from galena.operators.measures import AXES
from galena.operators.tree import FunctionalOp, FunctionalOp2D, Node, UnOp, Var, children, subtrees


class Invariance(StrEnum):
    TRANSLATION = "translation"
    CAUSAL = "causal_translation"
    PERMUTATION = "permutation"
    CYCLIC = "cyclic"
    LOG = "log_translation"
    ROTATION = "rotation"
    GRAPH = "graph"
    NONE = "none"


#: Axes along which a convolution makes sense.
CONVOLUTIONAL = {Invariance.TRANSLATION, Invariance.CAUSAL, Invariance.CYCLIC}


@dataclass(frozen=True)
class Axis:
    name: str
    size: int
    invariance: Invariance = Invariance.NONE

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError("an axis has one place at least")


@dataclass(frozen=True)
class TypedVar:
    name: str
    axes: tuple[Axis, ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.size for a in self.axes)


def tag(df: DataFrame, var: TypedVar) -> DataFrame:
    """df with the variable's axes in its column's metadata, where they survive writing and reading."""
    meta = {"axes": [{"name": a.name, "size": a.size, "invariance": str(a.invariance)} for a in var.axes]}
    return df.withColumn(var.name, F.col(f"`{var.name}`").alias(var.name, metadata=meta))


def tagged(df: DataFrame) -> dict[str, TypedVar]:
    return {f.name: TypedVar(f.name, tuple(Axis(a["name"], a["size"], Invariance(a["invariance"])) for a in f.metadata["axes"])) for f in df.schema.fields if "axes" in f.metadata}


def violation(node: Node, env: dict[str, TypedVar]) -> str | None:
    """The first thing that the tree does against an axis's meaning, or None."""

    def axes(n: Node) -> tuple[Axis, ...]:
        if isinstance(n, Var):
            return env[n.name].axes if n.name in env else ()
        if isinstance(n, UnOp) and n.op in REDUCE:
            return ()
        found = [a for a in map(axes, children(n)) if a]
        return max(found, key=len, default=())

    for n in subtrees(node):
        if isinstance(n, Var) and n.name not in env:
            return f"{n.name} has no declared axes"
        if isinstance(n, FunctionalOp):
            for arg in n.args:
                have = axes(arg)
                if have and n.functional.axis is not None and len(have) >= 2:
                    have = (have[AXES.index(n.functional.axis)],)
                if have and len(have) != 1:
                    return f"a one-dimensional measure on {len(have)} axes"
                if have and have[0].invariance not in CONVOLUTIONAL:
                    return f"a measure along {have[0].name}, which is {have[0].invariance}"
        if isinstance(n, FunctionalOp2D):
            have = axes(n.arg)
            if len(have) < 2:
                return "a two-dimensional measure needs two axes"
            bad = [a for a in have[:2] if a.invariance not in CONVOLUTIONAL]
            if bad:
                return f"a measure along {bad[0].name}, which is {bad[0].invariance}"
        shapes = {tuple(a.size for a in s) for s in map(axes, children(n)) if s}
        if len(shapes) > 1:
            return f"operands of different shapes {sorted(shapes)}"
    return None


def mixes_time_and_space(node: Node) -> int:
    """How many two-dimensional measures look back in time and aside at once."""
    return sum(isinstance(n, FunctionalOp2D) and any(a.lag_t and a.lag_x for a in n.measure.points()) for n in subtrees(node))
