"""Trees as Spark plans.

Pointwise nodes become column expressions. A linear measure becomes a window expression over one series' rows; lags of one
argument share one window and so one exchange. Exponential averages and long kernels run over sorted rows, all of a level in one pass. A
series without keys is cut into ranges with a halo of the rows before. Reductions become an aggregate that is joined
back as one row, a stratum for each level of nesting; they are never a window over everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from galena.functions.pointwise import BINARY, REDUCE, UNARY
from galena.operators.measures import Linear, Measure, Measure2D, smoothing
from galena.operators.population import ordered
from galena.operators.streams import Averages, OverlapSave
from galena.operators.tree import BinOp, Const, FunctionalOp, FunctionalOp2D, Node, UnOp, Var, children, key, subtrees, used_features, with_children

#: A kernel of more weights than this runs over the sorted rows by transforms instead of as a sum of lags.
MOST_LAGS = 16


@dataclass(frozen=True)
class Series:
    """Which rows form a series, and their order. For a field: `order` is time, `space` the other axis."""

    order: list[str]
    keys: list[str] = field(default_factory=list)
    space: str | None = None

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)


def pointwise(node: Node) -> Column:
    """A tree without measures and reductions."""
    match node:
        case Var(name):
            return F.col(f"`{name}`").cast("double")
        case Const(value):
            return F.lit(float(value))
        case BinOp(op, a, b):
            return BINARY[op](pointwise(a), pointwise(b))
        case UnOp(op, a) if op in UNARY:
            return UNARY[op](pointwise(a))
    raise ValueError("measures and reductions need columns of their own")


def _measure_column(x: str, mu: Measure, series: Series) -> Column:
    """mu * x over the series' windows; null before the warmup."""
    w, c = series.window(), F.col(f"`{x}`")
    number = F.row_number().over(w)
    kernel = mu.kernel()
    used = np.flatnonzero(kernel)
    if mu.density is not None and mu.density.family == "rectangular" and not mu.atoms:
        n = len(used)
        return F.when(number >= n, F.avg(c).over(w.rowsBetween(-(n - 1), 0)))
    if len(used) <= MOST_LAGS:
        total = F.lit(0.0)
        for k in used.tolist():
            total = total + F.lit(float(kernel[k])) * (F.lag(c, k).over(w) if k else c)
        return total
    raise ValueError("a kernel of so many weights runs over the rows, not in a window")


def is_streamed(mu: Measure) -> bool:
    """Whether a measure runs over sorted rows: an average without end, or a kernel of more than MOST_LAGS weights that is no plain mean."""
    plain = mu.density is not None and mu.density.family == "rectangular" and not mu.atoms
    return mu.is_recursive or not plain and np.count_nonzero(mu.kernel()) > MOST_LAGS


def _with_doubles(df: DataFrame, *names: str) -> types.StructType:
    """df's schema and more columns (add() would change df's own)."""
    return types.StructType([*df.schema.fields, *(types.StructField(n, types.DoubleType()) for n in names)])


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as floats, nulls as NaN."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def streamed(df: DataFrame, jobs: list[tuple[str, str, Measure]], series: Series) -> DataFrame:
    """df with a column `out` for each (x, out, measure), all in one pass over each series' sorted rows.

    Averages are scanned and long kernels convolved by transforms, so a row costs about log K for a kernel of K weights, and a task holds K - 1 values,
    however long its series. Before the warmup a kernel's column is null; a missing value makes an average NaN from there on.
    """
    if not series.keys and (ends := [(x, out, smoothing(dict(mu.density.params)["halflife"])) for x, out, mu in jobs if mu.is_recursive]):
        df = blocked_averages(df, ends, series)
        jobs = [j for j in jobs if not j[2].is_recursive]
    if not jobs:
        return df
    row = "__row"
    schema = _with_doubles(df, *[out for _, out, _ in jobs])

    def run(batches):
        states = [Averages(smoothing(dict(mu.density.params)["halflife"])) if mu.is_recursive else OverlapSave(mu.kernel()[: mu.warmup + 1]) for _, _, mu in jobs]
        for batch in batches:
            n = batch.column(row).to_numpy()
            made = []
            for (x, _, mu), state in zip(jobs, states, strict=True):
                values = _values(batch, x)
                made.append(pa.array(state.push(values, n == 1)) if mu.is_recursive else pa.array(state.push(values), mask=n <= mu.warmup))
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != row]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)

    # the window deals and sorts the rows; its number says where a series begins
    return df.withColumn(row, F.row_number().over(series.window())).mapInArrow(run, schema)


def in_ranges(df: DataFrame, series: Series, before: int, blocks: int | None = None) -> tuple[DataFrame, Series, str]:
    """df of one series in ranges of its order, each with the `before` rows that precede it: (rows, a series of ranges, name of a flag of the range's own rows).

    The ranges are fixed first; a range gets the last rows of as many earlier ranges as it takes.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = series.order[0]
    place = (F.col(f"`{first}`").cast("timestamp") if dict(df.dtypes)[first] == "timestamp_ntz" else F.col(f"`{first}`")).cast("double")
    bounds = sorted(set(df.select(place.alias("p")).approxQuantile("p", [i / blocks for i in range(1, blocks)], 0.001))) if blocks > 1 else []
    own = (F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= place)) if bounds else F.lit(0)).cast("int")
    dealt = df.withColumn("__block", own)
    counts = dict(tuple(r) for r in dealt.groupBy("__block").count().collect())  # one number a range
    targets: dict[int, list[int]] = {b: [] for b in counts}
    order = sorted(counts)
    for at, b in enumerate(order):
        short = before
        for earlier in reversed(order[:at]):
            if short <= 0:
                break
            targets[earlier].append(b)
            short -= counts[earlier]
    rows = [(b, t, before - sum(counts[k] for k in order if b < k < t)) for b in order for t in targets[b]]
    lists = spark.createDataFrame(rows, "__block int, __to int, __many int")
    back = Window.partitionBy("__block").orderBy(*[F.col(f"`{c}`").desc() for c in series.order])
    tails = dealt.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= before).join(F.broadcast(lists), "__block").where(F.col("__back") <= F.col("__many"))
    tails = tails.drop("__block", "__back", "__many").withColumnRenamed("__to", "__block").withColumn("__own", F.lit(False))
    return dealt.withColumn("__own", F.lit(True)).unionByName(tails), Series(series.order, ["__block"]), "__own"


def blocked_ema(df: DataFrame, x: str, out: str, a: float, series: Series, blocks: int | None = None) -> DataFrame:
    """One average of blocked_averages."""
    return blocked_averages(df, [(x, out, a)], series, blocks)


def blocked_averages(df: DataFrame, jobs: list[tuple[str, str, float]], series: Series, blocks: int | None = None) -> DataFrame:
    """df with an exponential average `out` of each (x, out, a) along one series of any length, in ranges of its order's first column (a number or a time).

    A block of n rows turns what it is handed into y * (1 - a)**n + b, so a first pass gathers n and b of each block (a few numbers), the
    driver folds them from left to right, and a second pass starts every block from its own hand-over. The ranges are
    fixed before either pass, so both see the same blocks, also after a lost executor.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.col(f"`{series.order[0]}`")
    place = (place.cast("timestamp") if dict(df.dtypes)[series.order[0]] == "timestamp_ntz" else place).cast("double")
    bounds = sorted(set(df.select(place.alias("p")).approxQuantile("p", [i / blocks for i in range(1, blocks)], 0.001))) if blocks > 1 else []
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= place)) if bounds else F.lit(0)
    dealt = df.withColumn("__block", block.cast("int")).repartition(blocks, "__block").sortWithinPartitions("__block", *series.order)
    xs = [x for x, _, _ in jobs]

    def starts(block: np.ndarray, now: int | None) -> list[int]:
        return np.flatnonzero(np.concatenate([[now is None or block[0] != now], block[1:] != block[:-1]])).tolist()

    def summary(batches):
        states, now, found = [Averages(a) for _, _, a in jobs], None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("__block").to_numpy()
            begin = starts(block, now)
            values = [_values(batch, x) for x in xs]
            made = [s.push(v, np.zeros(len(v), bool), dict.fromkeys(begin, 0.0)) for s, v in zip(states, values, strict=True)]
            edges = sorted({0, *begin, len(block)})
            for low, high in zip(edges, edges[1:], strict=False):
                held = found.setdefault(int(block[low]), [0, [], [float(v[low]) for v in values]])
                held[0], held[1] = held[0] + high - low, [float(y[high - 1]) for y in made]
            now = block[-1]
        rows = [*found.items()]
        columns = [pa.array([b for b, _ in rows], pa.int32()), pa.array([v[0] for _, v in rows], pa.int64()), *(pa.array([v[k] for _, v in rows], pa.list_(pa.float64())) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "n", "added", "first"])

    parts = sorted(tuple(r) for r in dealt.select("__block", *dict.fromkeys(xs)).mapInArrow(summary, "block int, n long, added array<double>, first array<double>").collect())
    start: dict[int, list[float]] = {}
    held: list[float] | None = None
    for b, n, added, first in parts:
        held = first if held is None else held  # the series begins at its own first value
        start[b] = held
        held = [h * (1 - a) ** n + v for h, v, (_, _, a) in zip(held, added, jobs, strict=True)]
    schema = _with_doubles(df, *[out for _, out, _ in jobs])

    def run(batches):
        states, now = [Averages(a) for _, _, a in jobs], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("__block").to_numpy()
            begin = starts(block, now)
            made = [pa.array(s.push(_values(batch, x), np.zeros(len(block), bool), {i: start[int(block[i])][k] for i in begin})) for k, (s, x) in enumerate(zip(states, xs, strict=True))]
            now = block[-1]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__block"]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)

    return dealt.mapInArrow(run, schema)


def without_averages(df: DataFrame, trees: list[Node], series: Series, fill: float | None = None) -> tuple[DataFrame, list[Node]]:
    """For one series without keys: df with a column for every exponential average, innermost first, and the trees over these columns.

    What is left reaches back a bounded number of rows, so it can run in ranges.
    """

    def split(n: Node) -> Node:
        new = tuple(map(split, children(n)))
        if isinstance(n, FunctionalOp) and any(mu.is_recursive for mu, _ in n.functional.parts()):
            parts = [FunctionalOp(Linear(mu, n.functional.axis), (new[i],)) for mu, i in n.functional.parts()]
            out: Node = parts[0]
            for p in parts[1:]:
                out = BinOp("mul", out, p)
            return out
        return with_children(n, new)

    def is_average(n: Node) -> bool:
        return isinstance(n, FunctionalOp) and n.functional.parts()[0][0].is_recursive

    def put(n: Node) -> Node:
        return named[n] if n in named else with_children(n, tuple(map(put, children(n))))

    trees, count = [split(t) for t in trees], 0
    while inner := list(dict.fromkeys(n for t in trees for n in subtrees(t) if is_average(n) and not any(map(is_average, subtrees(n.args[0]))))):
        args = {n.args[0]: f"__x{count}_{i}" for i, n in enumerate(inner)}
        before, named = df.columns, {n: Var(f"__y{count}_{i}") for i, n in enumerate(inner)}
        df = evaluate(df, {x: n for n, x in args.items()}, series, fill)
        df = blocked_averages(df, [(args[n.args[0]], named[n].name, smoothing(dict(n.functional.parts()[0][0].density.params)["halflife"])) for n in inner], series)
        df = df.select(*[F.col(f"`{c}`") for c in before], *[v.name for v in named.values()])
        trees, count = [put(t) for t in trees], count + 1
    return df, trees


class Compiler:
    """Adds to a frame the columns that trees need, each measure once, and compiles the rest to expressions."""

    def __init__(self, df: DataFrame, series: Series | None = None, fill: float | None = None, own: str | None = None) -> None:
        """own: a flag of the rows that count in reductions; others are there for what reaches back to them."""
        self.df, self.series, self.fill, self.own = df, series, fill, own
        self.made: dict[str, str] = {}

    def column(self, node: Node) -> Column:
        return pointwise(self._flat(node))

    def flat(self, node: Node) -> Node:
        """The tree as a pointwise one over the frame's columns, which gain those of its measures and reductions."""
        return self._flat(node)

    def _flat(self, node: Node) -> Node:
        """The tree with every measure and reduction replaced by a column of the frame."""
        match node:
            case Var(name):
                if name not in self.df.columns:
                    raise KeyError(f"no column {name!r} among {self.df.columns}")
                return node
            case Const():
                return node
            case FunctionalOp(f, args):
                out: Node | None = None
                for mu, i in f.parts():
                    part = Var(self._measure(mu, args[i], f.axis))
                    out = part if out is None else BinOp("mul", out, part)
                return out
            case FunctionalOp2D(m, arg):
                return Var(self._measure_2d(m, arg))
            case UnOp(op, a) if op in REDUCE:
                return Var(self._reduce(op, a))
        return with_children(node, tuple(self._flat(c) for c in children(node)))

    def _named(self, node: Node) -> str:
        """A column with the values of a subtree."""
        flat = self._flat(node)
        if isinstance(flat, Var):
            return flat.name
        name = self._new(key(flat))
        self.df = self.df.withColumn(name, pointwise(flat))
        return name

    def _new(self, what: str) -> str:
        name = f"__m{len(self.made)}"
        self.made[what] = name
        return name

    def _along(self, axis: str | None) -> Series:
        """The series that a measure runs along: of a field, all rows of one place in time, or of one time in space."""
        s = self.series
        if s is None:
            raise ValueError("a measure needs a series")
        if s.space is None:
            if axis == "space":
                raise ValueError("a series has no axis of space")
            return s
        if axis is None:
            raise ValueError("a one-dimensional measure over a field needs an axis")
        return Series(s.order, [*s.keys, s.space]) if axis == "time" else Series([s.space], [*s.keys, *s.order])

    def _measure(self, mu: Measure, arg: Node, axis: str | None = None) -> str:
        series = self._along(axis)
        what = f"{mu!r} {axis} {key(arg)}"
        if what not in self.made:
            if is_streamed(mu):
                self._stream([(mu, arg, axis)])
            else:
                x = self._named(arg)
                name = self._new(what)
                self.df = self._filled(self.df.withColumn(name, _measure_column(x, mu, series)), name)
        return self.made[what]

    def _filled(self, df: DataFrame, name: str) -> DataFrame:
        return df if self.fill is None else df.withColumn(name, F.coalesce(name, F.lit(float(self.fill))))

    def _stream(self, wanted: list[tuple[Measure, Node, str | None]]) -> None:
        """All these measures in one pass over the rows, one for each axis that they run along."""
        for axis in dict.fromkeys(w[2] for w in wanted):
            new = {f"{mu!r} {axis} {key(arg)}": (mu, arg) for mu, arg, a in wanted if a == axis}
            xs = {what: self._named(arg) for what, (_, arg) in new.items() if what not in self.made}
            jobs = [(x, self._new(what), new[what][0]) for what, x in xs.items()]
            self.df = streamed(self.df, jobs, self._along(axis))
            for _, name, mu in jobs:
                if not mu.is_recursive:
                    self.df = self._filled(self.df, name)

    def _measure_2d(self, m: Measure2D, arg: Node) -> str:
        if self.series is None or self.series.space is None:
            raise ValueError("a two-dimensional measure needs a field")
        what = f"{m!r} {key(arg)}"
        if what not in self.made:
            x = self._named(arg)
            name = self._new(what)
            self.df = field_measure(self.df, x, name, m, self.series)
            if self.fill is not None:
                self.df = self.df.withColumn(name, F.coalesce(name, F.lit(float(self.fill))))
        return self.made[what]

    def prepare(self, trees: list[Node]) -> None:
        """What needs a pass over the rows, by levels of nesting: all averages and long kernels of a level in one pass, then all its reductions in one aggregate."""
        streams: dict[int, list[tuple[Measure, Node, str | None]]] = {}
        reductions: dict[int, dict[str, tuple[str, Node]]] = {}

        def level(n: Node) -> int:
            inner = max((level(c) for c in children(n)), default=0)
            if isinstance(n, UnOp) and n.op in REDUCE:
                reductions.setdefault(inner, {})[f"{n.op} {key(n.a)}"] = (n.op, n.a)
                return inner + 1
            if isinstance(n, FunctionalOp) and self.series is not None and (long := [(mu, n.args[i], n.functional.axis) for mu, i in n.functional.parts() if is_streamed(mu)]):
                streams.setdefault(inner, []).extend(long)
                return inner + 1
            return inner

        for t in trees:
            level(t)
        for k in sorted({*streams, *reductions}):
            if k in streams:
                self._stream(streams[k])
            new = {what: (op, self._named(arg)) for what, (op, arg) in reductions.get(k, {}).items() if what not in self.made}
            if new:
                named = {what: self._new(what) for what in new}
                counted = self.df if self.own is None else self.df.where(F.col(self.own))
                one = counted.agg(*[REDUCE[op](F.col(x)).alias(named[what]) for what, (op, x) in new.items()])  # one row
                self.df = self.df.join(F.broadcast(one))

    def _reduce(self, op: str, arg: Node) -> str:
        what = f"{op} {key(arg)}"
        if what not in self.made:
            self.prepare([UnOp(op, arg)])
        return self.made[what]


def field_measure(df: DataFrame, x: str, out: str, m: Measure2D, series: Series) -> DataFrame:
    """A stencil over a long field (time, space, value): first neighbours along space in each row of the field, then rows back in time.

    Two windows in all: all spatial shifts share one, all shifts in time the other. A point that lacks a neighbour gets null.
    """
    over_x = Window.partitionBy(*series.keys, *series.order).orderBy(series.space)
    over_t = Window.partitionBy(*series.keys, series.space).orderBy(*series.order)
    c, by_lag = F.col(f"`{x}`"), {}
    for a in m.points():
        by_lag.setdefault(a.lag_t, {}).setdefault(a.lag_x, 0.0)
        by_lag[a.lag_t][a.lag_x] += a.weight
    side = m.max_abs_lag_x
    row_sums = {}
    for lag_t, weights in by_lag.items():
        total = F.lit(0.0)
        for lag_x, w in sorted(weights.items()):
            shifted = F.lag(c, lag_x).over(over_x) if lag_x > 0 else F.lead(c, -lag_x).over(over_x) if lag_x < 0 else c
            total = total + F.lit(w) * shifted
        row_sums[f"{out}_{lag_t}"] = total
    inner = F.lag(F.lit(1), side).over(over_x).isNotNull() & F.lead(F.lit(1), side).over(over_x).isNotNull() if side else F.lit(True)
    df = df.withColumns({**row_sums, f"{out}_in": inner})
    total = F.lit(0.0)
    for lag_t in by_lag:
        part = F.col(f"{out}_{lag_t}")
        total = total + (F.lag(part, lag_t).over(over_t) if lag_t else part)
    enough = F.row_number().over(over_t) > m.max_lag_t
    return df.withColumn(out, F.when(enough & F.col(f"{out}_in"), total)).drop(*row_sums, f"{out}_in")


def dense_measure(df: DataFrame, x: str, out: str, m: Measure2D, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The same over a dense field: one row for each time, x an array over space; no shuffle beyond that of the series."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    c, width, side = F.col(f"`{x}`"), F.size(F.col(f"`{x}`")), m.max_abs_lag_x
    lags = sorted({a.lag_t for a in m.points()})
    held = {t: f"{out}_{t}" for t in lags}
    df = df.withColumns({held[t]: F.lag(c, t).over(w) if t else c for t in lags})
    number = F.row_number().over(w)

    def at(i: Column) -> Column:
        total = F.lit(0.0)
        for a in m.points():
            total = total + F.lit(a.weight) * F.get(F.col(held[a.lag_t]), i - a.lag_x)
        return F.when((i >= side) & (i < width - side), total)

    return df.withColumn("__enough", number > m.max_lag_t).withColumn(out, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(F.col("__enough"), at(i)))).drop("__enough", *held.values())


def evaluate(df: DataFrame, trees: dict[str, Node], series: Series | None = None, fill: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with a column for each named tree. Only columns that the trees read reach the scan."""
    missing = set().union(*(used_features(t) for t in trees.values())) - set(df.columns)
    if missing:
        raise KeyError(f"no columns {sorted(missing)}")
    kept = df.columns if keep is None else keep
    c, columns = compiled(df, list(trees.values()), series, fill)
    return (c.df if c.own is None else c.df.where(c.own)).select(*[F.col(f"`{k}`") for k in kept], *[pointwise(t).alias(name) for name, t in zip(trees, columns, strict=True)])


def compiled(df: DataFrame, trees: list[Node], series: Series | None = None, fill: float | None = None) -> tuple[Compiler, list[Node]]:
    """A compiler whose frame has a column for every measure and reduction of the trees, and the trees as pointwise ones over that frame.

    One series without keys runs in ranges, whatever the trees hold: averages become columns first, the rest reaches back a bounded number of
    rows, and reductions count each row where it belongs.
    """
    own = None
    if series is not None and not series.keys and series.space is None:
        df, trees = without_averages(df, trees, series, fill)
        if before := halo(trees):
            df, series, own = in_ranges(df, series, before)
    c = Compiler(df, series, fill, own)
    c.prepare(trees)
    return c, [c.flat(t) for t in trees]


def halo(trees: list[Node]) -> int:
    """The rows before a row that its values can depend on, 0 if none or if an exponential average reaches back without end."""

    def reach(n: Node) -> float:
        inner = max((reach(c) for c in children(n)), default=0)
        if isinstance(n, FunctionalOp):
            return inner + max(float("inf") if mu.is_recursive else mu.warmup for mu, _ in n.functional.parts())
        return inner

    most = max((reach(t) for t in trees), default=0)
    return 0 if most == float("inf") else int(most)


def in_layers(df: DataFrame, trees: list[Node], keep: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with a column for every different operator node of pointwise trees, a projection for each height, and the trees' columns.

    Protected operators name their operands several times, so a deep tree as one expression would grow with a power of its depth;
    in layers each node is computed once, and once for all trees that share it.
    """
    names: dict[Node, str] = {}
    heights: dict[int, list[Node]] = {}

    def height(n: Node) -> int:
        return 0 if isinstance(n, Var | Const) else 1 + max(height(c) for c in children(n))

    for t in trees:
        for n in subtrees(t):
            if not isinstance(n, Var | Const) and n not in names:
                names[n] = f"__n{len(names)}"
                heights.setdefault(height(n), []).append(n)

    def leaf(n: Node) -> Column:
        return F.col(names[n]) if n in names else pointwise(n)

    for h in sorted(heights):
        made = {}
        for n in heights[h]:
            args = [leaf(c) for c in children(n)]
            made[names[n]] = BINARY[n.op](*args) if isinstance(n, BinOp) else UNARY[n.op](*args)
        df = df.withColumns(made)
    return df.select(*keep, *names.values()), [leaf(t) for t in trees]


def shared_measures(trees: list[Node]) -> list[Node]:
    """Measure nodes that two trees or more hold, in canonical order: what a population's plan computes once."""
    seen: dict[Node, int] = {}
    for t in trees:
        for n in set(subtrees(ordered(t))):
            if isinstance(n, FunctionalOp | FunctionalOp2D):
                seen[n] = seen.get(n, 0) + 1
    return [n for n, count in seen.items() if count > 1]


def is_measure(node: Node) -> bool:
    return isinstance(node, FunctionalOp | FunctionalOp2D)


class MeasureCache:
    """Measure columns kept between batches of trees over one table, persisted, at most `most` of them (the least lately used go first).

    cacheable says which nodes become columns; a node is kept once `threshold` trees of a batch hold it, or a batch before did.
    hits and misses count nodes asked for. The frame is that of the last rewrite; close() gives its memory back.
    """

    def __init__(self, df: DataFrame, series: Series | None = None, fill: float | None = 0.0, threshold: int = 1, most: int = 64, cacheable: Callable[[Node], bool] = is_measure) -> None:
        self.base, self.df, self.series, self.fill, self.threshold, self.most, self.cacheable = df, df, series, fill, threshold, most, cacheable
        self.held: dict[Node, str] = {}
        self.hits = self.misses = self.made = 0

    def rewrite(self, trees: list[Node]) -> tuple[DataFrame, list[Node]]:
        """The table with the columns, and the trees with variables in place of what is kept (the outermost such node of a branch).

        Nodes are compared in canonical order, so operands of commutative operators may stand either way.
        """
        asked: dict[Node, int] = {}
        trees = [ordered(t) for t in trees]

        def outermost(n: Node) -> set[Node]:
            return {n} if self.cacheable(n) else set().union(*map(outermost, children(n)))

        for t in trees:
            for n in outermost(t):
                asked[n] = asked.get(n, 0) + 1
        new = [n for n, count in asked.items() if n not in self.held and count >= self.threshold][: self.most]
        self.hits += sum(n in self.held for n in asked)
        self.misses += sum(n not in self.held for n in asked)
        for n in [n for n in asked if n in self.held]:
            self.held[n] = self.held.pop(n)  # used last
        if new:
            for n in new:
                self.held[n] = f"__kept{self.made}"
                self.made += 1
            self.held = dict(list(self.held.items())[-self.most :])
            old = [v for n, v in self.held.items() if n not in new]
            before = self.df
            self.df = evaluate(before, {self.held[n]: n for n in new if n in self.held}, self.series, self.fill, [*self.base.columns, *old]).persist()
            self.df.count()
            if before is not self.base:
                before.unpersist()

        def put(n: Node) -> Node:
            return Var(self.held[n]) if n in self.held else with_children(n, tuple(map(put, children(n))))

        return self.df, [put(t) for t in trees]

    def close(self) -> None:
        if self.df is not self.base:
            self.df.unpersist()
        self.df, self.held = self.base, {}
