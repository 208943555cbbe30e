"""Queries of trees, rewriting, bounds, detectors, searches and small systems, each held against SQL that says the same another way."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions.pointwise import REDUCE
from galena.operators import measures as M
from galena.operators.lowering import Series, evaluate
from galena.operators.tree import BinOp, Const, Node, UnOp, Var, children, complexity, subtrees
from galena.plans.registry import BINARY_SQL, EVENTS, UNARY_SQL, W, _lag, _series, linear, query
from galena.sources.tables import table

COLUMNS = {"q": "l_quantity / 50", "d": "l_discount * 10 - 0.3", "x": "l_tax * 25 + 0.2"}
BASE = f"SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in COLUMNS.items())} FROM lineitem"


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of lineitem on which operators behave."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in COLUMNS.items()])


def in_sql(trees: dict[str, Node], base: str) -> str:
    """`base` with a column for each pointwise tree: a nested query for each height, so that each node is written once."""
    names: dict[Node, str] = {}
    heights: dict[int, list[Node]] = {}

    def height(n: Node) -> int:
        return 0 if isinstance(n, Var | Const) else 1 + max(map(height, children(n)))

    for t in trees.values():
        for n in subtrees(t):
            if not isinstance(n, Var | Const) and n not in names:
                names[n] = f"n{len(names)}"
                heights.setdefault(height(n), []).append(n)

    def text(n: Node) -> str:
        return names[n] if n in names else n.name if isinstance(n, Var) else f"CAST({n.value!r} AS DOUBLE)"

    for h in sorted(heights):
        made = []
        for n in heights[h]:
            args = dict(zip("ab", map(text, children(n)), strict=False))
            inner = ", ".join(f"{v} AS {k}" for k, v in args.items())
            made.append(f"(SELECT {(BINARY_SQL if isinstance(n, BinOp) else UNARY_SQL)[n.op]} FROM (SELECT {inner})) AS {names[n]}")
        base = f"SELECT *, {', '.join(made)} FROM ({base})"
    return f"SELECT *, {', '.join(f'{text(t)} AS {k}' for k, t in trees.items())} FROM ({base})"


def _means(df: DataFrame, names: list[str]) -> DataFrame:
    """(tree, mean, top) of the columns' tanh."""
    one = df.agg(*[F.round(F.avg(F.tanh(n)), 7).alias(f"{n}_m") for n in names], *[F.round(F.max(F.tanh(n)), 7).alias(f"{n}_t") for n in names])
    return one.selectExpr(f"stack({len(names)}, {', '.join(f"'{n}', {n}_m + 0, {n}_t + 0" for n in names)}) as (tree, mean, top)")


def _means_sql(inner: str, names: list[str]) -> str:
    return f"WITH v AS ({inner}) " + " UNION ALL ".join(f"SELECT '{n}' AS tree, round(avg(tanh({n})), 7) + 0 AS mean, round(max(tanh({n})), 7) + 0 AS top FROM v" for n in names)


# --- rewriting: the rewritten trees' values equal those of the trees as written

Q, D, X = Var("q"), Var("d"), Var("x")
ADD, SUB, MUL, DIV = (lambda a, b, op=op: BinOp(op, a, b) for op in ("add", "sub", "mul", "div"))
REWRITTEN: dict[str, Node] = {
    "zero": ADD(MUL(Q, Const(0.0)), D), "one": MUL(ADD(Q, D), Const(1.0)), "same": SUB(ADD(Q, D), D), "fold": ADD(MUL(Const(2.0), Const(3.0)), Q), "twice": UnOp("neg", UnOp("neg", SUB(Q, X))),
    "terms": ADD(ADD(MUL(Const(2.0), Q), MUL(Const(3.0), Q)), SUB(D, Q)), "chain": ADD(ADD(Q, Const(1.0)), ADD(D, Const(2.0))), "commuted": ADD(MUL(X, Q), MUL(Q, X)), "abs": UnOp("abs", UnOp("abs", D)), "power": BinOp("pow", UnOp("abs", D), Const(1.0)),
    "square": MUL(SUB(Q, D), SUB(Q, D)), "quotient": DIV(MUL(Q, Const(4.0)), Const(2.0)), "least": BinOp("min", Q, Q),
}


def _rewriter(name: str, sql_names: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from galena.operators import simplify as S

        change = {"simplify": S.simplify, "fold": S.fold, "in_order": S.in_order, "like_terms": S.like_terms, "canonical": S.canonical}[name]
        made = {k: change(t, False) if name in ("simplify", "fold", "canonical") else change(t) for k, t in REWRITTEN.items()}
        out = _means(evaluate(rows_of(spark, sf_dir), made, keep=[]), list(made))
        shorter = F.create_map(*[v for k, t in REWRITTEN.items() for v in (F.lit(k), F.lit(complexity(made[k]) <= complexity(t)))])
        return out.withColumn("no_longer", shorter[F.col("tree")])

    return run


for _name in ("simplify", "fold", "in_order", "like_terms", "canonical"):
    query(f"rewrite_{_name}", f"SELECT *, true AS no_longer FROM ({_means_sql(in_sql(REWRITTEN, BASE), list(REWRITTEN))})")(_rewriter(_name, list(REWRITTEN)))


#: Trees whose short forms need several rules in turn.
LONG: dict[str, Node] = {
    "factored": ADD(ADD(MUL(Q, D), MUL(Q, X)), MUL(D, X)), "cancelled": SUB(MUL(Q, ADD(X, Const(1.0))), MUL(X, Q)), "halves": MUL(MUL(Q, Const(2.0)), MUL(X, Const(0.5))), "circle": ADD(MUL(UnOp("sin", Q), UnOp("sin", Q)), ADD(X, MUL(UnOp("cos", Q), UnOp("cos", Q)))),
    "root": UnOp("sqrt", MUL(ADD(Q, D), ADD(D, Q))), "ends": SUB(ADD(BinOp("min", Q, X), BinOp("max", X, Q)), X), "signs": UnOp("cos", UnOp("neg", SUB(Q, D))), "steps": DIV(DIV(MUL(Const(6.0), Q), Const(3.0)), Const(2.0)), "sums": ADD(ADD(ADD(Q, D), X), SUB(Const(0.0), ADD(D, X))),
    "centred": SUB(ADD(Q, UnOp("reduce_mean", ADD(MUL(Const(2.0), D), MUL(Const(3.0), D)))), Q),
}
_SHORT = {"factored": 9, "cancelled": 1, "halves": 3, "circle": 3, "root": 4, "ends": 1, "signs": 4, "steps": 1, "sums": 1, "centred": 4}


def _long_sql() -> str:
    inner = f"SELECT *, (SELECT avg(5 * d) FROM ({BASE})) AS m FROM ({BASE})"
    return _means_sql(in_sql({k: t if k != "centred" else Var("m") for k, t in LONG.items()}, inner), list(LONG))


@query("rewrite_shorten", f"SELECT s.*, n.nodes FROM ({_long_sql()}) s JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in _SHORT.items())}) n(tree, nodes) USING (tree)")
def _shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees made as short as classes of equal forms allow: values as before, and how many nodes are left."""
    from galena.operators.egraph import shorten

    made = {k: shorten(t) for k, t in LONG.items()}
    out = _means(evaluate(rows_of(spark, sf_dir), made, keep=[]), list(made))
    sizes = F.create_map(*[v for k, t in made.items() for v in (F.lit(k), F.lit(complexity(t)))])
    return out.withColumn("nodes", sizes[F.col("tree")])


_FRONT = {"f0": ADD(Q, SUB(D, D)), "f1": ADD(MUL(Q, X), MUL(MUL(Const(2.0), X), Q)), "f2": ADD(MUL(Const(2.0), MUL(Q, X)), ADD(MUL(Q, X), MUL(D, MUL(Q, Const(0.5)))))}
_FRONT_SQL = f"WITH v AS ({in_sql(_FRONT, BASE)}) " + " UNION ALL ".join(f"SELECT '{t}' AS tree, {n} AS complexity, round(avg(power({k} - (3 * q * x + 0.5 * d * q + 0.01 * d), 2)), 8) AS loss FROM v" for k, t, n in (("f0", "q", 1), ("f1", "mul(mul(3, q), x)", 5)))


@query("front_shortened", _FRONT_SQL + " UNION ALL SELECT 'the rest', 9, round(avg(power(f2 - (3 * q * x + 0.5 * d * q + 0.01 * d), 2)), 8) FROM v")
def _short_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A front scored over all rows, each member shortened and scored again; SQL scores the members as they were."""
    from galena.operators.egraph import shorten_front
    from galena.operators.scoring import Candidate, losses_by_data
    from galena.operators.simplify import in_order

    rows = rows_of(spark, sf_dir).withColumn("y", F.expr("3 * q * x + 0.5 * d * q + 0.01 * d"))
    before = [Candidate(t, v, complexity(t), v) for t, v in zip(_FRONT.values(), losses_by_data(rows, list(_FRONT.values()), "y"), strict=True)]
    front = shorten_front(before)
    losses = losses_by_data(rows, [c.tree for c in front], "y")
    found = [(str(in_order(c.tree)) if c.complexity < 6 else "the rest", c.complexity, round(v, 8) + 0.0) for c, v in zip(front, losses, strict=True)]
    return spark.createDataFrame(found, "tree string, complexity int, loss double")


_KNOWN = {"zero": ("d", D), "one": ("q + d", ADD(Q, D)), "fold": ("6 + q", ADD(Const(6.0), Q)), "twice": ("q - x", SUB(Q, X))}


@query("rewrite_known", f"SELECT m.*, n.same_as FROM ({_means_sql(in_sql({k: t for k, (_, t) in _KNOWN.items()}, BASE), list(_KNOWN))}) m JOIN (VALUES {', '.join(f"('{k}', '{name}')" for k, (name, _) in _KNOWN.items())}) n(tree, same_as) USING (tree)")
def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriting finds the short form: equal, as canonical trees, to the one named; and what it has for values over all rows."""
    from galena.operators.simplify import canonical, simplify

    made = {k: simplify(REWRITTEN[k]) for k in _KNOWN}
    names = {k: next((name for name, t in _KNOWN.values() if canonical(made[k]) == canonical(t)), None) for k in made}
    out = _means(evaluate(rows_of(spark, sf_dir), made, keep=[]), list(made))
    return out.withColumn("same_as", F.create_map(*[F.lit(v) for k in names for v in (k, names[k])])[F.col("tree")])


# --- random trees: drawn, mutated, crossed, sent as tapes; values and losses as SQL has them


def _drawn(kind: str, n: int = 12) -> dict[str, Node]:
    from galena.operators import search, tree

    grammar, rng, out = search.Grammar(["q", "d", "x"], measures_1d=False), random.Random(f"{kind} of trees"), {}
    while len(out) < n:
        t = grammar.tree(rng)
        if kind == "mutants":
            t = search.mutate(t, grammar, rng)
        elif kind == "crossed":
            t = search.crossover(t, grammar.tree(rng), rng)
        elif kind == "jittered":
            t = search.jitter(t, grammar, rng)
        elif kind == "inserted":
            t = search.insert_term(t, grammar, rng)
        elif kind == "deleted":
            t = search.delete_term(t, grammar, rng)
        elif kind == "swapped":
            t = search.swap_operator(t, grammar, rng)
        elif kind == "replaced":
            t = tree.replace_at(t, rng.randrange(len(list(subtrees(t)))), Var("x"))
        if any(isinstance(m, UnOp) and m.op in REDUCE for m in subtrees(t)) or not 3 <= complexity(t) <= 24 or t in out.values():
            continue
        # steps at places that only rounding decides would make two right engines differ
        if any(isinstance(m, BinOp | UnOp) and m.op in ("gt", "lt", "ge", "le", "sign", "step", "div", "log", "pow", "atan2", "acos", "asin") for m in subtrees(t)):
            continue
        out[f"t{len(out)}"] = t
    return out


KINDS = ("random", "mutants", "crossed", "jittered", "inserted", "deleted", "swapped", "replaced")
for _kind in KINDS:

    def _values(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        trees = _drawn(kind)
        return _means(evaluate(rows_of(spark, sf_dir), trees, keep=[]), list(trees))

    _trees = _drawn(_kind)
    query(f"trees_{_kind}", _means_sql(in_sql(_trees, BASE), list(_trees)))(_values)


_DRAWN = _drawn("scored", 8)


@query("losses_by_data", f"WITH v AS ({in_sql(_DRAWN, BASE)}) " + " UNION ALL ".join(f"SELECT '{k}' AS tree, round(avg(power(tanh({k}) - q, 2)), 8) AS loss FROM v" for k in _DRAWN))
def _by_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight trees over all rows in one pass."""
    from galena.operators.scoring import losses_by_data

    trees = [UnOp("tanh", t) for t in _DRAWN.values()]
    found = losses_by_data(rows_of(spark, sf_dir), trees, "q")
    return spark.createDataFrame([(k, round(v, 8)) for k, v in zip(_DRAWN, found, strict=True)], "tree string, loss double")


@query("losses_of_measures", f"WITH s AS (SELECT lead(value) OVER w AS y, value, value - {_lag(1)} AS d, {_lag(3)} AS l FROM events WINDOW w AS {W}) SELECT 'a' AS tree, round(avg(power(value + coalesce(d, 0) - y, 2)), 4) AS loss FROM s UNION ALL SELECT 'b', round(avg(power(0.5 * coalesce(d, 0) + coalesce(l, 0) - y, 2)), 4) FROM s UNION ALL SELECT 'c', round(avg(power(value - (SELECT avg(value) FROM events) - y, 2)), 4) FROM s")
def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with measures and reductions, scored by data; what the warmup lacks counts as zero."""
    from galena.operators.scoring import losses_by_data

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value").withColumn("y", F.lead("value").over(EVENTS.window()))
    v, d = Var("value"), linear(M.diff(1))
    trees = {"a": ADD(v, d), "b": ADD(MUL(Const(0.5), d), linear(M.lag(3))), "c": SUB(v, UnOp("reduce_mean", v))}
    found = losses_by_data(rows, list(trees.values()), "y", EVENTS)
    return spark.createDataFrame([(k, round(x, 4)) for k, x in zip(trees, found, strict=True)], "tree string, loss double")


_LINES = "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_discount) AS n, 1 - l_discount AS rest FROM lineitem"


@query(
    "tree_structure",
    f"SELECT l_orderkey, CAST(6 * count(*) - 1 AS INTEGER) AS complexity, CAST(count(*) + 2 AS INTEGER) AS height, CAST(3 * count(*) AS INTEGER) AS constants, CAST(6 * count(*) - 1 AS INTEGER) AS subtrees, round(sum(v), 4) AS total, round(sum(CASE WHEN n > 1 THEN v ELSE 0 END), 4) + 0.0 AS without_first,"
    f" round(sum(rest), 6) AS ones FROM ({_LINES}) GROUP BY l_orderkey",
)
def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's total as a formula of its lines: size, height and constants of the tree, its value, its value with the least line replaced by zero, and with all prices set to one."""
    from galena.operators import tree as T

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_discount"))).alias("lines"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, rows in zip(pdf["l_orderkey"], pdf["lines"], strict=True):
                terms = [MUL(Const(float(r["l_extendedprice"])), SUB(Const(1.0), Const(float(r["l_discount"])))) for r in rows]
                whole = terms[0]
                for t in terms[1:]:
                    whole = ADD(whole, t)
                # the first term stands below all sums
                less = T.replace_at(whole, len(terms) - 1, Const(0.0))
                ones = T.with_constants(whole, [1.0 if i % 3 == 0 else c for i, c in enumerate(T.constants(whole))])
                values = [round(float(T.evaluate(t, {})), k) + 0.0 for t, k in ((whole, 4), (less, 4), (ones, 6))]
                out.append((key, complexity(whole), T.depth(whole), len(T.constants(whole)), sum(1 for _ in subtrees(whole)), *values))
            yield pd.DataFrame(out, columns=["l_orderkey", "complexity", "height", "constants", "subtrees", "total", "without_first", "ones"])

    return lines.mapInPandas(run, "l_orderkey long, complexity int, height int, constants int, subtrees int, total double, without_first double, ones double")


# --- series and reductions

_W1 = "(ORDER BY ts, event_id)"


@query("measure_one_series", f"SELECT event_id, round(lag(value, 3) OVER w, 6) + 0.0 AS l3, round(value - lag(value, 1) OVER w, 6) + 0.0 AS d1, round(CASE WHEN row_number() OVER w >= 5 THEN avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) + 0.0 AS r5 FROM events WINDOW w AS {_W1}")
def _one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one series: ranges, each with the rows before that it needs."""
    trees = {"l3": linear(M.lag(3)), "d1": linear(M.diff(1)), "r5": linear(M.roll_mean(5))}
    made = evaluate(table(spark, sf_dir, "events").select("event_id", "ts", "value"), trees, Series(["ts", "event_id"]), keep=["event_id"])
    return made.select("event_id", *[(F.round(n, 6) + 0.0).alias(n) for n in trees])


@query("reduce_many", "WITH r AS (SELECT avg(q) AS a, max(q) AS b, sum(d) AS c, stddev_pop(x) AS e FROM v) SELECT l_orderkey, l_linenumber, round(q - a + d * b + c / 1000 + x / e, 6) AS v FROM v, r".replace("WITH r", f"WITH v AS ({BASE}), r"))
def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reductions from one aggregate."""
    tree = ADD(ADD(SUB(Q, UnOp("reduce_mean", Q)), MUL(D, UnOp("reduce_max", Q))), ADD(DIV(UnOp("reduce_sum", D), Const(1000.0)), DIV(X, UnOp("reduce_std", X))))
    return evaluate(rows_of(spark, sf_dir), {"v": tree}, keep=["l_orderkey", "l_linenumber"]).withColumn("v", F.round("v", 6))


_LONG = "1 / pow(1 + (a.n - b.n) / 24.0, 1.5)"
query(
    "measure_long_kernel",
    f"WITH o AS (SELECT event_id, user_id, value, row_number() OVER {W} AS n FROM events), k AS (SELECT sum(1 / pow(1 + k / 24.0, 1.5)) AS s FROM range(101) t(k)) SELECT a.event_id, CASE WHEN any_value(a.n) > 100 THEN round(sum(b.value * {_LONG}) / any_value(k.s), 6) + 0.0 END AS v FROM o a JOIN o b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 100 AND a.n, k GROUP BY a.event_id",
)(_series({"v": linear(M.power_law(24, 1.5, 100))}))


# --- bounds

_ENDS = {"neg": ("-max(q)", "-min(q)"), "abs": ("CASE WHEN min(d) <= 0 AND max(d) >= 0 THEN 0 ELSE min(abs(d)) END", "max(abs(d))"), "tanh": ("tanh(min(d))", "tanh(max(d))"), "sign": ("sign(min(d))", "sign(max(d))"), "step": ("CAST(min(d) > 0 AS INT)", "CAST(max(d) > 0 AS INT)"), "sqrt": ("sqrt(min(q))", "sqrt(max(q))"), "log": ("ln(min(q))", "ln(max(q))"), "exp": ("exp(min(d))", "exp(max(d))"), "acos": ("acos(least(max(d), 1))", "acos(greatest(min(d), -1))"), "asin": ("asin(greatest(min(d), -1))", "asin(least(max(d), 1))"), "reduce_mean": ("min(q)", "max(q)"), "reduce_max": ("min(q)", "max(q)"), "reduce_std": ("0", "max(q) - min(q)")}
_OF = {"neg": Q, "sqrt": Q, "log": Q, "reduce_mean": Q, "reduce_max": Q, "reduce_std": Q}
_PAIRS = {"add": ("min(q) + min(x)", "max(q) + max(x)"), "sub": ("min(q) - max(x)", "max(q) - min(x)"), "mul": ("min(q) * min(x)", "max(q) * max(x)"), "div": ("min(q) / max(x)", "max(q) / min(x)"), "min": ("least(min(q), min(x))", "least(max(q), max(x))"), "max": ("greatest(min(q), min(x))", "greatest(max(q), max(x))")}


@query("bounds_of_operators", f"WITH v AS ({BASE}) " + " UNION ALL ".join(f"SELECT '{k}' AS op, round(CAST({a} AS DOUBLE), 7) + 0.0 AS low, round(CAST({b} AS DOUBLE), 7) + 0.0 AS high FROM v" for k, (a, b) in {**_ENDS, **_PAIRS}.items()))
def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators import intervals

    env = intervals.of_columns(rows_of(spark, sf_dir), ["q", "d", "x"])
    trees = {**{op: UnOp(op, _OF.get(op, D)) for op in _ENDS}, **{op: BinOp(op, Q, X) for op in _PAIRS}}
    found = {k: intervals.evaluate(t, env) for k, t in trees.items()}
    return spark.createDataFrame([(k, round(r.low, 7) + 0.0, round(r.high, 7) + 0.0) for k, r in found.items()], "op string, low double, high double")


# --- detectors: the law that a column was made by


@query("detect_power_law", "SELECT * FROM (VALUES ('scale', 2.5::DOUBLE), ('q', 1.5::DOUBLE), ('x', -2.0::DOUBLE)) t(name, value)")
def _detect_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.regression import power_law

    found = power_law(rows_of(spark, sf_dir).withColumn("y", F.lit(2.5) * F.pow("q", F.lit(1.5)) / (F.col("x") * F.col("x"))), ["q", "x"], "y")
    return spark.createDataFrame([("scale", round(found.scale, 6)), *((k, float(v)) for k, v in found.exponents.items())], "name string, value double")


@query("detect_exp_wrapper", "SELECT * FROM (VALUES ('sign', -1.0::DOUBLE), ('rate', 0.5::DOUBLE), ('q', 2.0::DOUBLE)) t(name, value)")
def _detect_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.regression import exp_wrapper

    found = exp_wrapper(rows_of(spark, sf_dir).withColumn("y", -F.exp(0.5 * F.col("q") * F.col("q"))), ["q"], "y")
    return spark.createDataFrame([("sign", found.sign), ("rate", round(found.inner.scale, 6)), *((k, float(v)) for k, v in found.inner.exponents.items())], "name string, value double")


SEEDED = {"power": "3 * q * q / x", "wrapped": "exp(2 * q / x)", "root": "sqrt(q * x)"}
for _name, _law in SEEDED.items():

    def _seeded(spark: SparkSession, sf_dir: str, law: str = _law) -> DataFrame:
        """A tree from a detector, its values on all rows."""
        from galena.operators.regression import power_law_seed

        rows = rows_of(spark, sf_dir).withColumn("y", F.expr(law))
        return evaluate(rows, {"v": power_law_seed(rows, ["q", "x"], "y")}, keep=["l_orderkey", "l_linenumber"]).withColumn("v", F.round("v", 5))

    query(f"seed_{_name}", f"SELECT l_orderkey, l_linenumber, round({_law}, 5) AS v FROM ({BASE})")(_seeded)


@query("seed_of_transformed", f"SELECT l_orderkey, l_linenumber, round(1 / (2 * q * x), 5) AS v FROM ({BASE})")
def _transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.regression import coordinate_seed

    rows = rows_of(spark, sf_dir).withColumn("y", 1 / (2 * F.col("q") * F.col("x")))
    _, tree, _ = coordinate_seed(rows, ["q", "x"], "y")
    return evaluate(rows, {"v": tree}, keep=["l_orderkey", "l_linenumber"]).withColumn("v", F.round("v", 5))


@query("additive_polynomial", "SELECT * FROM (VALUES ('(0, 1)', -1.0::DOUBLE), ('(2, 1)', 2.0::DOUBLE), ('constant', 0.5::DOUBLE)) t(powers, coefficient)")
def _polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.regression import additive_polynomial

    rows = rows_of(spark, sf_dir)
    found = additive_polynomial(rows.withColumn("y", 2 * F.col("q") * F.col("q") * F.col("x") - F.col("x") + 0.5), ["q", "x"], "y")
    terms = [(str(p), round(c, 6) + 0.0) for c, p in found.terms if abs(c) > 1e-7]
    return spark.createDataFrame([*terms, ("constant", round(found.constant, 6))], "powers string, coefficient double")


@query("stlsq_lorenz", "SELECT rate, term, round(CAST(c AS DOUBLE), 5) AS coefficient FROM (VALUES ('x', '(1, 0, 0)', -10), ('x', '(0, 1, 0)', 10), ('y', '(1, 0, 0)', 28), ('y', '(0, 1, 0)', -1), ('y', '(1, 0, 1)', -1), ('z', '(1, 1, 0)', 1), ('z', '(0, 0, 1)', -8 / 3.0)) t(rate, term, c)")
def _lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.plans.registry import _lorenz as rates

    return rates(spark, sf_dir).select("rate", "term", F.round("coefficient", 5).alias("coefficient"))


@query("constants_refined", "SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 2) AS slope, true AS neat FROM lineitem")
def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slope fitted over all rows by exact derivatives; and a constant near 2 pi snapped to it."""
    from galena.operators.gradients import fit_constants_by_data
    from galena.operators.search import snap_constants
    from galena.operators.tree import constants

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("y"))
    moved, _ = fit_constants_by_data(rows, BinOp("add", MUL(Const(1.0), Q), Const(0.0)), "y")
    snapped, _ = snap_constants(MUL(Const(6.2832), Q), lambda t: (constants(t)[0] - 2 * np.pi) ** 2)
    return spark.createDataFrame([(round(constants(moved)[0], 2), bool(abs(constants(snapped)[0] - 2 * np.pi) < 1e-12))], "slope double, neat boolean")


# --- systems

@query("oscillator", "SELECT s_suppkey, round(s_acctbal / 1000 * cos(2.0) + s_nationkey * sin(2.0), 5) + 0.0 AS x, round(s_nationkey * cos(2.0) - s_acctbal / 1000 * sin(2.0), 5) + 0.0 AS v FROM supplier")
def _oscillator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An oscillator for each supplier, started from its balance and nation, after two units of time: integrated, against the solution in closed form."""
    from galena.operators.dynamics import rk4

    def run(batches):
        import pandas as pd

        for pdf in batches:
            start = np.array([pdf["s_acctbal"].to_numpy(float) / 1000, pdf["s_nationkey"].to_numpy(float)])
            end = rk4(lambda s: np.array([s[1], -s[0]]), start, 0.01, 200)[-1]
            yield pd.DataFrame({"s_suppkey": pdf["s_suppkey"], "x": end[0].round(5) + 0.0, "v": end[1].round(5) + 0.0})

    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").mapInPandas(run, "s_suppkey long, x double, v double")


_SPINS = 10
_J = np.round(np.random.default_rng(4).normal(size=(_SPINS, _SPINS)), 2)
_J = np.triu(_J, 1) + np.triu(_J, 1).T
_BONDS = ", ".join(f"({i}, {j}, {_J[i, j]})" for i in range(_SPINS) for j in range(i + 1, _SPINS))
_BRUTE = f"WITH b(i, j, w) AS (VALUES {_BONDS}), s AS (SELECT range AS state FROM range({1 << _SPINS})), e AS (SELECT state, -sum(w * (2 * ((state >> i) & 1) - 1) * (2 * ((state >> j) & 1) - 1)) AS e FROM s, b GROUP BY state) SELECT round(CAST(min(e) AS DOUBLE), 6) AS energy FROM e"


@query("ising_bifurcation", _BRUTE)
def _bifurcation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten spins: the energy that simulated bifurcation finds, against all states."""
    from galena.operators.ising import Ising, bifurcation

    return spark.createDataFrame([(round(bifurcation(Ising(_J, np.zeros(_SPINS)), 64)[1], 6),)], "energy double")


@query("ising_brute_force", _BRUTE)
def _brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.ising import Ising, ground_state

    return spark.createDataFrame([(round(ground_state(spark, Ising(_J, np.zeros(_SPINS)))[1], 6),)], "energy double")


COVER = [[2, 4], [0, 3, 6], [1, 2, 5], [2, 4, 5], [0, 3], [1], [3, 4, 6], [1, 4], [0, 6], [2, 5], [3]]
_MASKS = ", ".join(f"({i}, {sum(1 << c for c in row)}, {len(row)})" for i, row in enumerate(COVER))


@query("exact_cover", f"WITH r(id, mask, n) AS (VALUES {_MASKS}), s AS (SELECT range AS pick FROM range({1 << len(COVER)})), c AS (SELECT pick, bit_or(mask) AS m, sum(n) AS n, list(id ORDER BY id) AS ids FROM s JOIN r ON (pick >> id) & 1 = 1 GROUP BY pick) SELECT array_to_string(ids, ' ') AS solution FROM c WHERE m = 127 AND n = 7")
def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All solutions, against all subsets."""
    from galena.operators.combinatorics import exact_cover

    rows = spark.createDataFrame([(i, c) for i, c in enumerate(COVER)], "id long, covers array<int>")
    return exact_cover(rows, list(range(7))).select(F.concat_ws(" ", F.array_sort(F.transform("solution", lambda x: x.cast("int"))).cast("array<string>")).alias("solution"))


@query("queens_eight", "WITH RECURSIVE q AS (SELECT 0 AS r, CAST([] AS INTEGER[]) AS files UNION ALL SELECT r + 1, list_append(files, f) FROM q, (SELECT CAST(range AS INTEGER) AS f FROM range(8)) WHERE r < 8 AND len(list_filter(files, lambda x, i: x = f OR abs(x - f) = r + 1 - i)) = 0) SELECT array_to_string(files, ' ') AS files FROM q WHERE r = 8")
def _eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.combinatorics import queens

    return queens(spark, 8).select(F.concat_ws(" ", F.col("files").cast("array<string>")).alias("files"))


# --- axes: which trees make sense

AXES = {"lag along time": ("causal_translation", True), "lag among the permuted": ("permutation", False), "lag along a ring": ("cyclic", True), "lag of what has no order": ("none", False), "sum of the permuted": ("permutation", True)}


_LAG_MEAN = f"(SELECT round(avg(v), 6) FROM (SELECT lag(value) OVER {W} AS v FROM events))"


@query("axes_of_trees", " UNION ALL ".join(f"SELECT '{k}' AS tree, {str(ok).lower()} AS accepted, {('(SELECT round(sum(value), 6) FROM events)' if 'sum' in k else _LAG_MEAN) if ok else 'CAST(NULL AS DOUBLE)'} AS value" for k, (_, ok) in AXES.items()))
def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are checked against the axis of the users' series before a plan is made; those that make sense are evaluated over it."""
    from galena.operators.axes import Axis, Invariance, TypedVar, violation

    rows, found = table(spark, sf_dir, "events"), []
    for k, (kind, _) in AXES.items():
        env = {"value": TypedVar("value", (Axis("t", 10, Invariance(kind)),))}
        tree = UnOp("reduce_sum", Var("value")) if "sum" in k else linear(M.lag(1))
        fine = violation(tree, env) is None
        value = evaluate(rows, {"v": tree}, EVENTS, keep=[]).agg(F.round(F.avg("v"), 6)).first()[0] if fine else None
        found.append((k, fine, value))
    return spark.createDataFrame(found, "tree string, accepted boolean, value double")


# --- images: a tree on pixels, pooled


for _kind, _sql in {"mean": "avg(v)", "max": "max(v)", "sum": "sum(v)"}.items():

    def _predicted(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        from galena.operators.networks import predict_images

        pixels = rows_of(spark, sf_dir).select((F.col("l_orderkey") % 50).alias("img"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"), F.col("q").alias("image"))
        return predict_images(pixels, UnOp("tanh", MUL(Var("image"), Const(2.0))), kind).select("img", F.round("prediction", 7).alias("prediction"))

    query(f"image_predictor_{_kind}", f"SELECT img, round({_sql}, 7) AS prediction FROM (SELECT l_orderkey % 50 AS img, tanh(q * 2) AS v FROM ({BASE})) GROUP BY 1")(_predicted)
