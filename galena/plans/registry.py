"""All queries of the library's own operators by name, with SQL for the same rows where SQL can say it.

Doubles are rounded where the order of a sum may differ between engines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions.pointwise import BINARY, UNARY
from galena.operators import measures as M
from galena.operators.lowering import Series, dense_measure, evaluate
from galena.operators.measures import Linear, Measure, Measure2D, SeparableBilinear, Volterra2
from galena.operators.tree import BinOp, Const, FunctionalOp, FunctionalOp2D, Node, UnOp, Var
from galena.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EVENTS = Series(["ts", "event_id"], ["user_id"])
W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- pointwise: operands with zeros, negatives, nulls and NaN, made from lineitem

A = "CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) WHEN l_quantity = 50 THEN NULL ELSE 40 * l_discount - 2 END"
B = "CASE WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE) WHEN l_quantity = 49 THEN NULL ELSE 25 * l_tax - 1 END"
NAN, NONE = "CAST('NaN' AS DOUBLE)", "CAST(NULL AS DOUBLE)"
NUMBERS = "NOT isnan(a) AND NOT isnan(b)"


def _guard(value: str, *names: str) -> str:
    return f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n in names)} THEN {NONE} WHEN {' OR '.join(f'isnan({n})' for n in names)} THEN {NAN} ELSE {value} END"


BINARY_SQL = {
    "add": "a + b", "sub": "a - b", "mul": "a * b", "div": f"CASE WHEN a IS NULL OR b IS NULL THEN {NONE} WHEN b = 0 THEN 0 ELSE a / b END",
    "min": _guard("least(a, b)", "a", "b"), "max": _guard("greatest(a, b)", "a", "b"),
    **{op: f"CASE WHEN {NUMBERS} AND a {s} b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for op, s in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="))},
    "pow": f"CASE WHEN a IS NULL OR b IS NULL THEN {NONE} WHEN isnan(b) THEN CAST(abs(a) = 1 AS DOUBLE) WHEN isnan(a) THEN CAST(b = 0 AS DOUBLE) ELSE pow(greatest(abs(a), 1e-12), greatest(least(b, 8.0), -8.0)) END",
    "atan2": _guard("atan2(a, b)", "a", "b"),
}
UNARY_SQL = {
    "tanh": _guard("tanh(a)", "a"), "abs": "abs(a)", "sign": _guard("CAST(sign(a) AS DOUBLE)", "a"), "neg": "-a", "step": "CASE WHEN NOT isnan(a) AND a > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "sqrt": _guard("sqrt(abs(a))", "a"), "log": _guard("ln(greatest(abs(a), 1e-12))", "a"), "exp": _guard("exp(greatest(least(a, 50.0), -50.0))", "a"), "sin": _guard("sin(a)", "a"), "cos": _guard("cos(a)", "a"),
    "acos": _guard("acos(greatest(least(a, 1.0), -1.0))", "a"), "asin": _guard("asin(greatest(least(a, 1.0), -1.0))", "a"),
}


def _operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark_sql = lambda s: F.expr(s)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", spark_sql(A).alias("a"), spark_sql(B).alias("b"))


def _pointwise(node: Node, digits: int = 9):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = evaluate(_operands(spark, sf_dir), {"v": node}, keep=["l_orderkey", "l_linenumber"])
        return made.withColumn("v", F.when(F.isnan("v"), F.col("v")).otherwise(F.round("v", digits) + 0.0))

    return run


def _pointwise_sql(value: str, digits: int = 9) -> str:
    return f"WITH t AS (SELECT l_orderkey, l_linenumber, {A} AS a, {B} AS b FROM lineitem), u AS (SELECT l_orderkey, l_linenumber, {value} AS v FROM t) SELECT l_orderkey, l_linenumber, CASE WHEN isnan(v) THEN v ELSE round(v, {digits}) + 0.0 END AS v FROM u"


for _op in BINARY:
    _digits = 2 if _op == "pow" else 9
    query(f"binary_{_op}", _pointwise_sql(BINARY_SQL[_op], _digits))(_pointwise(BinOp(_op, Var("a"), Var("b")), _digits))
for _op in UNARY:
    query(f"unary_{_op}", _pointwise_sql(UNARY_SQL[_op]))(_pointwise(UnOp(_op, Var("a"))))

# --- reductions: over finite entries, as one aggregate joined back

_FINITE = "SELECT 40 * l_discount - 2 + CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE 0 END AS a FROM lineitem"
for _op, _sql in (("reduce_mean", "avg(a)"), ("reduce_max", "max(a)"), ("reduce_sum", "sum(a)"), ("reduce_std", "stddev_pop(a)")):

    def _reduced(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("40 * l_discount - 2 + CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE 0D END").alias("a"))
        made = evaluate(rows, {"v": BinOp("sub", Var("a"), UnOp(op, Var("a")))}, keep=["l_orderkey", "l_linenumber"])
        return made.withColumn("v", F.when(F.isnan("v"), F.col("v")).otherwise(F.round("v", 6) + 0.0))

    query(_op, f"WITH r AS (SELECT {_sql} AS m FROM ({_FINITE}) WHERE NOT isnan(a)), u AS (SELECT l_orderkey, l_linenumber, 40 * l_discount - 2 + CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE 0 END - m AS v FROM lineitem, r) SELECT l_orderkey, l_linenumber, CASE WHEN isnan(v) THEN v ELSE round(v, 6) + 0.0 END AS v FROM u")(_reduced)


@query("reduce_nested", "WITH m AS (SELECT avg(o_totalprice) AS m FROM orders), s AS (SELECT stddev_pop(o_totalprice - m) AS s FROM orders, m) SELECT o_orderkey, round((o_totalprice - m) / s, 8) AS v FROM orders, m, s")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = BinOp("sub", Var("o_totalprice"), UnOp("reduce_mean", Var("o_totalprice")))
    made = evaluate(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), {"v": BinOp("div", centred, UnOp("reduce_std", centred))}, keep=["o_orderkey"])
    return made.withColumn("v", F.round("v", 8))


# --- measures on series: the value of each user's events in order


def _series(trees: dict[str, Node], digits: int = 6):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = evaluate(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), trees, EVENTS, keep=["event_id"])
        return made.select("event_id", *[(F.round(n, digits) + 0.0).alias(n) for n in trees])

    return run


def _series_sql(columns: dict[str, str], digits: int = 6) -> str:
    return f"SELECT event_id, {', '.join(f'round({v}, {digits}) + 0.0 AS {k}' for k, v in columns.items())} FROM events WINDOW w AS {W}"


def linear(mu: Measure, node: Node | None = None) -> Node:
    return FunctionalOp(Linear(mu), (Var("value") if node is None else node,))


def _lag(k: int) -> str:
    return f"lag(value, {k}) OVER w" if k else "value"


query("measure_lag", _series_sql({"l1": _lag(1), "l3": _lag(3), "l7": _lag(7)}))(_series({"l1": linear(M.lag(1)), "l3": linear(M.lag(3)), "l7": linear(M.lag(7))}))
query("measure_diff", _series_sql({"d1": f"value - {_lag(1)}", "d3": f"value - {_lag(3)}"}))(_series({"d1": linear(M.diff(1)), "d3": linear(M.diff(3))}))
_ROLL = "CASE WHEN row_number() OVER w >= 4 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END"
query("measure_roll_mean", _series_sql({"v": _ROLL}))(_series({"v": linear(M.roll_mean(4))}))
query("measure_signed_sum", _series_sql({"v": f"0.5 * value - 2 * {_lag(2)} + 1.5 * {_lag(5)}"}))(_series({"v": linear(M.signed_sum([(0.5, 0), (-2.0, 2), (1.5, 5)]))}))


def _kernel_sql(weight: str, last: int, normalised: bool = True, first: str = "0") -> str:
    """A weighted sum of lags; weight: SQL of k."""
    norm = f" / (SELECT sum({weight}) FROM range({last + 1}) t(k))" if normalised else ""
    terms = [f"({weight.replace('k', str(k))}{norm}) * {_lag(k)}" for k in range(last + 1)]
    return f"{first} + " + " + ".join(terms)


query("density_power_law", _series_sql({"v": _kernel_sql("pow(1 + k / 5.0, -1.5)", 12)}))(_series({"v": linear(M.power_law(5, 1.5, 12))}))
query("density_gaussian_half", _series_sql({"v": _kernel_sql("exp(0 - 0.5 * (k / 3.0) * (k / 3.0))".replace("exp", "EXP"), 9)}))(_series({"v": linear(Measure((), M.Density("gaussian_half", (("sigma", 3.0),), 9)))}))
query("density_exponential_e", _series_sql({"v": _kernel_sql("EXP(0 - k / 4.0)", 10)}))(_series({"v": linear(Measure((), M.Density("exponential_e", (("tau", 4.0),), 10)))}))
_ALPHA = "(1 - pow(2, -1 / 3.0))"
query("density_delta_minus_exp", _series_sql({"v": _kernel_sql(f"0 - {_ALPHA} * pow(1 - {_ALPHA}, k)", 8, False, "value")}))(_series({"v": linear(Measure((), M.Density("delta_minus_exp", (("halflife", 3.0),), 8)))}))
_HELD = f"list(value) OVER {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
query("measure_ema", f"SELECT event_id, round(list_reduce(h, lambda s, x: {_ALPHA} * x + (1 - {_ALPHA}) * s), 6) + 0.0 AS v FROM (SELECT event_id, {_HELD} AS h FROM events)")(_series({"v": linear(M.ema(3))}))
query("measure_composed", _series_sql({"v": f"value - {_lag(1)} - ({_lag(2)} - {_lag(3)})"}))(_series({"v": linear(M.diff(1).compose(M.diff(2)))}))
query("functional_volterra", _series_sql({"v": f"(value - {_lag(1)}) * (value - {_lag(1)})"}))(_series({"v": FunctionalOp(Volterra2(M.diff(1), M.diff(1)), (Var("value"),))}))
query("functional_bilinear", _series_sql({"v": f"({_lag(1)}) * ({_lag(2)} - 100)"}))(_series({"v": FunctionalOp(SeparableBilinear(M.lag(1), M.lag(2)), (Var("value"), BinOp("sub", Var("value"), Const(100.0))))}))


@query("measure_ema_pass")
def _ema_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one series, in range blocks."""
    from galena.operators.lowering import blocked_ema
    from galena.operators.measures import smoothing

    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return blocked_ema(rows, "value", "v", smoothing(3.0), Series(["ts", "event_id"])).select("event_id", F.round("v", 6).alias("v"))


ORACLES["measure_ema_pass"] = f"SELECT event_id, round(v, 6) AS v FROM (WITH RECURSIVE o AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), r AS (SELECT event_id, n, value AS v FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.n, {_ALPHA} * o.value + (1 - {_ALPHA}) * r.v FROM r JOIN o ON o.n = r.n + 1) SELECT * FROM r)"


# --- fields: sums of orders by month and nation

FIELD = Series(["t"], [], "x")
FIELD_SQL = "f AS (SELECT CAST(date_diff('month', TIMESTAMP '1990-01-01', date_trunc('month', o_orderdate)) AS BIGINT) AS t, c_nationkey AS x, sum(o_totalprice) AS u FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), g AS (SELECT tt.t, xx.x, coalesce(f.u, 0) / 777777.7 AS u FROM (SELECT DISTINCT t FROM f) tt CROSS JOIN (SELECT DISTINCT x FROM f) xx LEFT JOIN f ON f.t = tt.t AND f.x = xx.x)"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense long field (t, x, u); absent cells are zero."""
    joined = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    month = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).cast("long")
    sums = joined.groupBy(month.alias("t"), F.col("c_nationkey").alias("x")).agg(F.sum("o_totalprice").alias("u"))
    wide = sums.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("x", "u"))).alias("m"))
    places = F.broadcast(sums.select("x").distinct().agg(F.array_sort(F.collect_set("x")).alias("xs")))  # the nations
    return wide.join(places).select("t", F.explode("xs").alias("x"), "m").select("t", "x", (F.coalesce(F.get(F.map_values(F.map_filter("m", lambda k, v: k == F.col("x"))), F.lit(0)), F.lit(0.0)) / 777777.7).alias("u"))


def _field(m: Measure2D):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = evaluate(field(spark, sf_dir), {"v": FunctionalOp2D(m, Var("u"))}, FIELD, keep=["t", "x"])
        return made.select("t", "x", (F.round("v", 6) + 0.0).alias("v"))

    return run


def _field_sql(m: Measure2D) -> str:
    """The stencil by joins on shifted places, another way than the plan's windows."""
    side = m.max_abs_lag_x
    joins, total = [], []
    for n, a in enumerate(m.points()):
        joins.append(f"LEFT JOIN p p{n} ON p{n}.i = p.i - {a.lag_t} AND p{n}.j = p.j - ({a.lag_x})")
        total.append(f"{a.weight} * p{n}.u")
    inside = f"p.i > {m.max_lag_t} AND p.j > {side} AND p.j <= (SELECT max(j) FROM p) - {side}"
    return f"WITH {FIELD_SQL}, p AS (SELECT t, x, u, dense_rank() OVER (ORDER BY t) AS i, dense_rank() OVER (ORDER BY x) AS j FROM g) SELECT p.t, p.x, CASE WHEN {inside} THEN round({' + '.join(total)}, 6) + 0.0 END AS v FROM p {' '.join(joins)}"


for _name, _m in {
    "laplacian": M.laplacian(), "diff_t": M.diff_t(2), "grad_x": M.grad_x(), "sobel_x": M.sobel_x(), "sobel_y": M.sobel_y(), "separable": M.separable_2d(M.diff(1), M.signed_sum([(0.5, 0), (0.25, 1), (0.25, 2)])), "mixed": M.atomic_2d([(1.0, 1, 1), (-2.0, 0, 0), (1.0, 2, -1)]),
}.items():
    query(f"field_{_name}", _field_sql(_m))(_field(_m))


@query("field_dense", _field_sql(M.laplacian()))
def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = field(spark, sf_dir)
    wide = f.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("x", "u"))).alias("s")).select("t", F.transform("s", lambda s: s["x"]).alias("xs"), F.transform("s", lambda s: s["u"]).alias("us"))
    made = dense_measure(wide, "us", "vs", M.laplacian(), ["t"])
    return made.select("t", F.explode(F.arrays_zip("xs", "vs")).alias("z")).select("t", F.col("z.xs").alias("x"), (F.round("z.vs", 6) + 0.0).alias("v"))


# --- scoring

SIGNALS: dict[str, Node] = {
    "last": linear(M.lag(1)), "value": Var("value"), "roll3": linear(M.roll_mean(3)), "ahead": BinOp("add", Var("value"), linear(M.diff(1))),
    "square": FunctionalOp(Volterra2(M.diff(1), M.diff(1)), (Var("value"),)), "rising": BinOp("mul", BinOp("gt", linear(M.diff(1)), Const(0.0)), Var("value")), "mean": Const(100.0),
}
SIGNAL_SQL = {
    "last": (2, _lag(1)), "value": (1, "value"), "roll3": (2, "CASE WHEN row_number() OVER w >= 3 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END"),
    "ahead": (4, f"value + value - {_lag(1)}"), "square": (2, f"(value - {_lag(1)}) * (value - {_lag(1)})"), "rising": (6, f"CASE WHEN value - {_lag(1)} > 0 THEN value ELSE 0 END"), "mean": (1, "100.0"),
}
LOSS_SQL = f"s AS (SELECT lead(value) OVER w AS y, {', '.join(f'{v} AS {k}' for k, (_, v) in SIGNAL_SQL.items())} FROM events WINDOW w AS {W}), l AS ({' UNION ALL '.join(f"SELECT '{k}' AS tree, {c} AS complexity, avg(({k} - y) * ({k} - y)) AS loss FROM s" for k, (c, _) in SIGNAL_SQL.items())})"


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.scoring import population_table

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    rows = rows.withColumn("y", F.lead("value").over(EVENTS.window()))
    return population_table(rows, SIGNALS, "y", EVENTS)


@query("losses_mse", f"WITH {LOSS_SQL} SELECT tree, complexity, round(loss, 4) AS loss FROM l")
def _mse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).withColumn("loss", F.round("loss", 4))


@query("flagship_pareto", f"WITH {LOSS_SQL}, b AS (SELECT complexity, min(loss) AS m FROM l GROUP BY 1), f AS (SELECT *, min(m) OVER (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b) SELECT tree, l.complexity, round(loss, 4) AS loss FROM l JOIN f ON l.complexity = f.complexity AND l.loss = f.m WHERE p IS NULL OR m < p")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which signals on each user's series predict the next value: the front of complexity against loss."""
    from galena.operators.scoring import pareto_rows

    return pareto_rows(_losses(spark, sf_dir)).withColumn("loss", F.round("loss", 4))


@query("hall_of_fame", f"WITH {LOSS_SQL}, a AS (SELECT * FROM l UNION ALL SELECT 'other', 2, 1.0), r AS (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY loss, tree) AS n FROM a) SELECT tree, complexity, round(loss, 4) AS loss FROM r WHERE n = 1")
def _hall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.scoring import merge_halls

    other = spark.range(1).select(F.lit("other").alias("tree"), F.lit(2).alias("complexity"), F.lit(1.0).alias("loss"))
    return merge_halls(_losses(spark, sf_dir), other).withColumn("loss", F.round("loss", 4))


_PNL = f"s AS (SELECT value - {_lag(1)} AS p, (lead(value) OVER w - value) / 100 AS y, user_id, ts, event_id FROM events WINDOW w AS {W}), z AS (SELECT CASE WHEN p IS NULL OR y IS NULL THEN 0 ELSE p END AS p, CASE WHEN p IS NULL OR y IS NULL THEN 0 ELSE y END AS y, user_id, ts, event_id FROM s)"


def _signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return evaluate(rows, {"p": linear(M.diff(1))}, EVENTS).withColumn("y", (F.lead("value").over(EVENTS.window()) - F.col("value")) / 100)


@query("loss_pnl_hard", f"WITH {_PNL}, d AS (SELECT p, y, abs(sign(p) - lag(sign(p)) OVER w) AS d FROM z WINDOW w AS {W}) SELECT round(-avg(tanh(100 * p) * y) + 0.003 * coalesce(sum(d), 0) / (2 * count(*)), 8) AS loss FROM d")
def _pnl_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.scoring import pnl_hard

    return pnl_hard(_signal_rows(spark, sf_dir), "p", "y", EVENTS).select(F.round("loss", 8).alias("loss"))


@query("loss_pnl_smooth", f"WITH {_PNL}, h AS (SELECT tanh(0.01 * p) AS s, y, user_id, ts, event_id FROM z), d AS (SELECT s, y, s - lag(s) OVER w AS d FROM h WINDOW w AS {W}) SELECT round(-avg(s * y) + 0.1 * avg((s * s - 1) * (s * s - 1)) + 0.2 * coalesce(avg(d * d), 0), 8) AS loss FROM d")
def _pnl_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.scoring import pnl_smooth

    return pnl_smooth(_signal_rows(spark, sf_dir), "p", "y", EVENTS, 0.01, 0.1, 0.2).select(F.round("loss", 8).alias("loss"))


@query("population_shared", f"WITH s AS (SELECT lead(value) OVER w AS y, value, value - {_lag(1)} AS d FROM events WINDOW w AS {W}) " + " UNION ALL ".join(f"SELECT 't{k}' AS tree, {c} AS complexity, round(avg((value * 0.{k} + d - y) * (value * 0.{k} + d - y)), 4) AS loss FROM s" for k, c in ((k, 6) for k in range(1, 8))))
def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven trees that share a measure: one window, one aggregate."""
    from galena.operators.scoring import population_table

    trees = {f"t{k}": BinOp("add", BinOp("mul", Var("value"), Const(k / 10)), linear(M.diff(1))) for k in range(1, 8)}
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value").withColumn("y", F.lead("value").over(EVENTS.window()))
    return population_table(rows, trees, "y", EVENTS).withColumn("loss", F.round("loss", 4))


@query("intervals", "SELECT n AS name, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT 'sum' AS n, min(l_quantity) + min(l_tax) AS low, max(l_quantity) + max(l_tax) AS high FROM lineitem UNION ALL SELECT 'product', min(l_quantity) * min(l_discount), max(l_quantity) * max(l_discount) FROM lineitem UNION ALL SELECT 'log', ln(min(l_quantity)), ln(max(l_quantity)) FROM lineitem UNION ALL SELECT 'difference', min(l_quantity) - max(l_discount), max(l_quantity) - min(l_discount) FROM lineitem)")
def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators import intervals

    env = intervals.of_columns(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    q, d, t = Var("l_quantity"), Var("l_discount"), Var("l_tax")
    trees = {"sum": BinOp("add", q, t), "product": BinOp("mul", q, d), "log": UnOp("log", q), "difference": BinOp("sub", q, d)}
    found = {k: intervals.evaluate(n, env) for k, n in trees.items()}
    return spark.createDataFrame([(k, round(r.low, 6), round(r.high, 6)) for k, r in found.items()], "name string, low double, high double")


@query("bound_mse", "SELECT 'narrow' AS name, round(avg(pow(l_quantity - greatest(least(l_quantity, 30), 20), 2)), 8) AS bound FROM lineitem UNION ALL SELECT 'low', round(avg(pow(l_quantity - greatest(least(l_quantity, 5), 0), 2)), 8) FROM lineitem")
def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators import intervals

    found = intervals.least_mse(table(spark, sf_dir, "lineitem"), "l_quantity", {"narrow": intervals.Interval(20, 30), "low": intervals.Interval(0, 5)})
    return spark.createDataFrame([(k, round(v, 8)) for k, v in found.items()], "name string, bound double")


# --- regression


@query("ols", "SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem UNION ALL SELECT 'r2', round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem")
def _ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.regression import ols

    fit = ols(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), {"q": F.col("l_quantity")}, F.col("l_extendedprice"))
    return spark.createDataFrame([("slope", round(fit["q"], 4)), ("intercept", round(fit["1"], 3)), ("r2", round(float(fit.r2), 6))], "name string, value double")


@query("power_law", "SELECT round(regr_slope(ln(y), ln(x)), 6) AS exponent, round(exp(regr_intercept(ln(y), ln(x))), 6) AS scale FROM (SELECT l_quantity AS x, 3 * l_quantity * l_quantity * sqrt(l_quantity) AS y FROM lineitem)")
def _power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.regression import power_law

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (3 * F.col("l_quantity") * F.col("l_quantity") * F.sqrt("l_quantity")).alias("y"))
    found = power_law(rows, ["x"], "y")
    return spark.createDataFrame([(round(found.exponents["x"], 6), round(found.scale, 6))], "exponent double, scale double")


@query("moments", "WITH t AS (SELECT l_quantity / 50 AS x, l_discount AS z, l_tax - 0.04 AS r FROM lineitem) SELECT 'change' AS name, round((2 * (0.1 * sum(x * r) + 0.2 * sum(z * r)) + 0.01 * sum(x * x) + 0.04 * sum(x * z) + 0.04 * sum(z * z)) / count(*), 10) AS value FROM t")
def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.regression import Moments

    m = Moments.of(table(spark, sf_dir, "lineitem"), [F.col("l_quantity") / 50, F.col("l_discount")], F.col("l_tax") - 0.04)
    return spark.createDataFrame([("change", round(m.change(np.array([0.1, 0.2])), 10))], "name string, value double")


def _lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rates of a Lorenz trajectory from its states, by thresholded least squares on monomials."""
    from galena.operators.dynamics import SYSTEMS, trajectories
    from galena.operators.regression import monomial_column, monomials, stlsq

    rows = trajectories(spark, [{"system": "lorenz63"}]).select(*[F.get("state", F.lit(i)).alias(n) for i, n in enumerate("xyz")])
    p, out = SYSTEMS["lorenz63"].params, []
    rates = {"x": p["sigma"] * (F.col("y") - F.col("x")), "y": F.col("x") * (p["rho"] - F.col("z")) - F.col("y"), "z": F.col("x") * F.col("y") - p["beta"] * F.col("z")}
    for name, rate in rates.items():
        fit = stlsq(rows, {str(k): monomial_column(list("xyz"), k) for k in monomials(list("xyz"), 2)}, rate)
        out += [(name, term, round(float(c), 6)) for term, c in zip(fit.names, fit.coefficients, strict=True) if abs(c) > 1e-8]
    return spark.createDataFrame(out, "rate string, term string, coefficient double")


# --- trajectories


def user_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as a trajectory of one component."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    number = (F.row_number().over(EVENTS.window()) - 1).cast("long")
    return rows.select(F.col("user_id").cast("string").alias("traj_id"), number.alias("i"), number.cast("double").alias("t"), F.array("value").alias("state"))


_USERS = f"e AS (SELECT CAST(user_id AS VARCHAR) AS traj_id, value AS v, row_number() OVER {W} - 1 AS i FROM events), m AS (SELECT traj_id, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM e GROUP BY 1), c AS (SELECT e.traj_id, i, v - m AS c, s, n FROM e JOIN m USING (traj_id))"


@query("autocorrelation", f"WITH {_USERS} SELECT a.traj_id, CAST(b.i - a.i AS INTEGER) AS lag, round(avg(a.c * b.c) / any_value(a.s), 8) AS acf FROM c a JOIN c b ON a.traj_id = b.traj_id AND b.i - a.i BETWEEN 1 AND 5 WHERE b.i - a.i < a.n / 2.0 AND a.s > 1e-300 GROUP BY 1, 2")
def _acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.dynamics import autocorrelation

    return autocorrelation(user_trajectories(spark, sf_dir), 5).where("acf is not null").select("traj_id", F.col("lag").cast("int").alias("lag"), F.round("acf", 8).alias("acf"))


@query("smoothness", f"WITH {_USERS}, d AS (SELECT a.traj_id, b.i - a.i AS g, avg((b.c - a.c) * (b.c - a.c)) AS s FROM c a JOIN c b ON a.traj_id = b.traj_id AND b.i - a.i IN (1, 2, 4, 8, 16) GROUP BY 1, 2), h AS (SELECT traj_id, regr_slope(ln(s), ln(g)) / 2 AS h FROM d WHERE s > 0 GROUP BY 1) SELECT traj_id, round(greatest(0, least(2, h)), 6) AS smoothness FROM h WHERE h IS NOT NULL AND NOT isnan(h)")
def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.dynamics import smoothness

    return smoothness(user_trajectories(spark, sf_dir)).where("not isnan(smoothness)").select("traj_id", F.round("smoothness", 6).alias("smoothness"))


@query("full_signature")
def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signature that applies to what each user's series of values is taken for."""
    from galena.operators.dynamics import full_signature

    return full_signature(user_trajectories(spark, sf_dir))


@query("koopman_one_step", "WITH m AS (SELECT avg(value) AS m FROM events), s AS (SELECT event_id, value - m AS p, lead(value - m) OVER w AS n, value, m FROM events, m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT sum(p * n) / (sum(p * p) + 1e-6) AS b FROM s WHERE n IS NOT NULL) SELECT event_id, round(m + b * p, 6) AS forecast FROM s, b")
def _koopman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.koopman import fit

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    model = fit(rows, ["value"], EVENTS, past=1, rank=1)
    return rows.select("event_id", F.round(model.one_step_columns(EVENTS)["value"], 6).alias("forecast"))


@query("nearest_neighbours", "WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.embedding, v.embedding) AS d FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM d) SELECT query_id, vec_id, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3")
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of an embedding nearest to each query point: queries in blocks against all rows in blocks, each pair of blocks a task."""
    import pandas as pd
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = rows.where("vec_id % 100 = 0")
    many = [max(1, -(-df.count() // size)) for df, size in ((rows, 8192), (asked, 1024))]
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("c", block(many[0])).withColumn("q", every(many[1]))
    right = asked.withColumn("q", block(many[1])).withColumn("c", every(many[0]))

    def near(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "d": []})]
        if len(points):
            x, own = np.array(points["e"].tolist()), points["vec_id"].to_numpy()
            for i, p in zip(queries["vec_id"], queries["e"], strict=True):
                d = np.sqrt(((x - np.array(p)) ** 2).sum(1))
                d[own == i] = np.inf
                best = np.lexsort((own, d))[:3]
                best = best[np.isfinite(d[best])]
                found.append(pd.DataFrame({"query_id": i, "vec_id": own[best], "d": d[best]}))
        return pd.concat(found)

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(near, "query_id long, vec_id long, d double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where("rank <= 3").select("query_id", "vec_id", "rank")


@query("lagged_join", "SELECT c_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- combinatorics and spins


@query("queens", "WITH RECURSIVE q AS (SELECT 0 AS r, CAST([] AS INTEGER[]) AS files UNION ALL SELECT r + 1, list_append(files, f) FROM q, (SELECT CAST(range AS INTEGER) AS f FROM range(6)) WHERE r < 6 AND len(list_filter(files, lambda x, i: x = f OR abs(x - f) = r + 1 - i)) = 0) SELECT files[1] AS a, files[2] AS b, files[3] AS c, files[4] AS d, files[5] AS e, files[6] AS f FROM q WHERE r = 6")
def _queens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.combinatorics import queens

    return queens(spark, 6).select(*[F.get("files", F.lit(i)).alias(n) for i, n in enumerate("abcdef")])


@query("ising_ground_state", "WITH s AS (SELECT range AS state, list_transform(range(6), lambda i: 2 * ((range >> i) & 1) - 1) AS s FROM range(64)), e AS (SELECT state, -list_sum(list_transform(range(1, 6), lambda i: s[i] * s[i + 1] * CASE WHEN i % 2 = 0 THEN 1.5 ELSE -1 END)) - 0.25 * s[1] AS e FROM s) SELECT min_by(state, e * 1000 + state) AS state, min(e) AS energy FROM e")
def _ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.ising import Ising, ground_state

    j = np.zeros((6, 6))
    for i in range(1, 6):
        j[i - 1, i] = j[i, i - 1] = 1.5 if i % 2 == 0 else -1.0
    state, energy = ground_state(spark, Ising(j, np.array([0.25, 0, 0, 0, 0, 0])))
    return spark.createDataFrame([(state, energy)], "state long, energy double")


@query("ising_recovery")
def _recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.ising import monomial_energy, random_ising, sample

    rows = sample(spark, random_ising(5, 0.6, 1), 0.6, 4000, 40)
    found = monomial_energy(rows, [f"s{i}" for i in range(5)], 2, 0.6)
    return spark.createDataFrame([(str(k), v) for k, v in sorted(found.items())], "term string, coupling double")


@query("image_pooling", f"WITH {FIELD_SQL}, p AS (SELECT u, dense_rank() OVER (ORDER BY t) - 1 AS r, dense_rank() OVER (ORDER BY x) - 1 AS c FROM g) SELECT CAST(floor(r / 10) * 2 + floor(c / 10) AS INTEGER) AS region, round(avg(u), 8) AS image FROM p WHERE r < 20 AND c < 20 GROUP BY 1")
def _pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from galena.operators.networks import pool_rows

    f = field(spark, sf_dir)
    places = {n: f.select(n).distinct().withColumn(k, F.row_number().over(Window.orderBy(n)) - 1) for n, k in (("t", "r"), ("x", "c"))}
    pixels = f.join(F.broadcast(places["t"]), "t").join(F.broadcast(places["x"]), "x").select(F.lit(0).alias("img"), "r", "c", F.col("u").alias("image"))
    return pool_rows(pixels, "image", 2, 20, 20).select("region", F.round("image", 8).alias("image"))


# --- search and discovery: seeded; rows only


def _on_all_rows(spark: SparkSession, rows: DataFrame, front: list, y: str) -> DataFrame:
    """(tree, complexity, loss) of a front that was found on a bounded sample, its losses over the whole table."""
    from galena.operators.scoring import losses_by_data

    losses = losses_by_data(rows, [c.tree for c in front], y)
    return spark.createDataFrame([(str(c.tree), c.complexity, float(x)) for c, x in zip(front, losses, strict=True)], "tree string, complexity int, loss double")


def _goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select((q / 50).alias("q"), (d * 10).alias("d"), (q * (1 - d)).alias("net"), d.alias("discount"), (3 * q / 50 + 2).alias("line"))


@query("search_evolution")
def _evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.enumeration import sample_rows
    from galena.operators.search import Evolution, Grammar, SearchConfig

    rows = _goods(spark, sf_dir)
    data = sample_rows(rows, ["q", "d", "net"], 2000)
    front = Evolution(Grammar(["q", "d"], measures_1d=False), {k: data[k] for k in "qd"}, data["net"], SearchConfig(population=60, generations=10, seed=1), spark).run()
    return _on_all_rows(spark, rows, front, "net")


_GOODS_SQL = "SELECT l_quantity / 50 AS q, l_discount * 10 AS d, l_quantity * (1 - l_discount) AS net FROM lineitem"


@query(
    "search_by_data",
    f"WITH v AS ({_GOODS_SQL}) SELECT 1 AS complexity, round(var_pop(net), 6) AS loss FROM v UNION ALL SELECT 3, round((sum(net * net) - sum(q * net) * sum(q * net) / sum(q * q)) / count(*), 6) FROM v"
    " UNION ALL SELECT 0, round(min(power(net - q * (50 - 5 * d), 2)), 6) + 0.0 FROM v",
)
def _evolution_by_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing but passes over all rows: scores, fitted constants, ranges and the target's bounds, by which trees are pruned. The front's constant, its
    multiple of q, and (as complexity 0) its best, which is exact: each the least loss that SQL has for its form."""
    from galena.operators.search import Evolution, Grammar, SearchConfig

    rows = _goods(spark, sf_dir)
    skeleton = BinOp("mul", Var("q"), BinOp("sub", Const(50.5), BinOp("mul", Const(4.5), Var("d"))))
    config = SearchConfig(population=40, generations=3, snap=False, seed=1, seeds=[Const(1.0), BinOp("mul", Const(30.0), Var("q")), skeleton])
    search = Evolution.on_table(Grammar(["q", "d"], measures_1d=False), rows, "net", config)
    front = search.run()
    search.score.close()
    found = [(c.complexity, c.loss) for c in front if c.complexity in (1, 3)] + [(0, min(c.loss for c in front))]
    return spark.createDataFrame([(k, round(v, 6) + 0.0) for k, v in found], "complexity int, loss double")


@query("search_random")
def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.enumeration import sample_rows
    from galena.operators.search import Grammar, random_search

    rows = _goods(spark, sf_dir)
    data = sample_rows(rows, ["q", "discount"], 2000)
    front = random_search(Grammar(["q"], measures_1d=False), {"q": data["q"]}, data["discount"], 1000, 1, spark)
    return _on_all_rows(spark, rows, front, "discount")


@query("search_annealing")
def _annealing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.enumeration import sample_rows
    from galena.operators.search import Grammar, anneal

    rows = _goods(spark, sf_dir)
    data = sample_rows(rows, ["q", "line"], 1000)
    front = anneal(Grammar(["q"], measures_1d=False), {"q": data["q"]}, data["line"], 400, 4, seed=2, spark=spark)
    return _on_all_rows(spark, rows, front, "line")


@query("discover_decompose")
def _decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net price of an item from its columns, on a bounded sample; the loss is then taken over all rows."""
    from galena.operators.enumeration import decompose, sample_rows
    from galena.operators.scoring import losses_by_data

    df = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    data = sample_rows(df, ["l_extendedprice", "l_discount", "net"], 2000)
    found = decompose({k: data[k] for k in ("l_extendedprice", "l_discount")}, data["net"])
    (loss,) = losses_by_data(df, [found.tree], "net")
    return spark.createDataFrame([(str(found.tree), float(found.r2), loss < 1e-6)], "tree string, r2 double, exact boolean")


@query("recovery_formulas")
def _recovery_of_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty formulas from 2,000 rows each, judged on rows that the search does not see; a formula a task."""
    from galena.plans.formulas import recovery

    return recovery(spark).select("formula", "rel", "exact", "found")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from galena.plans import algebra, chosen, fits, series, signatures  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from galena.plans import algebra, chosen, fits, series, signatures  # noqa: F401

    return dict(ORACLES)
