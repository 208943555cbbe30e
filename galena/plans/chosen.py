"""Queries of terms chosen over all rows, with SQL that chooses them from correlations."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators.enumeration import DiscoveryConfig, enumerate_trees
from galena.operators.tree import complexity
from galena.plans.algebra import COLUMNS, in_sql
from galena.plans.registry import query
from galena.sources.tables import table

_CONFIG = DiscoveryConfig(max_size=1, max_terms=2, greedy=True, unary=("sqrt", "exp", "sin"), binary=("add", "sub", "mul"))
_TREES = {f"t{i}": t for i, t in enumerate(enumerate_trees(["d", "q", "x"], _CONFIG))}


def _chosen_sql(y: str) -> str:
    """Of all trees the one that goes best with y, then the one that goes best with what that leaves; weights of both from correlations and spreads."""
    base = f"SELECT {y} AS y, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in COLUMNS.items())} FROM lineitem"
    names, pairs = list(_TREES), list(itertools.permutations(_TREES, 2))
    each = lambda f: "unnest([" + ", ".join(f(n) for n in names) + "])"
    return f"""
        WITH v AS ({in_sql(_TREES, base)}),
        one AS (SELECT {each(lambda n: f"'{n}'")} AS t, {each(lambda n: f"'{_TREES[n]}'")} AS term, {each(lambda n: str(complexity(_TREES[n])))} AS size, {each(lambda n: f'corr(y, {n})')} AS r, {each(lambda n: f'stddev_pop(y) / stddev_pop({n})')} AS scale, {each(lambda n: f'avg({n})')} AS mean, avg(y) AS level FROM v),
        two AS (SELECT unnest([{", ".join(f"'{a}'" for a, _ in pairs)}]) AS a, unnest([{", ".join(f"'{b}'" for _, b in pairs)}]) AS b, unnest([{", ".join(f"corr({a}, {b})" for a, b in pairs)}]) AS rr FROM v),
        first AS (SELECT * FROM one ORDER BY abs(r) - 1e-4 * size DESC LIMIT 1),
        pair AS (
            SELECT f.term AS fterm, o.term, f.r AS r1, o.r AS r2, rr, f.scale AS s1, o.scale AS s2, f.mean AS m1, o.mean AS m2, o.level FROM first f JOIN two ON a = f.t JOIN one o ON o.t = b WHERE rr * rr < 1 - 1e-9
            ORDER BY abs(o.r - f.r * rr) / sqrt((1 - rr * rr) * (1 - f.r * f.r)) - 1e-4 * o.size DESC LIMIT 1
        ), w AS (SELECT *, (r1 - r2 * rr) / (1 - rr * rr) * s1 AS w1, (r2 - r1 * rr) / (1 - rr * rr) * s2 AS w2 FROM pair)
        SELECT fterm AS term, round(w1, 4) AS weight FROM w UNION ALL SELECT term, round(w2, 4) FROM w UNION ALL SELECT 'constant', round(level - w1 * m1 - w2 * m2, 4) FROM w
        UNION ALL SELECT 'r2', round((r1 * r1 + r2 * r2 - 2 * r1 * r2 * rr) / (1 - rr * rr), 6) FROM w
    """


def _chosen(y: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two terms of a dictionary over three columns, chosen and fitted over all rows."""
        from galena.operators.selection import discover_by_data

        rows = table(spark, sf_dir, "lineitem").select(F.expr(y).alias("y"), *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in COLUMNS.items()])
        found = discover_by_data(rows, ["d", "q", "x"], "y", _CONFIG)
        made = [(str(t), round(w, 4)) for w, t in found.terms] + [("constant", round(found.constant, 4)), ("r2", round(found.r2, 6))]
        return spark.createDataFrame(made, "term string, weight double")

    return run


for _name, _y in {"terms_of_price": "l_extendedprice / 1000", "terms_of_net": "l_quantity * (1 - l_discount) * (1 + l_tax)"}.items():
    query(_name, _chosen_sql(_y))(_chosen(_y))
