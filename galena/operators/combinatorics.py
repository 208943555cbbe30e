"""Exact cover and its relatives, as joins of partial solutions with rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.sources.tables import materialised


def exact_cover(rows: DataFrame, primary: list[int], secondary: list[int] | None = None) -> DataFrame:
    """(solution array<long>) for rows (id long, covers array<int>): sets of rows that cover every primary column once, secondary at most once.

    Each round joins every partial solution with the rows that cover its first open primary column and overlap nothing, so a
    solution is found once. Columns are taken by how few rows cover them.
    """
    spark = rows.sparkSession
    known = set(primary) | set(secondary or [])
    counts = {r[0]: r[1] for r in rows.select(F.explode("covers").alias("c")).groupBy("c").count().collect()}
    order = sorted(primary, key=lambda c: (counts.get(c, 0), c))
    usable = rows.where(F.forall("covers", lambda c: c.isin(*sorted(known)))) if known else rows
    partial = spark.createDataFrame([([], [])], "solution array<long>, taken array<int>")
    for column in order:
        open_ = partial.where(~F.array_contains("taken", column))
        done = partial.where(F.array_contains("taken", column))
        with_column = usable.where(F.array_contains("covers", column))
        grown = open_.join(F.broadcast(with_column) if counts.get(column, 0) < 100_000 else with_column, ~F.arrays_overlap("taken", "covers"))
        grown = grown.select(F.concat("solution", F.array("id")).alias("solution"), F.concat("taken", "covers").alias("taken"))
        partial = materialised(done.unionByName(grown))
    return partial.select(F.array_sort("solution").alias("solution")).distinct()


def count_exact_covers(rows: DataFrame, primary: list[int], secondary: list[int] | None = None) -> int:
    return exact_cover(rows, primary, secondary).count()


def solve_local(rows: dict[int, set[int]], primary: set[int], secondary: set[int] | None = None) -> Iterator[list[int]]:
    """The same in memory by depth-first search, always at the primary column with the fewest rows left."""

    def search(open_columns: set[int], left: dict[int, set[int]], chosen: list[int]) -> Iterator[list[int]]:
        if not open_columns:
            yield sorted(chosen)
            return
        column = min(open_columns, key=lambda c: (sum(c in s for s in left.values()), c))
        for i in sorted(k for k, s in left.items() if column in s):
            taken = left[i]
            yield from search(open_columns - taken, {k: s for k, s in left.items() if not s & taken}, [*chosen, i])

    allowed = primary | (secondary or set())
    yield from search(set(primary), {k: set(s) for k, s in rows.items() if s <= allowed}, [])


def queens_rows(n: int) -> dict[int, set[int]]:
    """Squares as rows: rank and file are primary columns, the two diagonals secondary."""
    return {r * n + f: {r, n + f, 2 * n + r + f, 4 * n - 1 + r - f + n - 1} for r in range(n) for f in range(n)}


def queens_count(n: int) -> int:
    return sum(1 for _ in solve_local(queens_rows(n), set(range(2 * n)), set(range(2 * n, 6 * n + 2))))


def queens(spark: SparkSession, n: int) -> DataFrame:
    """(files array<int>): the queen's file on each rank, for every placement on an n by n board; a rank a round."""
    if n < 1:
        return spark.createDataFrame([([],)], "files array<int>")
    board = spark.range(n).select(F.array(F.col("id").cast("int")).alias("files"))
    for rank in range(1, n):
        safe = F.forall(F.sequence(F.lit(0), F.lit(rank - 1)), lambda r: (F.get("files", r) != F.col("f")) & (F.abs(F.get("files", r) - F.col("f")) != F.lit(rank) - r))
        grown = board.select("files", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("f"))
        board = grown.where(safe).select(F.concat("files", F.array("f")).alias("files"))
    return board
