"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size. A block sorts its rows by every dimension once; a query
walks all lists from their favourable ends, scores the rows that it meets, and stops when the largest sum that
an unmet row could still have does not beat its kth score so far.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_DEPTH = 16


class SortedLists:
    """Rows of integers with, for each dimension, the row numbers in falling order. names: of the rows, where ids repeat."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, names: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], np.ascontiguousarray(rows[order], np.float64)
        self.names, self.peaks = (ids if names is None else names)[order], np.abs(self.rows).max(0, initial=0)
        self.falling = np.ascontiguousarray(np.argsort(-self.rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(np.ascontiguousarray(self.rows.T), self.falling, 1)
        self.scored = 0

    def top(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), falling scores and rising ids; the row of the name `own` is left out. Sums that might pass 2**53 are an error."""
        n = len(self.ids)
        if self.peaks @ np.abs(query) >= 2.0**53:
            raise ValueError("inner products might not be exact: components are too large")
        use = np.flatnonzero(query)
        if not len(use):
            use = np.arange(min(1, len(query)))
        up, down = use[query[use] >= 0], use[query[use] < 0]
        met = np.zeros(n, bool)
        best_scores, best_rows = np.zeros(0), np.zeros(0, np.int64)
        depth, to = 0, min(n, FIRST_DEPTH)
        while depth < n:
            fresh = np.zeros(n, bool)
            fresh[self.falling[up, depth:to].ravel()] = True
            fresh[self.falling[down, n - to : n - depth].ravel()] = True
            fresh &= ~met
            met |= fresh
            rows = np.flatnonzero(fresh)
            if own is not None:
                rows = rows[self.names[rows] != own]
            scores = (self.rows if len(rows) == n else self.rows[rows]) @ query
            self.scored += len(rows)
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[scores >= kth], scores[scores >= kth]
            scores, rows = np.concatenate([best_scores, scores]), np.concatenate([best_rows, rows])
            order = np.lexsort((rows, -scores))[:k]  # rows are in order of ids
            best_scores, best_rows = scores[order], rows[order]
            depth = to
            if depth < n:
                bound = self.values[up, depth - 1] @ query[up] + self.values[down, n - depth] @ query[down]
                # an unmet row may tie at the bound and win by its smaller id
                if len(best_rows) == k and bound < best_scores[-1]:
                    break
            to = min(n, 4 * to)
        return [(int(s), int(self.ids[r])) for s, r in zip(best_scores, best_rows, strict=True)]


def _search(k: int):
    def search(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            by_width = {n: g for n, g in left.groupby(left["ints"].map(len))}
            lists: dict[int, SortedLists] = {}
            for query, name, ints in zip(right["vec_id"], right["row"], right["ints"], strict=True):
                n = len(ints)
                if n not in by_width:
                    continue
                if n not in lists:
                    g = by_width[n]
                    lists[n] = SortedLists(g["vec_id"].to_numpy(np.int64), np.array(g["ints"].tolist(), np.float64).reshape(len(g), n), g["row"].to_numpy(np.int64))
                found += [(name, query, row, score) for score, row in lists[n].top(np.array(ints, np.float64), k, name)]
        return pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score"])

    return search


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, ints, row): floor(scale * x) of every component; vectors that are null or hold null, NaN or infinity go. row numbers the rows, so write them before use."""
    ints = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    sound = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(f"`{vector_col}`").isNotNull() & sound & F.col(f"`{id_col}`").isNotNull())
    return good.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), ints.alias("ints"), F.monotonically_increasing_id().alias("row"))


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, candidate_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Both sides are (vec_id long, ints array<long>, row long), written, as integer_vectors gives. Every row is a candidate but the query's own (that of its number);
    repeated rows are candidates each, and a repeated query is answered each time. Vectors of another length than the query's are
    none of its candidates. Fewer candidates give fewer rows, an empty side none. Products must stay below 2**53 in sum, else ValueError. A task holds one
    block of either side: a stated query set against all rows, in blocks.
    """
    blocks = max(1, -(-candidates.count() // candidate_block))
    groups = max(1, -(-queries.count() // query_block))
    left = candidates.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(_search(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


__all__ = ["SortedLists", "exact_top_k", "integer_vectors"]
