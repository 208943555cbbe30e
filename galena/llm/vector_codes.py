"""Vectors as short codes: equal parts, each replaced by its nearest entry in the part's codebook.

The nearest entry is found by annular norm pruning. Entries stand in order of their norms; an entry at distance r from a vector has a norm
within r of the vector's, so once some entry is known to lie at distance r, a binary search cuts out the annulus of norms that could hold
an entry as near, both ends included, and only those distances are computed, in exact integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.session import fresh, written

#: Rows whose annuli are evaluated at once.
ROWS = 8192
#: A table of error by label of up to so many rows goes to every executor; a longer one is joined by a shuffle over SALTS places.
MOST_BROADCAST_LABELS, SALTS = 100_000, 32


class Rings:
    """A codebook, entries (k, width) int64, with its entries in order of norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms, self.size = entries[self.order], norms[self.order], len(entries)
        self.evaluated = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row; equal distances go to the lower index."""
        codes, errors = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for at in range(0, len(rows), ROWS):
            codes[at : at + ROWS], errors[at : at + ROWS] = self._nearest(rows[at : at + ROWS])
        return codes, errors

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((rows * rows).sum(1).astype(np.float64))
        above = np.searchsorted(self.norms, norm).clip(0, self.size - 1)
        below = (above - 1).clip(0)
        first = np.where(np.abs(self.norms[below] - norm) <= np.abs(self.norms[above] - norm), below, above)
        gap = rows - self.entries[first]
        reach = np.sqrt((gap * gap).sum(1).astype(np.float64))
        reach += 1e-12 * (reach + norm + 1)  # rounding of the roots must not cut off an entry on the edge
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        count = high - low
        begin = np.concatenate([[0], np.cumsum(count)])
        self.evaluated += int(begin[-1])
        row = np.repeat(np.arange(len(rows)), count)
        place = np.arange(begin[-1]) - np.repeat(begin[:-1] - low, count)
        gap = rows[row] - self.entries[place]
        far = (gap * gap).sum(1)
        best = np.minimum.reduceat(far, begin[:-1])
        return np.minimum.reduceat(np.where(far == best[row], self.order[place], self.size), begin[:-1]), best


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = 4096) -> DataFrame:
    """(vec_id, label, ints): floor(scale * x) of every component; vectors that are null or empty, or hold null, NaN or infinity, go."""
    ints = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    sound = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    return vectors.where(F.col(f"`{vector_col}`").isNotNull() & sound & (F.size(F.col(f"`{vector_col}`")) > 0)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), ints.alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)
    most = math.isqrt((2**63 - 1) // max(1, width)) // 2
    if len(rows) and (rows.max() > most or rows.min() < -most):
        raise ValueError(f"components beyond {most} after scaling: squared distances would not fit in 64 bits")
    return rows


def _sums(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width // len(books)
        rings = [Rings(b) for b in books]
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            for p, ring in enumerate(rings):
                part = np.ascontiguousarray(rows[:, p * step : (p + 1) * step])
                codes, _ = ring.nearest(part)
                order = np.argsort(codes, kind="stable")
                used, begin = np.unique(codes[order], return_index=True)
                if len(used):
                    sums[p][used] += np.add.reduceat(part[order], begin, axis=0)
                    counts[p] += np.bincount(codes, minlength=ring.size)
        out = [(p, e, i, int(s), int(counts[p][e])) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for i, s in enumerate(sums[p][e])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])], ["part", "entry", "i", "sum", "n"])

    return run


def fit_codebooks(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[np.ndarray], int]:
    """(codebooks, vector length): each (entries, length / parts) int64, from rows (vec_id, label, ints) over all rows.

    They start as the parts of the smallest ids (null ids last, rows of one id by their components). A round assigns all rows' parts and puts floor(sum / count) in place of
    every entry that was used; a task sends one row for each component of an entry, whatever it reads. Fewer rows give fewer
    entries, none give no codebooks. Only vectors of the smallest id's length are used; a length that does not fall into equal parts is left
    out before. The components are bounded by 64-bit squared distances; beyond that, ValueError.
    """
    fits = rows.where(F.size("ints") % parts == 0)
    start = [r[0] for r in fits.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()]
    if not start:
        return [], 0
    width = len(start[0])
    start = [x for x in start if len(x) == width]
    if len(start) < entries:  # other lengths stood between
        start = [r[0] for r in fits.where(F.size("ints") == width).orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()]
    step = width // parts
    books = [np.array(start, np.int64)[:, p * step : (p + 1) * step].copy() for p in range(parts)]
    fed = rows.where(F.size("ints") == width).select("ints")
    for _ in range(rounds):
        sums = fed.mapInArrow(_sums(books, width), "part int, entry int, i int, sum long, n long").groupBy("part", "entry", "i").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        for p, e, i, total, n in sums.collect():  # parts x entries x width numbers
            books[p][e, i] = total // n
    return books, width


def _codes(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width // len(books)
        rings = [Rings(b) for b in books]
        digits = max(2, len(f"{max(r.size for r in rings) - 1:x}"))
        for batch in batches:
            rows = _matrix(batch.column(2), width)
            found = [ring.nearest(np.ascontiguousarray(rows[:, p * step : (p + 1) * step])) for p, ring in enumerate(rings)]
            names = [np.array([f"{e:0{digits}x}" for e in range(r.size)], object)[c] for r, (c, _) in zip(rings, found, strict=True)]
            codes = pa.array(np.sum(names, axis=0) if len(rows) else [], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(np.sum([e for _, e in found], axis=0, dtype=np.int64))], ["vec_id", "label", "code", "error"])

    return run


def encode_vectors(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error) of the rows whose length is `width`: two hex digits for each part, and the squared distances summed."""
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not books:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.where(F.size("ints") == width).mapInArrow(_codes(books, width), schema)


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers with commas between, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over all rows of an equal label, nulls together.

    Labels are summed before they meet the rows. A short table of them goes to every executor; a long one is repeated over SALTS places among which each label's
    rows are dealt, so a label of a third of all rows is not one task's.
    """
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    at, salt = fresh(coded, "label"), fresh(coded, "salt")
    sums = sums.withColumnRenamed("label", at)
    match = F.col("label").eqNullSafe(F.col(at))
    if sums.count() <= MOST_BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), match).drop(at)
    sums = sums.withColumn(salt + "s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn(salt, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(sums, match & (F.col(salt) == F.col(salt + "s"))).drop(at, salt, salt + "s")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), a row for each vector that takes part.

    Which vectors do is said by integer_rows and fit_codebooks. Repeated rows are coded each. Null ids stay null. An empty table gives an
    empty one.
    """
    rows = written(integer_rows(vectors, id_col, vector_col, label_col, scale), "integers")
    books, width = fit_codebooks(rows, parts, entries, rounds)
    coded = written(encode_vectors(rows, books, width), "codes")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


_ASSIGN = """a{0} AS MATERIALIZED (
        SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(c) AS c FROM (
            SELECT r.row, r.part, r.c, b.entry, CAST(list_sum(list_transform(list_zip(r.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
            FROM parts r JOIN b{0} b USING (part)) GROUP BY row, part
    )"""
_UPDATE = """b{1} AS MATERIALIZED (
        SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{0} b LEFT JOIN (
            SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM (
                SELECT part, entry, i, CAST(sum(c[i]) AS BIGINT) AS s, count(*) AS n FROM a{0}, generate_series(1, 8) AS g(i) GROUP BY part, entry, i
            ) GROUP BY part, entry) n USING (part, entry)
    )"""
SQL = f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, ints) AS row FROM kept),
    parts AS MATERIALIZED (SELECT row, vec_id, label, p AS part, ints[p * 8 + 1 : p * 8 + 8] AS c FROM numbered, generate_series(0, 7) AS g(p)),
    b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, c FROM parts WHERE row <= 16),
    {", ".join(f"{_ASSIGN.format(i)}, {_UPDATE.format(i, i + 1)}" for i in range(6))}, {_ASSIGN.format(6)},
    coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY row),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN numbered USING (row), digest
"""

__all__ = ["Rings", "codebooks_digest", "encode_vectors", "fit_codebooks", "integer_rows", "vector_codes", "with_label_error"]
