"""Nearest neighbours within a cloud or a series of any length, and the exponent of paths that part.

Points are dealt to boxes, cut in turn along the widest coordinate at medians of a sample; equal coordinates are cut by the point's number, so no value makes a box too full. A first
round finds each point's nearest in its own box. That distance is a bound: whatever is nearer lies in a box that the ball of that radius meets, so a second round asks exactly those boxes,
which are none for most points, and the least answer is the neighbour. Neighbours in time are left out inside both rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators.aggregated import numbered
from galena.operators.lowering import Series
from galena.sources.tables import materialised

#: Points of a box, about, and of the smaller boxes within it; sampled points of a box; squared distances that are held at once; rows of a range of a series.
SLAB, LEAF, DRAWN, AT_ONCE, RANGE = 4096, 64, 16, 1 << 20, 1 << 16
#: Rows of a range from which paths are sent, and paths sent in one piece.
PATHS, PACK = 1 << 19, 1 << 16
FOUND = "i long, j long, d double"


class Boxes:
    """Boxes of about `size` of the given points each. A cut is a pair (coordinate, number), so points that are equal can be parted."""

    def __init__(self, points: np.ndarray, numbers: np.ndarray, size: int) -> None:
        self.cuts: list[tuple[int, float, int, int, int]] = []  # axis, coordinate, number, and what lies below and above: a cut, or ~box
        self.members: list[np.ndarray] = []
        self.root = self._part(points, numbers, np.arange(len(points)), size)

    def _part(self, points: np.ndarray, numbers: np.ndarray, at: np.ndarray, size: int) -> int:
        if len(at) < 2 * size:
            self.members.append(at)
            return ~(len(self.members) - 1)
        some = points[at]
        axis = int(np.ptp(some, axis=0).argmax())
        order = np.lexsort((numbers[at], some[:, axis]))
        middle = at[order[len(at) // 2]]
        k = len(self.cuts)
        self.cuts.append((0, 0.0, 0, 0, 0))
        below, above = (self._part(points, numbers, at[half], size) for half in (order[: len(at) // 2], order[len(at) // 2 :]))
        self.cuts[k] = (axis, float(points[middle, axis]), int(numbers[middle]), below, above)
        return k

    def __len__(self) -> int:
        return len(self.members)

    def place(self, points: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The box of each point."""
        out, todo = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        while todo:
            k, at = todo.pop()
            if k < 0:
                out[at] = ~k
            elif len(at):
                axis, cut, number, below, above = self.cuts[k]
                x = points[at, axis]
                up = (x > cut) | (x == cut) & (numbers[at] >= number)
                todo += [(below, at[~up]), (above, at[up])]
        return out

    def met(self, points: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(box, those points whose ball of squared radius `far` meets it); balls of no radius meet none."""
        m = points.shape[1]
        todo = [(self.root, np.flatnonzero(far > 0), np.full(m, -np.inf), np.full(m, np.inf))]
        far = far * (1 + 1e-12)
        while todo:
            k, at, low, high = todo.pop()
            if not len(at):
                continue
            if k < 0:
                yield ~k, at
                continue
            axis, cut, _, below, above = self.cuts[k]
            for child, side in ((below, high), (above, low)):
                lows, highs = (low, high.copy()) if side is high else (low.copy(), high)
                (highs if side is high else lows)[axis] = cut
                gap = np.maximum(np.maximum(lows - points[at], points[at] - highs), 0)
                todo.append((child, at[(gap * gap).sum(1) <= far[at]], lows, highs))


def _nearer(points: np.ndarray, numbers: np.ndarray, asked: np.ndarray, of: np.ndarray, apart: int, best: np.ndarray, found: np.ndarray, at: np.ndarray) -> None:
    """Puts into best and found, for the asked points `at`, the nearest of all points that is apart, if it is nearer, or as near and of a smaller number. Numbers rise."""
    step = max(1, AT_ONCE // max(1, len(points)))
    for begin in range(0, len(at), step):
        some = at[begin : begin + step]
        a = asked[some]
        d = np.zeros((len(a), len(points)))
        for c in range(points.shape[1]):
            d += (a[:, c, None] - points[None, :, c]) ** 2
        d[np.abs(of[some, None] - numbers[None]) <= apart] = np.inf
        k = d.argmin(1)
        least, which = d[np.arange(len(a)), k], numbers[k]
        closer = (least < best[some]) | (least == best[some]) & np.isfinite(least) & (which < found[some])
        best[some[closer]], found[some[closer]] = least[closer], which[closer]


def _nearest(points: np.ndarray, numbers: np.ndarray, asked: np.ndarray, of: np.ndarray, apart: int, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each asked point (of number `of`) the nearest point whose number is more than `apart` away: (its number or -1, squared distance).

    far: what is farther need not be found. Without it the points ask for themselves. Of equally near points the smallest number, but of those that equal the asked one the smallest of a box.
    """
    order = np.argsort(numbers, kind="stable")
    points, numbers = points[order], numbers[order]
    boxes = Boxes(points, numbers, LEAF)
    members = [np.sort(at) for at in boxes.members]
    best, found = np.full(len(asked), np.inf), np.full(len(asked), -1, np.int64)
    if far is None:
        own = boxes.place(asked, of)
        for k, at in enumerate(members):
            _nearer(points[at], numbers[at], asked, of, apart, best, found, np.flatnonzero(own == k))
        far = best.copy()
    for k, at in boxes.met(asked, far):
        _nearer(points[members[k]], numbers[members[k]], asked, of, apart, best, found, at)
    return found, best


def _cloud(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _lists(flat: np.ndarray, lengths: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat)) if missing is None else pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(missing))


def nearest_neighbours_apart(points: DataFrame, apart: int = 0, slab: int = SLAB) -> DataFrame:
    """(i, j, d) for points (i long, p array<double>): each point's nearest other one whose number differs by more than `apart`, and the squared distance.

    Exact. Of equally near points the smallest number; of those that equal the asked point, the smallest of one box. Points with a missing or infinite coordinate neither ask nor answer, and
    points that no other is apart from have no row. Numbers must differ. An empty table gives an empty one. slab: points of a box, about.
    """
    sound = points.where(F.col("p").isNotNull() & (F.size("p") > 0) & F.forall("p", lambda v: v.isNotNull() & (v - v == 0)))
    return _neighbours_of(materialised(sound.select(F.col("i").cast("long").alias("i"), F.col("p").cast("array<double>").alias("p")), True), apart, slab)


def _neighbours_of(points: DataFrame, apart: int, slab: int) -> DataFrame:
    """The same for points in files, all of them sound."""
    apart = max(0, apart)
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], FOUND)
    # neighbours in time may fill most of a box, so boxes are larger than they are many
    size = max(slab, min(8 * apart, 1 << 16))
    rate = max(1, size // DRAWN)
    sample = (points.where(F.pmod(F.xxhash64("i"), F.lit(rate)) == 0) if n > size else points.limit(1)).orderBy("i").toArrow()
    drawn = _cloud(sample.column("p"), len(sample)) if len(sample) else np.zeros((0, 1))
    boxes = Boxes(drawn, _numbers(sample.column("i")), max(1, size // rate))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(boxes.place(_cloud(b.column(1), b.num_rows), _numbers(b.column(0))))], ["i", "p", "box"])

    dealt = points.select("i", "p").mapInArrow(place, "i long, p array<double>, box int")

    def own(t: pa.Table) -> pa.Table:
        cloud, numbers, home = _cloud(t.column("p"), len(t)), _numbers(t.column("i")), t.column("box")[0].as_py()
        j, d = _nearest(cloud, numbers, cloud, numbers, apart)
        pairs = [(at, np.full(len(at), box, np.int32)) for box, at in boxes.met(cloud, d) if box != home]
        who, where = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        count = np.bincount(who, minlength=len(t))
        # only a point that asks takes its coordinates along
        asks, m = count > 0, cloud.shape[1]
        p = _lists(cloud[asks].ravel(), asks * m, ~asks)
        return pa.table([pa.array(numbers), pa.array(j), pa.array(d), p, _lists(where[np.argsort(who, kind="stable")], count)], ["i", "j", "d", "p", "asked"])

    bounded = materialised(dealt.groupBy("box").applyInArrow(own, f"{FOUND}, p array<double>, asked array<int>"), True)
    asking = bounded.where(F.size("asked") > 0)

    def answer(cells: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(cells) or not len(asks):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["i", "j", "d"])
        i, far = _numbers(asks.column("i")), _numbers(asks.column("d"))
        j, d = _nearest(_cloud(cells.column("p"), len(cells)), _numbers(cells.column("i")), _cloud(asks.column("p"), len(asks)), i, apart, far)
        near = (j >= 0) & (d <= far)
        return pa.table([pa.array(i[near]), pa.array(j[near]), pa.array(d[near])], ["i", "j", "d"])

    asks = asking.select("i", "d", "p", F.explode("asked").alias("box"))
    answers = dealt.groupBy("box").cogroup(asks.groupBy("box")).applyInArrow(answer, FOUND)
    several = asking.select("i", "j", "d").where("j >= 0").unionByName(answers).groupBy("i").agg(F.min(F.struct("d", "j")).alias("b"))
    return bounded.where((F.size("asked") == 0) & (F.col("j") >= 0)).select("i", "j", "d").unionByName(several.select("i", F.col("b.j").alias("j"), F.col("b.d").alias("d")))


def _ranged(rows: DataFrame, number: str, more: int, least: int = RANGE) -> DataFrame:
    """rows by ranges of their number, each with the first `more` rows of the next range as well."""
    size = max(least, more + 1)
    own = F.floor(F.col(number) / size).cast("long")
    return rows.withColumn("__range", F.explode(F.when((F.col(number) % size < more) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))


def embedded(df: DataFrame, x: str, series: Series, m: int = 3) -> DataFrame:
    """(i, p): for one series without keys the m values from the i-th on; numbers and later values run in ranges of the order."""
    from pyspark.sql import Window

    rows = numbered(df.select(*series.order, F.col(f"`{x}`").cast("double").alias("__x")), series, "__i").select("__i", "__x")
    w = Window.partitionBy("__range").orderBy("__i")
    later = [F.lead("__x", k).over(w) if k else F.col("__x") for k in range(m)]
    made = _ranged(rows, "__i", m - 1).select(F.col("__i").alias("i"), F.array(*later).alias("p"), (F.lead("__i", m - 1).over(w) if m > 1 else F.col("__i")).alias("__end"), "__range")
    return made.where(F.col("__end").isNotNull() & (F.floor(F.col("i") / max(RANGE, m)) == F.col("__range"))).select("i", "p")


def _packed(j: np.ndarray, path: np.ndarray) -> bytes:
    """Numbers and paths, compressed; where values repeat, as their list and places in it."""
    different, place = np.unique(path, return_inverse=True)
    few = len(different) <= min(1 << 16, path.size // 4)
    if few:
        planes = place.reshape(path.shape).T.astype("<u2").ravel().view(np.uint8).reshape(-1, 2).T
        values = different.astype("<f8").tobytes() + np.ascontiguousarray(planes).tobytes()
    else:
        values = path.astype("<f8").tobytes()
    return zstandard.compress(np.array([len(j), len(different) if few else -1], "<i8").tobytes() + j.astype("<i8").tobytes() + values, 1)


def _unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    n, few = np.frombuffer(raw, "<i8", 2).tolist()
    j, at = np.frombuffer(raw, "<i8", n, 16), 16 + 8 * n
    if few < 0:
        return j, np.frombuffer(raw, "<f8", offset=at).reshape(n, width)
    different = np.frombuffer(raw, "<f8", few, at)
    planes = np.frombuffer(raw, np.uint8, offset=at + 8 * few).reshape(2, -1)
    return j, different[planes[0] + (planes[1].astype(np.int64) << 8)].reshape(width, n).T


def _logs_of_parting(points: DataFrame, pairs: DataFrame, m: int, fit: int) -> dict[int, tuple[float, int]]:
    """step -> (sum, count) of the log distance so many steps after each pair (i, j) of points.

    Ranges of i and of j meet by two groupings: the first puts the values of i's path beside each pair and packs them by j's range, the second has those of j.
    """
    width = fit + m - 1
    size = max(PATHS, width)
    last = points.agg(F.max("i")).first()[0]

    def paths(t: pa.Table) -> tuple[int, np.ndarray]:
        """The range's first number and the values from each number on, as views; what lies behind the series is missing."""
        order = np.argsort(_numbers(t.column("i")))
        x = t.column("x").to_numpy().astype(float)[order]
        tail = t.column("tail").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return int(_numbers(t.column("i"))[order[0]]), np.lib.stride_tricks.sliding_window_view(np.concatenate([x, tail, np.full(width, np.nan)]), width)

    def send(series: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        if len(series) and len(asks):
            first, values = paths(series)
            i, j = _numbers(asks.column("i")), _numbers(asks.column("j"))
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            ends = np.flatnonzero(np.diff(j // size, prepend=-1, append=-1))
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                for at in range(low, high, PACK):
                    end = min(high, at + PACK)
                    out.append((int(j[at] // size), _packed(j[at:end], values[i[at:end] - first])))
        return pa.table([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["__range", "packed"])

    def add(series: pa.Table, packs: pa.Table) -> pa.Table:
        total, count = np.zeros(fit), np.zeros(fit, np.int64)
        if len(series) and len(packs):
            first, values = paths(series)
            for pack in packs.column("packed"):
                j, path = _unpacked(pack.as_py(), width)
                gap = (path - values[j - first]) ** 2
                d = np.sqrt(sum(gap[:, c : c + fit] for c in range(m)))
                far = d > 1e-12
                total += np.log(d, out=np.zeros_like(d), where=far).sum(0)
                count += far.sum(0)
        return pa.table([pa.array(np.arange(fit)), pa.array(total), pa.array(count)], ["s", "total", "n"])

    values = points.select("i", F.get("p", F.lit(0)).alias("x"), F.when(F.col("i") == last, F.slice("p", 2, m - 1)).alias("tail"))

    def ranged() -> DataFrame:
        return _ranged(values, "i", width - 1, PATHS).groupBy("__range")

    of_i = pairs.withColumn("__range", F.floor(F.col("i") / size).cast("long")).groupBy("__range")
    packed = materialised(ranged().cogroup(of_i).applyInArrow(send, "__range long, packed binary"), True)
    sums = ranged().cogroup(packed.groupBy("__range")).applyInArrow(add, "s long, total double, n long")
    return {r["s"]: (r["total"], r["n"]) for r in sums.groupBy("s").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}


def lyapunov_by_data(df: DataFrame, x: str, series: Series, dt: float = 1.0, m: int = 3, theiler: int = 10, steps: int = 30, fit: int = 15, slab: int = SLAB) -> float | None:
    """The largest exponent of one series of any length: how fast neighbours that are apart in time part, as the slope of the mean log distance over the first `fit` steps.

    None for series of fewer than 50 points that have `steps` more behind them.
    """
    points = materialised(embedded(df, x, series, m), True)
    last = points.agg(F.max("i")).first()[0]
    n = 0 if last is None else last + 1 - steps
    if n < 50:
        return None
    sound = points.where((F.col("i") < n) & F.forall("p", lambda v: v.isNotNull() & (v - v == 0)))
    found = _logs_of_parting(points, materialised(_neighbours_of(sound, theiler, slab).select("i", "j"), True), m, fit)
    logs = [total / count if count else 0.0 for total, count in (found.get(s, (0.0, 0)) for s in range(fit))]
    return float(np.polyfit(np.arange(fit) * dt, logs, 1)[0])


__all__ = ["embedded", "lyapunov_by_data", "nearest_neighbours_apart"]
