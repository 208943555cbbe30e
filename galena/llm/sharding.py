"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Source buckets hold n_p rows each and shard s is to hold c_s rows. The matrix of how many rows go from p to s
is drawn from the exact multivariate hypergeometric law (what a uniform permutation of all rows would give),
each bucket is permuted by itself and cut at its row of the matrix, the pieces are exchanged, and every shard
is permuted again for its slots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.session import fresh

#: Bounds the matrix that the driver draws, and the ranges of a shard; beyond, buckets and ranges grow, and their sorts spill.
MOST_BUCKETS = 1 << 16


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """[bucket, shard] counts: row sums are `rows`, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(rows)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        pool, draw = int(left.sum()), n
        for s in range(shards):
            here = int(left[s])
            pool -= here
            got = _hypergeometric(rng, here, pool, draw)
            out[p, s] = got
            draw -= got
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """How many of `draw` balls are good, by the inverse of the whole law: its terms follow from their ratios, outwards from the mode.

    Terms beyond forty standard deviations vanish in double precision and are left out, so a draw costs some eighty deviations at any size of the urn.
    """
    low, high = max(0, draw - bad), min(draw, good)
    if low == high:
        return low
    mode = min(high, max(low, (draw + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = 20 + int(40 * (draw * share * (1 - share)) ** 0.5)
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    rise = np.cumsum(np.log((good - up) / (up + 1) * ((draw - up) / (bad - draw + up + 1))))
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    fall = np.cumsum(np.log(down / (good - down + 1) * ((bad - draw + down) / (draw - down + 1))))
    law = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    total = np.cumsum(law)
    return mode - len(down) + int(np.searchsorted(total, rng.random() * total[-1], "right"))


def shuffle_into_shards(df: DataFrame, id_col: str, shards: int, seed: int = 17, rows_per_bucket: int = 20_000, tie: Column | None = None) -> DataFrame:
    """df with `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard), a uniform shuffle under the law `rows`.

    All placements follow from the id, the seed and the counts, so a lost executor's tasks give the same rows
    again. Rows with the same id are told apart by `tie` (further columns' hash); rows alike in both are
    interchangeable. Null ids form one value like any other. An empty table gives an empty one; df's own
    columns of the names shard and slot are replaced.
    """
    keep = [c for c in df.columns if c.lower() not in {"shard", "slot"}]
    src, h1, h2, rank, fine, many, id_at, tie_at = (fresh(df, x) for x in ("bucket", "first", "second", "rank", "fine", "bounds", "own_id", "own_tie"))
    key = F.xxhash64(F.col(f"`{id_col}`"), tie) if tie is not None else F.xxhash64(F.col(f"`{id_col}`"))
    keyed = df.select(*[F.col(f"`{c}`") for c in keep], key.alias(src), F.col(f"`{id_col}`").alias(id_at), (F.lit(0) if tie is None else tie).alias(tie_at))
    total = df.count()
    buckets = min(MOST_BUCKETS, max(1, -(-total // rows_per_bucket)))
    place = lambda salt: F.xxhash64(F.lit(salt), F.lit(seed), F.col(src))
    same = [F.col(id_at), F.col(tie_at)]  # rows whose keys are equal by chance still have one order
    keyed = keyed.withColumns({h1: place(1), h2: place(2)}).withColumn(src, F.pmod(place(0), F.lit(buckets)).cast("int"))
    sizes = {r[0]: r[1] for r in keyed.groupBy(src).count().collect()}  # one number a bucket
    matrix = communication_matrix([sizes.get(p, 0) for p in range(buckets)], shards, seed)
    spark = df.sparkSession
    cuts = spark.createDataFrame([(p, row) for p, row in enumerate(np.cumsum(matrix, 1).tolist())], f"{src} int, {many} array<long>")
    first = Window.partitionBy(src).orderBy(h1, h2, *same)
    cut = keyed.withColumn(rank, F.row_number().over(first) - 1).join(F.broadcast(cuts), src)
    cut = cut.withColumn("shard", F.size(F.filter(F.col(many), lambda x: x <= F.col(rank))).cast("int")).drop(many, rank)
    # the second permutation by ranges of its key, so that a shard of any size is many small sorts
    ranges = max(1, -(-total // (shards * rows_per_bucket)))
    ranges = min(MOST_BUCKETS // max(1, min(shards, MOST_BUCKETS)) or 1, ranges)
    step = 2**64 // ranges
    cut = cut.withColumn(fine, F.least(F.lit(ranges - 1), F.floor((F.col(h2).cast("double") + F.lit(float(2**63))) / F.lit(float(step)))).cast("int"))
    # counts by shard and range
    part = {(r[0], r[1]): r[2] for r in cut.groupBy("shard", fine).count().collect()}
    starts, rows = {}, []
    for s, f in sorted(part):
        rows.append((s, f, starts.get(s, 0)))
        starts[s] = starts.get(s, 0) + part[s, f]
    base = spark.createDataFrame(rows, f"shard int, {fine} int, {many} long")
    second = Window.partitionBy("shard", fine).orderBy(h2, h1, *same)
    done = cut.withColumn(rank, F.row_number().over(second) - 1).join(F.broadcast(base), ["shard", fine])
    return done.select(*[F.col(f"`{c}`") for c in keep], "shard", (F.col(rank) + F.col(many)).cast("long").alias("slot"))
