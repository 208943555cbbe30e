"""Jaccard self-join of documents on word shingles by multiple-global-order filtering.

Two sets with 100 * |A and B| >= 75 * |A or B| share tokens among the first n - ceil(3n/4) + 1 of each under any
global order. Three orders are used: all rank tokens by how common they are (rarest first) and differ in the hash
that ranks equals. Sets that share prefix tokens under the first order are brought together by a shuffle. Of these pairs
only those whose prefixes under the second and the third order share enough tokens too are candidates; prefixes of
these orders are 32-bit prints, so a chance equality can only let a pair pass. Only candidates' whole sets are fetched and
compared. How common a token is comes from a sketch of fixed size over all documents, and only steers the order: no result
depends on it.

Sets are identified by a signature of 64 bits, so copies of a set are one entity (among d documents d**2 / 2**65 pairs of different
sets are expected to share one). Pairs are never listed by token. A linear round first compares each set with its
neighbours in lists sorted by a min-hash and with the set that shares most with a list, and joins what links into components, so that
a large group of near copies costs a few comparisons a member; a second round compares what is left outside the largest component
of a group with its likeliest partners. The last round takes every pair of sets of different components that share enough
prefix tokens: tokens that belong mostly to one component form a group, in which that component's sets meet only the
others. So no link is lost that could change a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.components import components
from galena.llm.packing import gathered, pack, release, runs, unpack
from galena.llm.session import forget, fresh, shuffle_width, written
from galena.llm.vectext import batch_words, mix, shingle_sets, sums_by

BLOCK_BYTES = 4 << 20
CELLS, CHUNKS, SPREAD = 1 << 23, 32, 32
ORDERS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Prefix tokens of either side of a group that meet at once, and rows of a token that are sorted at once in a linear round.
GROUP_BLOCK, LIST_BLOCK = 4096, 1024
#: The rounds before the one that takes all pairs: whether they are linear. And how many partners a set is compared with in each.
FIRST_ROUNDS, PARTNERS = (True, False), 3
#: Up to so many ids an id list goes to every executor; beyond, it is joined by a shuffle.
MOST_BROADCAST_IDS = 2_000_000


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def order_keys(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Keys whose rising order is the order: the level of commonness, then a hash of the token."""
    level = levels[(tokens & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(58)) | (mix(tokens ^ ORDERS[order]) >> np.uint64(6))


def _sets(table: pa.Table, text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' shingles, where each document's begin, and each document's signature."""
    tokens, first = shingle_sets(batch_words(table.column(text)))
    n = np.diff(first).astype(np.uint64)
    one, two = sums_by(first, lambda a, b: mix(tokens[a:b])), sums_by(first, lambda a, b: mix(tokens[a:b] + ORDERS[2]))
    return tokens, first, mix(one ^ mix(two + n)).view(np.int64)


SURVEYED = "doc_id long, entity long, n int, chunk int, body binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its set's signature and size, and the task's share of the sketch."""
    counts = np.zeros(CELLS, np.uint32)
    names = ["doc_id", "entity", "n", "chunk", "body"]
    for table in gathered(batches, BLOCK_BYTES):
        tokens, first, sign = _sets(table, 1)
        cells = np.sort((tokens & np.uint64(CELLS - 1)).astype(np.uint32))
        at = runs(cells)
        if len(cells):
            counts[cells[at[:-1]]] += np.diff(at).astype(np.uint32)
        rows = len(sign)
        yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(sign), pa.array(np.diff(first).astype(np.int32)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        del table, tokens, cells
        release()
    if counts.any():
        step = CELLS // CHUNKS
        parts = [pack(counts[i * step : (i + 1) * step], 6) for i in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = unpack(body, 6)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    totals = pa.array([int(x.sum()) for x in sums.values()], pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(x, 6) for x in sums.values()], pa.binary()), totals], ["chunk", "body", "total"])


def levels_of(counts: np.ndarray, mean: float) -> np.ndarray:
    """0 for cells that hold no more than chance explains, then two steps a doubling of the excess: a byte for each cell."""
    chance = 4 * mean**0.5 + 4
    excess = counts.astype(float) - mean
    return np.where(excess > chance, np.clip(np.floor(2 * np.log2(np.maximum(excess, chance) / chance)) + 1, 1, 63), 0).astype(np.uint8)


def _levels(mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pack(levels_of(unpack(x, 6), mean).astype(np.uint64), 1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["chunk", "body"])

    return run


def _sketch(survey: DataFrame) -> Broadcast:
    """The level of each of CELLS cells, 8 MiB in all whatever the input, on every executor."""
    spark = survey.sparkSession
    parts = survey.where("chunk is not null").select("chunk", "body", F.pmod(F.xxhash64("body"), F.lit(SPREAD)).alias("salt"))
    # in two steps: however many tasks there are, no one adds the sketches of all
    sums = parts.repartition(shuffle_width(spark), "chunk", "salt").select("chunk", "body").mapInArrow(_add_chunks, "chunk int, body binary, total long")
    sums = sums.select("chunk", "body").repartition(CHUNKS, "chunk").mapInArrow(_add_chunks, "chunk int, body binary, total long")
    sums = written(sums, "sketch")
    total = sums.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    levels, step = np.zeros(CELLS, np.uint8), CELLS // CHUNKS
    for chunk, body in sums.mapInArrow(_levels(total / CELLS), "chunk int, body binary").collect():
        levels[chunk * step : (chunk + 1) * step] = unpack(body, 1)
    forget(sums)
    return spark.sparkContext.broadcast(levels)


def _prefixes(levels: Broadcast, buckets: int):
    """The first order's prefix tokens with their entities, dealt into buckets; common tokens apart (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BLOCK_BYTES):
            tokens, first, sign = _sets(table, 0)
            _, once = np.unique(sign, return_index=True)  # copies in a block are one
            keys = order_keys(tokens, levels.value, 0)
            n = np.diff(first)
            take = prefix_length(n)
            parts, owners = [], []
            for i in once.tolist():
                if n[i]:
                    own = keys[first[i] : first[i + 1]]
                    own.sort()
                    parts.append(own[: take[i]])
                    owners.append(i)
            if not parts:
                continue
            entity = np.repeat(sign[owners], [len(p) for p in parts])
            keys = np.concatenate(parts)
            where = np.where(keys >> np.uint64(58) > 0, -1, (mix(keys) % np.uint64(buckets)).astype(np.int64))
            short = keys & np.uint64(2**48 - 1)
            order = np.argsort((where + 1).astype(np.uint64) << np.uint64(48) | short)
            where, short, keys, entity = where[order], short[order], keys[order], entity[order]
            at, out = runs(where), []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                common = where[i] < 0
                body = pack(keys[i:j]) if common else pack(short[i:j], 6, True)
                out.append((int(where[i]) if not common else -1 - int(keys[i] % np.uint64(buckets)), body, pack(entity[i:j].view(np.uint64))))
            b, body, more = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(body, pa.binary()), pa.array(more, pa.binary())], ["bucket", "body", "more"])
            del table, tokens, keys, parts, entity, short, where, order
            release()

    return run


def _shared(buckets: int):
    """(token, entity) of tokens that more than one entity has; common tokens pass as they are."""

    def flush(bucket: int, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys = np.concatenate([unpack(b, 6, True) for b, _ in rows])
        entity = np.concatenate([unpack(m) for _, m in rows])
        order = np.lexsort((entity, keys))
        keys, entity = keys[order], entity[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (entity[1:] != entity[:-1])
        keys, entity = keys[new], entity[new]
        size = np.diff(runs(keys))
        keep = np.repeat(size > 1, size)
        token = mix(keys[keep] * np.uint64(2 * buckets + 1) + np.uint64(bucket))
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(entity[keep].view(np.int64))], ["token", "entity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, body, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(body).view(np.int64)), pa.array(unpack(more).view(np.int64))], ["token", "entity"])
                    continue
                if bucket is not None and b != bucket:
                    yield flush(bucket, held)
                    held = []
                bucket = b
                held.append((body, more))
        if held:
            yield flush(bucket, held)

    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, BLOCK_BYTES):
        tokens, first, sign = _sets(table, 0)
        raw = tokens.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], ["entity", "tokens"])
        del table, tokens, raw
        release()


def _other_prefixes(levels: Broadcast):
    """(entity, n, prints): the prints of each set's prefixes under all orders but the first, in rising order, one order after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BLOCK_BYTES):
            tokens, first, sign = _sets(table, 0)
            n = np.diff(first)
            take = prefix_length(n)
            some = np.flatnonzero(n).tolist()
            keys = [order_keys(tokens, levels.value, order) for order in range(1, len(ORDERS))]
            prints = []
            for i in some:
                own = []
                for k in keys:
                    part = np.partition(k[first[i] : first[i + 1]], take[i] - 1)[: take[i]].astype(np.uint32)  # the low bits: of the hash alone
                    part.sort()
                    own.append(part.tobytes())
                prints.append(b"".join(own))
            yield pa.RecordBatch.from_arrays([pa.array(sign[some]), pa.array(n[some].astype(np.int32)), pa.array(prints, pa.binary())], ["entity", "n", "prints"])
            del table, tokens, keys, prints
            release()

    return run


def passes(x: np.ndarray, y: np.ndarray, m: int, n: int) -> bool:
    """Whether sets of m and n tokens with the prints x and y share enough of their prefixes under every order but the first."""
    if 4 * min(m, n) < 3 * max(m, n):
        return False
    need = int(least_shared(np.int64(m), np.int64(n)))
    for a, b in zip(np.split(x, len(ORDERS) - 1), np.split(y, len(ORDERS) - 1), strict=True):
        both = np.concatenate([a, b])
        both.sort()
        # a print that stands twice in one prefix counts once too often, which only lets more pass
        if int((both[1:] == both[:-1]).sum()) < need:
            return False
    return True


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (rising tokens) are similar enough."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= 75 * (len(both) - shared)


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, m, n, x, y) as the pairs (a, b) that pass the other orders."""
    for batch in batches:
        m, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [passes(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), i, j) for x, y, i, j in zip(batch.column(4), batch.column(5), m, n, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) as the pairs (a, b) whose whole sets link."""
    for batch in batches:
        keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """docs whose id is (left_semi) or is not (left_anti) in ids: a list of checked size goes out whole, a longer one is shuffled."""
    at = fresh(docs, "id")
    ids = ids.toDF(at)
    side = F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids.hint("merge")
    return docs.join(side, docs[id_col] == side[at], how)


def least_shared(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The prefix tokens that sets of m and n tokens must share if they link.

    Beyond its prefix a set of n has ceil(3n/4) - 1 tokens, so with c shared prefix tokens the overlap is c + max of these at
    most; a link needs an overlap of ceil(3(m+n)/7).
    """
    return (3 * (m + n) + 6) // 7 - (3 * np.maximum(m, n) + 3) // 4 + 1


def _counter(at: np.ndarray, col: np.ndarray, entities: int, tokens: int, right: np.ndarray):
    """A function from entities x to the numbers of tokens that each shares with each of `right`."""
    if entities * tokens <= 1 << 20:
        has = np.zeros((entities, tokens), np.float32)
        has[at, col] = 1
        ours = has[right].T
        return lambda x: has[x] @ ours
    place = np.full(entities, -1)
    place[right] = np.arange(len(right))
    order = np.argsort(col, kind="stable")
    order = order[place[at[order]] >= 0]
    lists = np.split(place[at[order]], np.searchsorted(col[order], np.arange(1, tokens)))
    order = np.argsort(at, kind="stable")
    own = np.split(col[order], np.searchsorted(at[order], np.arange(1, entities)))
    return lambda x: np.stack([np.bincount(np.concatenate([lists[t] for t in own[e]]), minlength=len(right)) for e in x]).astype(np.float32)


def _meet(best: int | None):
    """Pairs (a, b, score) of entities of different components that share enough prefix tokens; of each b's in two blocks only the `best`, if given.

    Rows are sorted by (c, i, j), which name a group and two of its blocks.
    """
    names = ["c", "i", "j", "block", "token", "entity", "n", "root", "groups"]

    def meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = rows[0, 1], rows[0, 2]
        entities, first, at = np.unique(rows[:, 5], return_index=True, return_inverse=True)
        if len(entities) < 2:
            return
        tokens, col = np.unique(rows[:, 4], return_inverse=True)
        block, n, root, groups = (rows[first, k] for k in (3, 6, 7, 8))
        x_all, y = np.flatnonzero(block == j), np.flatnonzero(block == i)
        if not len(x_all) or not len(y):
            return
        count = _counter(at, col, len(entities), len(tokens), y)
        for begin in range(0, len(x_all), 256):
            x = x_all[begin : begin + 256]
            shared = count(x)
            m, k = n[x][:, None], n[y][None]
            # with c shared in all, one of the g groups that a set's tokens fall into has c / g of them
            need = least_shared(m, k) / np.minimum(groups[x][:, None], groups[y][None])
            good = (shared >= need) & (shared > 0) & (root[x][:, None] != root[y][None]) & (4 * np.minimum(m, k) >= 3 * np.maximum(m, k))
            if i == j and best is None:
                good &= entities[x][:, None] < entities[y][None]
            score = np.where(good, shared / np.maximum(m, k), -1)
            if best is not None and len(y) > best:
                good &= score >= np.partition(score, len(y) - best, axis=1)[:, len(y) - best, None]
                good &= np.cumsum(good, axis=1) <= best
            b, a = np.nonzero(good)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(entities[y[a]]), pa.array(entities[x[b]]), pa.array(score[b, a].astype(np.float64))], ["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(names)), np.int64)
        for batch in batches:
            table = np.column_stack([batch.column(k).to_numpy() for k in range(len(names))]).astype(np.int64)
            held = np.concatenate([held, table]) if len(held) else table
            changes = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(1)) + 1
            cuts = [0, *changes.tolist()]
            for p, q in zip(cuts, cuts[1:], strict=False):
                yield from meet(held[p:q])
            held = held[cuts[-1] :]
        if len(held):
            yield from meet(held)

    return run


def _contested(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, c, entity, n, root) of the tokens that entities of several components have; c: the component that most of them belong to."""
    found = groups.join(roots.withColumnRenamed("node", "entity"), "entity", "left")
    placed = found.select("token", "entity", "n", F.coalesce("root", "entity").alias("root"))
    held = placed.groupBy("token", "root").count()
    # of components that have as many of a token's entities the one with most rows, so that tokens of the same sets fall into one group
    weights = held.groupBy("root").agg(F.sum("count").alias("weight"))
    leaders = held.join(weights, "root").groupBy("token").agg(F.count("*").alias("many"), F.max_by("root", F.struct("count", "weight", "root")).alias("c")).where("many > 1").select("token", "c")
    return written(placed.join(leaders, "token"), "contested")


def _likely(rows: DataFrame, turn: int) -> DataFrame:
    """Some pairs (a, b) of contested entities in different components, a few for each entity, in time linear in the rows.

    Every token's entities are sorted by a min-hash of their contested tokens, a long list in ranges of it. Each is paired with the next one,
    and with the range's hub, the one whose tokens stand in the longest lists; pairs that come about through most tokens go first.
    """
    sizes = rows.groupBy("token").count()
    keys = rows.join(sizes, "token").groupBy("entity").agg(F.min(F.xxhash64(F.lit(turn), "token")).alias("key"), F.sum(F.round(F.log2("count"), 3)).alias("weight"))
    cuts = sizes.where(F.col("count") > LIST_BLOCK).select("token", F.ceil(F.col("count") / LIST_BLOCK).cast("int").alias("cuts"))
    # ranges of the key alone would leave those with equal keys together, so each has a place of its own near its key
    place = F.shiftrightunsigned(F.xxhash64("key"), 2) + F.pmod(F.xxhash64("entity"), F.lit(1 << 56))
    listed = rows.select("token", "entity", "n", "root").join(keys.select("entity", "weight", place.alias("place")), "entity").join(cuts, "token", "left")
    listed = listed.withColumn("cut", F.floor(F.col("place").cast("double") / F.lit(2.0**62 + 2.0**56) * F.coalesce("cuts", F.lit(1))))
    whole = Window.partitionBy("token", "cut")
    order = whole.orderBy("place", "entity")
    one = F.struct("entity", "n", "root")
    met = listed.select("entity", "n", "root", F.lead(one).over(order).alias("next"), F.max_by(one, F.struct("weight", "entity")).over(whole).alias("hub"))
    pairs = met.select("entity", "n", "root", F.explode(F.array("next", "hub")).alias("o"))
    pairs = pairs.where((F.col("root") != F.col("o.root")) & (4 * F.least("n", "o.n") >= 3 * F.greatest("n", "o.n")))
    return _best(pairs.groupBy("entity", F.col("o.entity").alias("other")).count(), "entity", "count", "other").select(F.least("entity", "other").alias("a"), F.greatest("entity", "other").alias("b")).distinct()


def _best(pairs: DataFrame, of: str, score: str, other: str) -> DataFrame:
    """The PARTNERS pairs of highest score of each `of`; an entity has few, a small number for each of its tokens or groups."""
    order = Window.partitionBy(of).orderBy(F.desc(score), other)
    return pairs.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= PARTNERS).drop("__rank")


def _pairs(rows: DataFrame, width: int, best: int | None) -> DataFrame:
    """Every pair (a, b) of contested entities in different components that share enough prefix tokens, or the `best` of each b outside its group's component.

    In a group c the entities of the component c meet only those of others. Either side is cut into blocks of about GROUP_BLOCK rows,
    and a task takes two blocks: blocks 0, 1, ... are the others, -1, -2, ... those of c.
    """
    spread = rows.groupBy("entity").agg(F.countDistinct("c").alias("groups"))
    mine = F.col("root") == F.col("c")
    cuts = lambda side: F.greatest(F.ceil(F.count_if(side) / F.lit(GROUP_BLOCK)), F.lit(1)).cast("int")
    sizes = written(rows.groupBy("c").agg(cuts(mine).alias("own"), cuts(~mine).alias("others")).where("own > 1 or others > 1"), "blocks")  # few: each of more than GROUP_BLOCK rows
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST_IDS else sizes
    rows = rows.join(spread, "entity").join(sizes, "c", "left").withColumns({"own": F.coalesce("own", F.lit(1)), "others": F.coalesce("others", F.lit(1))})
    at = F.xxhash64("entity")
    rows = rows.withColumn("block", F.when(mine, -1 - F.pmod(at, F.col("own"))).otherwise(F.pmod(at, F.col("others"))).cast("int"))
    # a block of others meets all blocks, itself included, each two once; one of c the others
    outer = F.sequence(F.lit(0), F.col("others") - 1)
    rows = rows.withColumn("other", F.explode(F.when(mine, outer).otherwise(F.concat(outer, F.sequence(-F.col("own"), F.lit(-1))))))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    fed = rows.select("c", "i", "j", "block", "token", "entity", "n", "root", "groups").repartition(width, "c", "i", "j").sortWithinPartitions("c", "i", "j")
    found = fed.mapInArrow(_meet(best), "a long, b long, score double")
    if best is not None:
        found = _best(found.groupBy("a", "b").agg(F.max("score").alias("score")), "b", "score", "a")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts_of(slim: DataFrame, entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """A text at least of every wanted entity: by the least id of its documents, or among the rows without an id."""
    ids = entities.join(wanted, "entity", "left_semi").where("doc_id is not null").select("doc_id")
    return only_ids(slim.where("doc_id is not null"), ids, "doc_id").select("text").unionByName(slim.where("doc_id is null").select("text"))


def _onto_pairs(pairs: DataFrame, table: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """pairs (a, b) with columns of `table` for either entity: {column: (name for a, name for b)}."""
    for k, end in enumerate(("a", "b")):
        pairs = pairs.join(table.select(F.col("entity").alias(end), *[F.col(c).alias(names[k]) for c, names in columns.items()]), end)
    return pairs.select("a", "b", *[n for names in columns.values() for n in names])


def _verified(slim: DataFrame, entities: DataFrame, others: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of entities that link: first by the prefixes under the other orders, then by whole sets."""
    both = _onto_pairs(pairs, others, {"n": ("m", "n"), "prints": ("x", "y")})
    left = written(both.mapInArrow(_filter, "a long, b long"), "candidates")
    wanted = left.select(F.col("a").alias("entity")).union(left.select("b")).distinct()
    sets = _texts_of(slim, entities, wanted).mapInArrow(_whole_sets, "entity long, tokens binary").dropDuplicates(["entity"])
    found = written(_onto_pairs(left, sets, {"tokens": ("x", "y")}).mapInArrow(_verify, "a long, b long"), "links")
    forget(left)
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, entity, n, component_id) of every row."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    width = shuffle_width(docs.sparkSession, slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    buckets = 4 * width
    survey = written(slim.mapInArrow(_survey, SURVEYED), "survey")
    rows = survey.where("chunk is null").select("doc_id", "entity", "n")
    levels = _sketch(survey)
    prefixes = slim.select("text").mapInArrow(_prefixes(levels, buckets), "bucket int, body binary, more binary")
    groups = prefixes.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(buckets), "token long, entity long")
    entities = written(rows.where("n > 0").groupBy("entity").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "entities")
    groups = written(groups.distinct().join(entities.select("entity", "n"), "entity"), "prefix-tokens")
    wanted = groups.select("entity").distinct()
    others = _texts_of(slim, entities, wanted).mapInArrow(_other_prefixes(levels), "entity long, n int, prints binary")
    others = written(others.dropDuplicates(["entity"]), "other-prefixes")
    levels.unpersist()
    edges, roots = None, entities.select(F.col("entity").alias("node"), F.col("entity").alias("root")).limit(0)
    for turn, linear in enumerate((*FIRST_ROUNDS, None)):
        contested = _contested(groups, roots)
        pairs = written(_likely(contested, turn) if linear else _pairs(contested, width, None if linear is None else PARTNERS), "pairs")
        found = _verified(slim, entities, others, pairs)
        forget(contested, pairs)
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges)
    forget(groups, others)
    whole = entities.join(roots.withColumnRenamed("node", "entity"), "entity", "left").withColumn("root", F.coalesce("root", "entity"))
    least = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = whole.join(least, "root").select("entity", "component_id")
    return rows.join(named, "entity", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, n_shingles long, component_id long) of every row.

    A set is the distinct five-word shingles of the text with A-Z lower-cased; fewer words are one shingle, no
    word (or a null text) an empty set, linked with nothing. Rows link at a Jaccard similarity of 0.75 or more;
    component_id is the smallest id that links reach. A row without an id links like any other, and others link over it; its
    component_id is that of those that it reaches, null if none has an id. Rows that repeat an id count each by its own text. Columns beside
    these two are not read. An empty table gives an empty one.
    """
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return _classes(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as its set's entity."""
    for table in gathered(batches, BLOCK_BYTES):
        last = table.num_columns - 1
        sign = _sets(table, last)[2]
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns[:-1]), pa.array(sign)], [str(i) for i in range(last + 1)])
        release()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that link, directly or over others, to a smaller id; rows without an id stay.

    Rows that repeat an id are judged each by its own text; rows alike in id and set stay or go together. An empty table gives an empty one.
    """
    found = written(_classes(docs, id_col, text_col), "near-duplicates")
    gone = (F.col("n") > 0) & (F.col("doc_id") != F.col("component_id"))
    by_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(gone).alias("some"), F.min(gone).alias("all"))
    by_id = written(by_id.where("some"), "gone")
    out = only_ids(docs, by_id.select("doc_id"), id_col, "left_anti")
    mixed = by_id.where("not all").select("doc_id")
    if mixed.isEmpty():
        return out
    # ids of which one row goes and another stays: these few rows are told apart by their sets
    at, entity = fresh(docs, "id"), fresh(docs, "entity")
    lost = found.where(gone).select(F.col("doc_id").alias(at), F.col("entity").alias("lost")).distinct()
    some = only_ids(docs, mixed, id_col).withColumn(entity, F.col(f"`{text_col}`").cast("string"))
    some = some.mapInArrow(_entities, docs.select(*[F.col(f"`{c}`") for c in docs.columns]).schema.add(entity, "long"))
    some = some.join(lost, (some[id_col] == lost[at]) & (some[entity] == lost["lost"]), "left_anti")
    return out.unionByName(some.drop(entity))
