"""Exact deduplication over a cuckoo-filter index of live digests.

Two texts are equal when they are identical after lower-casing A-Z. The index of a partition holds the
digest of one live row per text; a later row with a larger id takes its place, which deletes one digest and
inserts another. Every hit of the filter is verified against the bucket's stored content key (SHA-256 and
byte length); a full table is rebuilt at twice the size from the stored keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.session import fresh, lower_ascii, shuffle_width, written

SLOTS = 4
KICKS = 200


class CuckooIndex:
    """A cuckoo filter whose slots also hold the content key and a payload, so that hits can be verified.

    A key is bytes of at least 16; a fingerprint is 16 bits of it, and either of two buckets may hold it.
    """

    def __init__(self, buckets: int = 64) -> None:
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.table: list[list[list]] = [[] for _ in range(self.mask + 1)]
        self.live = 0
        self.resized = 0

    @staticmethod
    def _mark_home(key: bytes) -> tuple[int, int]:
        """The fingerprint and the unmasked home bucket; of all of the key, so keys that differ anywhere spread."""
        h = int.from_bytes(blake2b(key, digest_size=8).digest(), "big")
        return h & 0xFFFF or 1, h >> 16

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def get(self, key: bytes) -> list | None:
        """The live entry [mark, key, payload] of the key: the filter's marks first, the content after."""
        mark, home = self._mark_home(key)
        home &= self.mask
        for bucket in (home, self._other(home, mark)):
            for entry in self.table[bucket]:
                if entry[0] == mark and entry[1] == key:
                    return entry
        return None

    def insert(self, key: bytes, payload: object) -> None:
        self._place([self._mark_home(key)[0], key, payload])
        self.live += 1

    def delete(self, key: bytes) -> bool:
        mark, home = self._mark_home(key)
        home &= self.mask
        for bucket in (home, self._other(home, mark)):
            for i, entry in enumerate(self.table[bucket]):
                if entry[0] == mark and entry[1] == key:
                    self.table[bucket].pop(i)
                    self.live -= 1
                    return True
        return False

    def _place(self, entry: list) -> None:
        home = self._mark_home(entry[1])[1] & self.mask
        for bucket in (home, self._other(home, entry[0])):
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(entry)
                return
        bucket = home
        for kick in range(KICKS):
            full = self.table[bucket]
            entry, full[kick % SLOTS] = full[kick % SLOTS], entry
            bucket = self._other(bucket, entry[0])
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(entry)
                return
        self._grow(entry)

    def _grow(self, left: list) -> None:
        entries = [left, *self.entries()]
        self.mask = 2 * self.mask + 1
        self.table = [[] for _ in range(self.mask + 1)]
        self.resized += 1
        for entry in entries:
            self._place(entry)

    def entries(self) -> Iterator[list]:
        for bucket in self.table:
            yield from bucket


def _live_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (digest, id, n, salt): one row for each digest and salt, with the largest id and the sum of n."""
    index: CuckooIndex | None = None
    for batch in batches:
        if index is None:
            index = CuckooIndex(max(64, batch.num_rows // 2))
        digests, ids, counts, salts = (batch.column(i).to_pylist() for i in range(4))
        for digest, row, n, salt in zip(digests, ids, counts, salts, strict=True):
            key = digest + salt.to_bytes(4, "big", signed=True)
            found = index.get(key)
            if found is None:
                index.insert(key, (row, n))
                continue
            live, seen = found[2]
            if row is not None and (live is None or row > live):
                index.delete(key)
                index.insert(key, (row, seen + n))
            else:
                found[2] = (live, seen + n)
    part: list[tuple] = []
    for _, key, (row, n) in index.entries() if index else ():
        part.append((key[:-4], row, n, int.from_bytes(key[-4:], "big", signed=True)))
        if len(part) == 20_000:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    digests, ids, counts, salts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(salts, pa.int32())], ["__digest", "__id", "__n", "__salt"])


LIVE = "__digest binary, __id long, __n long, __salt int"


#: What a live digest takes in an index, so that a task's index stays small at any number of rows.
ENTRY_BYTES = 256
NAMES = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 (or other names for these four).

    Null text counts as empty. The largest id of a group stays; a null id never beats another, and a group of
    null ids keeps all its rows (keep_id null). Rows repeated with the same id and text count as one document and
    stay or go together. Extra columns pass through, but for those of the four names. An empty table gives an
    empty one.

    A text's rows are first gathered in salted parts, so the rows of one text, be it a third of all, spread over
    many tasks; only (digest, salt) rows meet in the second step, and results go back along the salt. There are
    as many salts as the square root of the rows, so neither step brings more than that of one text together.
    """
    spark = docs.sparkSession
    sha, salt = fresh(docs, "own_sha"), fresh(docs, "own_salt")
    text = lower_ascii(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    content = docs.withColumn(sha, F.unhex(F.sha2(text.cast("binary"), 256)))
    slim = written(content.select(F.col(sha).alias("__digest"), F.col(f"`{id_col}`").cast("long").alias("__id"), F.octet_length(text).cast("long").alias("__bytes")), "digests")
    rows = slim.count()
    parts = salts or math.isqrt(rows) + 1
    spread = F.pmod(F.xxhash64(F.col("__id")), F.lit(parts)).cast("int")
    # the content key that verifies a hit: the digest, then the length
    key = F.concat(F.col("__digest"), F.unhex(F.lpad(F.hex("__bytes"), 16, "0")))
    width = shuffle_width(spark, rows * ENTRY_BYTES)
    local = slim.select(key.alias("__digest"), "__id", F.lit(1).cast("long").alias("__n"), spread.alias("__salt"))
    local = local.repartition(width, "__digest", "__salt").mapInArrow(_live_rows, LIVE)
    local = written(local, "live")
    whole = local.withColumn("__salt", F.lit(0)).repartition(width, "__digest").mapInArrow(_live_rows, LIVE)
    whole = whole.select("__digest", F.col("__id").alias("__keep"), F.col("__n").alias("__size"))
    # every digest and salt has one row, so neither side of this join has a hot key but for the salts of one text
    back = local.select("__digest", "__salt").join(whole, "__digest").select(F.substring("__digest", 1, 32).alias("__digest"), "__salt", "__keep", "__size")
    left = content.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long")), F.lit(parts)).cast("int"))
    joined = left.join(back, (left[sha] == back["__digest"]) & (left[salt] == back["__salt"]), "inner")
    kept = F.coalesce(F.col(f"`{id_col}`").cast("long") == F.col("__keep"), F.col("__keep").isNull())
    clash = {x.lower() for x in names}
    return joined.select(
        *[docs[c] for c in docs.columns if c.lower() not in clash],
        F.col("__keep").alias(names[0]), F.col("__size").alias(names[1]), kept.alias(names[2]), F.lower(F.hex(F.col(sha))).alias(names[3]),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with docs' own columns."""
    names = tuple(fresh(docs, x) for x in NAMES)
    return exact_groups(docs, id_col, text_col, names=names).where(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
