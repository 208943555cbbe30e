"""Ranked lexical search over a two-level quantised index.

Documents are dealt into blocks, and a block is one row of the index. Its first level holds, for every term, which of its documents have it and their
impacts in one byte, rounded up; its second level holds exact counts. A search adds up the bytes of a query's terms, which bounds every
document's score from above and, one step less a term, from below. Whatever document's upper bound reaches the kth best lower bound of
all documents is scored again in exact integers from the second level; nothing else is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.packing import gathered, pack, release, unpack
from galena.llm.session import forget, written

#: Bytes of text and documents of a block, bytes of a text that are cut into terms at once, queries that are answered in one pass.
BLOCK_BYTES, BLOCK_DOCS, SLICE, QUERIES = 8 << 20, 4096, 1 << 20, 1024
#: The largest impact of a term of weight one, and the width of a byte's step.
WHOLE = 1_000_000_000
STEP = -(-1_000_000 // 255)
TERM = rb"[0-9A-Za-z\x80-\xff]+"  # as bytes of UTF-8: the terms hold whole characters, for others stand below 0x80
_TERM, _GAP = re.compile(TERM), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: str | None) -> Counter:
    """How often each term stands in the whole text; only A-Z are lower-cased."""
    raw, out, at = (text or "").encode().lower(), Counter(), 0
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE and (gap := _GAP.search(raw, at + SLICE)):
            end = gap.start()
        out.update(_TERM.findall(raw, at, end))
        at = end
    return out


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The score of a term of weight one, below 1,000,000: tf of its documents' n terms, of `documents` with `total` terms."""
    m = 50 + 50 * n * documents // max(1, total)
    return WHOLE * tf // (1000 * tf + 20 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


_zip = zstandard.ZstdCompressor(level=1)
EXACT = "block long, doc_ids array<long>, lengths binary, vocabulary binary, df binary, rows binary, tfs binary"


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 33
    names, types = [c.split()[0] for c in EXACT.split(", ")], [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    for table in gathered(batches, BLOCK_BYTES):
        for at in range(0, table.num_rows, BLOCK_DOCS):
            part = table.slice(at, BLOCK_DOCS)
            vocabulary = _Numbers()
            ids, tfs, sizes, lengths = [], [], [], []
            for text in part.column(1):
                found = terms(text.as_py())
                ids.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                tfs.append(np.fromiter(found.values(), np.int64, len(found)))
                sizes.append(len(found))
                lengths.append(int(tfs[-1].sum()))
            ids, tfs, rows = np.concatenate(ids), np.concatenate(tfs), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(ids, kind="stable")
            df = np.bincount(ids, minlength=len(vocabulary))
            words = _zip.compress(b"\n".join(vocabulary))
            row = [block, part.column(0).to_pylist(), pack(np.array(lengths), 8), words, pack(df, 4), pack(rows[order], 2), pack(tfs[order], 4)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)
            block += 1
    release()


class _Numbers(dict):
    """Numbers new keys in order."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _quantise(documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = []
            for lengths, rows, tfs in zip(*(batch.column(c) for c in ("lengths", "rows", "tfs")), strict=True):
                n, rows, tf = (unpack(x.as_py(), w).view(np.int64) for x, w in ((lengths, 8), (rows, 2), (tfs, 4)))
                level.append(pack(-(-impacts(tf, n[rows], documents, total) // STEP), 1))
            yield batch.append_column("bytes", pa.array(level, pa.binary()))

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(the index, N, L): a row for each block of documents, the number of documents with a term, and of all their terms.

    Every document is indexed, with its whole text; null and empty texts hold no term. The index is written; df is a term's documents in the block.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    exact = written(slim.mapInArrow(_collect, EXACT), "postings")
    documents, total = exact.select("lengths").mapInArrow(_totals, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    documents, total = documents or 0, total or 0
    index = written(exact.mapInArrow(_quantise(documents, total), f"{EXACT}, bytes binary"), "index")
    forget(exact)
    return index, documents, total


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for batch in batches:
        for data in batch.column(0):
            n = unpack(data.as_py(), 8)
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], ["documents", "total"])


def _words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []


def _frequencies(wanted: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for words, df in zip(batch.column(0), batch.column(1), strict=True):
                df = unpack(df.as_py(), 4)
                for i, w in enumerate(_words(words.as_py())):
                    if w in wanted:
                        seen[w] += int(df[i])
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], ["term", "df"])

    return run


class _Block:
    """One row of the index, as a search for `weights` (a dict from term to weight for each query) sees it."""

    def __init__(self, batch: pa.RecordBatch, i: int, vocabulary: frozenset, docs: int) -> None:
        self.get, self.docs = (lambda name: batch.column(name)[i].as_py()), docs
        df = unpack(self.get("df"), 4).view(np.int64)
        begin = np.concatenate([[0], np.cumsum(df)])
        self.at = {w: (begin[k], begin[k + 1]) for k, w in enumerate(_words(self.get("vocabulary"))) if w in vocabulary}
        self.rows = unpack(self.get("rows"), 2).view(np.int64)
        self.bytes = unpack(self.get("bytes"), 1).view(np.int64)

    def slices(self, query: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray] | None:
        """(places of the postings of the query's terms, the weight of each)."""
        found = [(*self.at[w], v) for w, v in query.items() if w in self.at]
        if not found:
            return None
        places = np.concatenate([np.arange(a, b) for a, b, _ in found])
        return places, np.repeat([v for *_, v in found], [b - a for a, b, _ in found])

    def bounds(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper bound, lower bound) of each document's score; a sum below 2**53 is exact."""
        rows, steps = self.rows[places], self.bytes[places]
        above = np.bincount(rows, weights * steps, self.docs)
        below = above - np.bincount(rows, weights * (steps > 0), self.docs)
        return above.astype(np.int64) * STEP, np.maximum(below.astype(np.int64) * STEP, 0)

    def exact(self, places: np.ndarray, weights: np.ndarray, chosen: np.ndarray, documents: int, total: int) -> np.ndarray:
        """The scores of the documents where chosen is true, from the second level."""
        if not hasattr(self, "tfs"):
            self.tfs, self.lengths = unpack(self.get("tfs"), 4).view(np.int64), unpack(self.get("lengths"), 8).view(np.int64)
        keep = chosen[self.rows[places]]
        rows, tf = self.rows[places[keep]], self.tfs[places[keep]]
        scores = np.zeros(self.docs, np.int64)
        np.add.at(scores, rows, weights[keep] * impacts(tf, self.lengths[rows], documents, total))
        return scores


def _lowest(queries: list[dict[bytes, int]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = frozenset(w for q in queries for w in q)
        best = [np.zeros(0, np.int64)] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, vocabulary, batch.column("docs")[i].as_py())
                for j, query in enumerate(queries):
                    if found := block.slices(query):
                        _, low = block.bounds(*found)
                        low = low[low > (best[j][-1] if len(best[j]) == k else 0)]
                        if len(low):
                            best[j] = -np.sort(-np.concatenate([best[j], low]))[:k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(queries), dtype=np.int32)), pa.array([b.tolist() for b in best], pa.list_(pa.int64()))], ["query", "low"])
        release()

    return run


def _rescore(queries: list[dict[bytes, int]], least: np.ndarray, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = frozenset(w for q in queries for w in q)
        for batch in batches:
            out = [], [], []
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].as_py()
                block = _Block(batch, i, vocabulary, len(ids))
                for j, query in enumerate(queries):
                    if found := block.slices(query):
                        high, _ = block.bounds(*found)
                        chosen = (high >= least[j]) & (high > 0)
                        if chosen.any():
                            scores = block.exact(*found, chosen, documents, total)
                            for d in np.flatnonzero(chosen & (scores > 0)).tolist():
                                out[0].append(j)
                                out[1].append(ids[d])
                                out[2].append(int(scores[d]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["query", "doc_id", "score"])
        release()

    return run


def _pass(index: DataFrame, queries: list[Counter], k: int, documents: int, total: int) -> DataFrame:
    """(query, doc_id, score): every document whose upper bound reaches a query's kth lower bound, scored exactly."""
    wanted = frozenset(w for q in queries for w in q)
    found = index.select("vocabulary", "df").mapInArrow(_frequencies(wanted), "term binary, df long").groupBy("term").agg(F.sum("df")).collect()  # the queries' terms
    weights = {bytes(w): weight(df, documents) for w, df in found}
    weighed = [{w: weights[w] for w in sorted(q) if weights.get(w)} for q in queries]
    first = index.select("vocabulary", "df", "rows", "bytes", F.size("doc_ids").alias("docs"))
    lows = first.mapInArrow(_lowest(weighed, k), "query int, low array<long>")
    # tasks' best meet in two rounds, so no row holds more than k numbers of each of a root of the tasks
    best = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, k)
    groups = max(1, math.isqrt(index.rdd.getNumPartitions()))
    lows = lows.groupBy("query", F.pmod(F.xxhash64("low"), F.lit(groups)).alias("salt")).agg(best("low").alias("low")).groupBy("query").agg(best("low").alias("low"))
    least = np.zeros(len(queries), np.int64)
    for j, low in lows.where(F.size("low") >= k).select("query", F.element_at("low", k)).collect():
        least[j] = low
    return index.mapInArrow(_rescore(weighed, least, documents, total), "query int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents, equal scores by rising doc_id.

    Documents that share no term with an item, or only terms of weight 0, are none of its results; null and empty texts have no terms. Repeated rows of
    either side stand for themselves: an item given twice is answered twice, a document given twice can take two ranks. Documents without an
    id come after others of their score. Items are a stated query set, read QUERIES at a time, each time against the whole index. Empty
    tables give an empty one.
    """
    index, documents, total = build_index(docs, id_col, text_col)
    spark = docs.sparkSession
    item = f"`{item_col}`"
    asked = written(items.select(F.col(item).alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()), "items")
    groups = max(1, -(-asked.count() // QUERIES))
    made = []
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == g).select("query", "text").collect()
        numbers = spark.createDataFrame([(j, r[0]) for j, r in enumerate(rows)], "query int, number long")
        made.append(_pass(index, [terms(r[1]) for r in rows], k, documents, total).join(F.broadcast(numbers), "query").select("number", "doc_id", "score"))
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    named = asked.select(F.col("query").alias("number"), "item_id")
    return ranked.join(named, "number").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
    WITH asked AS (SELECT row_number() OVER () AS number, item_id, text FROM benchmark),
    wanted AS (SELECT DISTINCT number, item_id, unnest({_TERMS}) AS term FROM asked),
    docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
    sums AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
    postings AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
    weighed AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, sums GROUP BY term, n_docs),
    scored AS (
        SELECT number, item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
        FROM wanted JOIN weighed USING (term) JOIN postings USING (term), sums GROUP BY ALL
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

__all__ = ["build_index", "impacts", "ranked_search", "terms", "weight"]
