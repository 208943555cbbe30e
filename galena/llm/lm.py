"""Language-model scoring by a weighted backoff automaton.

States are the root and one for each word (and the text's begin) as history; a state's arcs are the bigrams seen
min_count times or more in the training texts (all, unless the caller says otherwise), weighted by absolute discounting
interpolated with the smoothed unigram, and every other word takes the failure arc, which costs the state's backoff
weight and ends at the root, whose arcs are the unigrams. A text is read once from left to right; the state carries over
and log-probabilities add up. For every state the arcs' probabilities sum to one over the training words and one unknown word.

The model is as large as the corpus allows and is never in one place. Counts meet in hash buckets, whose number follows the bytes
of text. To be scored, a block of texts asks the buckets for the parts of the automaton that it can touch, and walks that part.

A word is a hash of 64 bits, a bigram one of 48 within its bucket. A bucket holds the bigrams of about BUCKET_BYTES of text, some
10**6, so a bigram shares its key with another once in some 10**8, at any size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.packing import distinct, gathered, pack, release, runs, unpack
from galena.llm.session import shuffle_width, written
from galena.llm.vectext import Words, batch_words, mix

BLOCK_BYTES = 8 << 20
BUCKET_BYTES, PART_BYTES = 8 << 20, 32 << 20
END, START = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_K1, _K2, _K3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
#: Histories with this share of all tokens or more (so at most so many) spread their bigrams over SPREAD buckets.
HOT_SHARE, SPREAD = 4096, 64
WORD, PAIR, TEXT = 0, 1, 2
ROW = "kind int, bucket int, block long, body binary, more binary"


class BackoffAutomaton:
    """The part of the automaton that a block can touch, as arrays.

    root[w]: log10 probability of word w; fail[s]: log10 weight of state s's failure arc; arcs: sorted codes
    state * words + word, with their log10 weights.
    """

    def __init__(self, root: np.ndarray, fail: np.ndarray, arcs: np.ndarray, weights: np.ndarray) -> None:
        self.root, self.fail, self.arcs, self.weights = root, fail, arcs, weights

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The log-probability of each step from a state by a word."""
        out = self.fail[states] + self.root[words]  # the failure arc to the root, then the root's own arc
        if len(self.arcs):
            codes = states.astype(np.int64) * len(self.root) + words
            at = np.minimum(np.searchsorted(self.arcs, codes), len(self.arcs) - 1)
            hit = self.arcs[at] == codes
            out[hit] = self.weights[at[hit]]
        return out

    def walk(self, words: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
        """Each text's log-probability, read from left to right; text i is words[first[i]:first[i + 1]], at least one word; `begin` is every text's first state.

        Every arc by a word ends in that word's state, also after a failure, so the states that a whole block's texts carry
        over are the words one step later, and all steps are taken at once.
        """
        carried = np.empty_like(words)
        carried[1:], carried[first[:-1]] = words[:-1], begin
        return np.add.reduceat(self.step(carried, words), first[:-1])


@dataclass
class Globals:
    tokens: int  # N
    kinds: int  # V
    texts: int
    discount: float


def _sequences(table: pa.Table, text: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's words and one END, as hashes; where each text begins."""
    w: Words = batch_words(table.column(text))
    first = w.first + np.arange(len(w.first))
    out = np.empty(len(w.hashes) + len(w.first) - 1, np.uint64)
    ends = first[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = w.hashes, END
    return out, first


def _histories(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:], before[first[:-1]] = tokens[:-1], START
    return before


def _pairs(before: np.ndarray, tokens: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the 48-bit key of each bigram."""
    short = tokens >> np.uint64(24)
    spread = before
    if len(hot):
        at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
        spread = np.where(hot[at] == before, before + (short % np.uint64(SPREAD) + np.uint64(1)) * _K3, before)
    return (mix(spread) % np.uint64(buckets)).astype(np.int64), mix(before * _K1 + short * _K2) >> np.uint64(16)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds, buckets, blocks, body, more = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blocks, pa.int64()), pa.array(body, pa.binary()), pa.array(more, pa.binary())], ["kind", "bucket", "block", "body", "more"])


def _cut(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted bucket numbers."""
    at = runs(buckets)
    yield from zip(buckets[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BLOCK_BYTES):
            tokens, _ = _sequences(table, 0)
            kinds, n = np.unique(tokens, return_counts=True)
            where = (mix(kinds) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            kinds, n, where = kinds[order], n[order], where[order]
            yield _emit([(WORD, b, 0, pack(kinds[i:j], 8, True), pack(n[i:j])) for b, i, j in _cut(where)])
            release()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A row at a time, so that only one is in memory as Python objects."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(names)}


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by bucket, a bucket at a time."""
    bucket, held = None, []
    for row in _rows(batches):
        if bucket is not None and row["bucket"] != bucket:
            yield bucket, held
            held = []
        bucket = row["bucket"]
        held.append(row)
    if held:
        yield bucket, held


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_bucket(batches):
        kinds = np.concatenate([unpack(r["body"], 8, True) for r in rows])
        n = np.concatenate([unpack(r["more"]) for r in rows])
        kinds, back = np.unique(kinds, return_inverse=True)
        n = np.bincount(back, n).astype(np.uint64)
        # (tokens, kinds, most frequent) travel beside the counts
        yield pa.RecordBatch.from_arrays([
            pa.array([bucket], pa.int32()), pa.array([pack(kinds, 8, True)], pa.binary()), pa.array([pack(n)], pa.binary()), pa.array([int(n.sum())], pa.int64()), pa.array([len(kinds)], pa.int64()), pa.array([int(n.max())], pa.int64()),
        ], ["bucket", "body", "more", "tokens", "kinds", "most"])


def _hot_words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                kinds, n = unpack(row["body"], 8, True), unpack(row["more"])
                found += kinds[n >= least].astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["word"])

    return run


def _count_pairs(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BLOCK_BYTES):
            tokens, first = _sequences(table, 0)
            before = _histories(tokens, first)
            where, key = _pairs(before, tokens, hot, buckets)
            # the key in the low 48 bits, the bucket above them, sorts both at once
            code = (where.astype(np.uint64) << np.uint64(48)) | key
            order = np.argsort(code)
            code = code[order]
            at = runs(code)
            n = np.diff(at)
            code, before = code[at[:-1]], before[order[at[:-1]]]
            where = (code >> np.uint64(48)).astype(np.int64)
            out = []
            for b, i, j in _cut(where):
                # by history, so that a history is written once; its keys follow
                by = np.argsort(before[i:j], kind="stable")
                h = before[i:j][by]
                body = pack(h, 8, True)
                keys = pack((code[i:j] & np.uint64(2**48 - 1))[by], 6)
                out.append((PAIR, b, 0, len(body).to_bytes(4, "little") + body + keys, pack(n[i:j][by])))
            yield _emit(out)
            release()

    return run


def _sum_pairs(word_buckets: int, min_count: int):
    """A bucket's bigrams of min_count or more; and for the words' buckets what each history's arcs hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            h, keys = [], []
            for r in rows:
                size = int.from_bytes(r["body"][:4], "little")
                h.append(unpack(r["body"][4 : 4 + size], 8, True))
                keys.append(unpack(r["body"][4 + size :], 6))
            h, keys, n = np.concatenate(h), np.concatenate(keys), np.concatenate([unpack(r["more"]) for r in rows])
            order = np.argsort(keys)
            keys = keys[order]
            at = runs(keys)
            n = np.add.reduceat(n[order], at[:-1])
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            keep = n >= min_count
            keys, h, n = keys[at[:-1]][keep], h[order[at[:-1]]][keep], n[keep]
            out = [(PAIR, bucket, 0, pack(keys, 6, True), pack(n), once, twice)]
            kinds, back = np.unique(h, return_inverse=True)
            mass, arcs = np.bincount(back, n, len(kinds)).astype(np.uint64), np.bincount(back, minlength=len(kinds)).astype(np.uint64)
            where = (mix(kinds) % np.uint64(word_buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            kinds, mass, arcs, where = kinds[order], mass[order], arcs[order], where[order]
            for b, i, j in _cut(where):
                mass_bytes = pack(mass[i:j])
                out.append((WORD, b, 1, pack(kinds[i:j], 8, True), len(mass_bytes).to_bytes(4, "little") + mass_bytes + pack(arcs[i:j]), 0, 0))
            base = _emit([x[:5] for x in out])
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array([x[5] for x in out], pa.int64()), pa.array([x[6] for x in out], pa.int64())], [*base.schema.names, "once", "twice"])
            release()

    return run


def _ask(buckets: int, hot: np.ndarray):
    """For each block of texts: what it asks of the buckets, and its texts as numbers of its own words.

    A block's number is its task's and its place there, so no two blocks share one, whatever their ids and texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for at, table in enumerate(gathered(batches, BLOCK_BYTES)):
            block = part + at
            ids = table.column(0)
            none = ids.is_null().to_numpy()
            ids = ids.fill_null(0).to_numpy().astype(np.int64)
            tokens, first = _sequences(table, 1)
            kinds, words = np.unique(np.concatenate([tokens, np.array([START, END])]), return_inverse=True)
            words = words[:-2]
            where = (mix(kinds) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            out = [(WORD, b, block, pack(kinds[order[i:j]], 8, True), b"") for b, i, j in _cut(where[order])]
            code = _codes(kinds, words, first, hot, buckets)
            out += [(PAIR, b, block, pack(code[i:j] & np.uint64(2**48 - 1), 6, True), b"") for b, i, j in _cut((code >> np.uint64(48)).astype(np.int64))]
            texts = [pack(ids.view(np.uint64)), pack(none, 1), pack(np.diff(first)), pack(words, 4)]
            body = b"".join(len(x).to_bytes(4, "little") + x for x in texts)
            out.append((TEXT, block % buckets, block, body, b""))
            yield _emit(out)
            del table, tokens, kinds, words, code, out
            release()

    return run


def _codes(kinds: np.ndarray, words: np.ndarray, first: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The distinct bigrams of a block as sorted codes: the bucket, then the key."""
    before = np.empty_like(words)
    before[1:], before[first[:-1]] = words[:-1], np.searchsorted(kinds, START)
    both = distinct(before.astype(np.int64) * len(kinds) + words)
    where, key = _pairs(kinds[both // len(kinds)], kinds[both % len(kinds)], hot, buckets)
    return distinct((where.astype(np.uint64) << np.uint64(48)) | key)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model's rows of a bucket (block null) come before the questions to it; texts pass through."""
    bucket = None
    none = np.zeros(0, np.uint64)
    words, pairs, added = (none, {}), (none, none), []
    for row in _rows(batches):
        if row["bucket"] != bucket:
            bucket = row["bucket"]
            words, pairs, added = (none, {}), (none, none), []
        if row["kind"] == TEXT:
            yield _emit([(TEXT, bucket, row["block"], row["body"], b"")])
        elif row["model"]:
            if row["kind"] == PAIR:
                pairs = (unpack(row["body"], 6, True), unpack(row["more"]))
            else:
                added.append(row)
        elif row["kind"] == PAIR:
            yield _emit([(PAIR, bucket, row["block"], pack(_look(pairs[0], pairs[1], unpack(row["body"], 6, True))), b"")])
        else:
            if added:
                words, added = _joined(added), []
            keys = unpack(row["body"], 8, True)
            found = [_look(words[0], words[1].get(k, np.zeros(len(words[0]), np.uint64)), keys) for k in ("n", "mass", "arcs")]
            yield _emit([(WORD, bucket, row["block"], pack(np.concatenate(found)), row["body"])])  # the words go back too, so texts do without them


def _joined(rows: list[dict]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    kinds, n, mass, arcs = [], [], [], []
    for r in rows:
        k = unpack(r["body"], 8, True)
        kinds.append(k)
        if r["block"]:  # of histories
            size = int.from_bytes(r["more"][:4], "little")
            mass.append(unpack(r["more"][4 : 4 + size]))
            arcs.append(unpack(r["more"][4 + size :]))
            n.append(np.zeros(len(k), np.uint64))
        else:
            n.append(unpack(r["more"]))
            mass.append(np.zeros(len(k), np.uint64))
            arcs.append(np.zeros(len(k), np.uint64))
    kinds, back = np.unique(np.concatenate(kinds), return_inverse=True)
    return kinds, {name: np.bincount(back, np.concatenate(v), len(kinds)).astype(np.uint64) for name, v in (("n", n), ("mass", mass), ("arcs", arcs))}


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each wanted key's value, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.uint64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.uint64(0))


def _score(buckets: int, hot: np.ndarray, g: Globals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for row in _rows(batches):
            if block is not None and row["block"] != block:
                yield _walk(held, buckets, hot, g)
                held = []
                release()
            block = row["block"]
            held.append(row)
        if held:
            yield _walk(held, buckets, hot, g)
            release()

    return run


def _walk(rows: list[dict], buckets: int, hot: np.ndarray, g: Globals) -> pa.RecordBatch:
    """The scores of one block: its text row, and the answer of each bucket that it asked."""
    (text,) = (r["body"] for r in rows if r["kind"] == TEXT)
    replies = {kind: sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"]) for kind in (WORD, PAIR)}
    parts, at = [], 0
    while at < len(text):
        size = int.from_bytes(text[at : at + 4], "little")
        parts.append(text[at + 4 : at + 4 + size])
        at += 4 + size
    ids, none, lengths, words = unpack(parts[0]).view(np.int64), unpack(parts[1], 1) > 0, unpack(parts[2]).astype(np.int64), unpack(parts[3], 4).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    kinds = np.concatenate([unpack(r["more"], 8, True) for r in replies[WORD]])
    order = np.argsort(kinds)
    kinds = kinds[order]
    n, mass, arcs = np.concatenate([unpack(r["body"]).reshape(3, -1) for r in replies[WORD]], axis=1)[:, order].astype(float)
    code = _codes(kinds, words, first, hot, buckets)
    pairs = np.concatenate([unpack(r["body"]) for r in replies[PAIR]]).astype(float)
    if len(pairs) != len(code):
        raise RuntimeError("a block's answers do not fit its questions: the texts must come in the same order when a task runs again")
    begin = int(np.searchsorted(kinds, START))
    seen_as_history = n.copy()
    seen_as_history[begin] = g.texts
    unigram = (n + 0.5) / (g.tokens + 0.5 * (g.kinds + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        backoff = np.where(seen_as_history > 0, 1 - (mass - g.discount * arcs) / seen_as_history, 1.0)
    before = np.empty_like(words)
    before[1:], before[first[:-1]] = words[:-1], begin
    both = distinct(before * len(kinds) + words)
    del before
    states, ends = both // len(kinds), both % len(kinds)
    own_where, own_key = _pairs(kinds[states], kinds[ends], hot, buckets)
    n_pair = pairs[np.searchsorted(code, (own_where.astype(np.uint64) << np.uint64(48)) | own_key)]
    del own_where, own_key, code, pairs
    has = n_pair > 0
    with np.errstate(divide="ignore"):
        weights = np.log10((n_pair[has] - g.discount) / seen_as_history[states[has]] + backoff[states[has]] * unigram[ends[has]])
        fail = np.log10(np.maximum(backoff, 1e-12))
    automaton = BackoffAutomaton(np.log10(unigram), fail, both[has], weights)
    del states, ends, both, has, n_pair
    score = automaton.walk(words, first, begin)
    base = np.add.reduceat(automaton.root[words], first[:-1])
    known = np.add.reduceat((n[words] > 0).astype(np.int64), first[:-1])
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(lengths), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_texts(train: DataFrame, texts: DataFrame, min_count: int = 1) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of `texts`, by the model of `train`.

    train: text; texts: doc_id, text. Null text counts as empty: one END token. A null doc_id comes back null, and rows with
    the same id, or without one, are scored each by its own text. base_score is that of the smoothed unigram alone. Without
    training texts every token is unknown and has the probability one half over one half. Bigrams seen less than min_count times
    are no arcs; 1 keeps every bigram. Columns beside these are not read. An empty table gives an empty one.
    """
    spark = texts.sparkSession
    text = F.col("text").cast("string").alias("text")
    bytes_of = F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))
    learnt, size = train.agg(F.count(F.lit(1)), bytes_of).first()
    size = max(size, texts.agg(bytes_of).first()[0])
    width = shuffle_width(spark, size, PART_BYTES)
    buckets = max(4 * width, -(-size // BUCKET_BYTES))
    shuffled = lambda df: df.repartition(width, "bucket").sortWithinPartitions("bucket")
    words = shuffled(train.select(text).mapInArrow(_count_words(buckets), ROW)).mapInArrow(_sum_words, "bucket int, body binary, more binary, tokens long, kinds long, most long")
    words = written(words, "words")
    tokens, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    # at most HOT_SHARE words, as each has that share of all
    least = max(1, math.ceil(tokens / HOT_SHARE))
    hot = np.sort(np.array([r[0] for r in words.where(F.col("most") >= least).select("body", "more").mapInArrow(_hot_words(least), "word long").collect()], np.int64).astype(np.uint64))
    hot = distinct(np.concatenate([hot, [START]]))
    pairs = shuffled(train.select(text).mapInArrow(_count_pairs(buckets, hot), ROW)).mapInArrow(_sum_pairs(buckets, min_count), f"{ROW}, once long, twice long")
    pairs = written(pairs, "pairs")
    once, twice = pairs.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
    g = Globals(tokens, kinds, learnt, once / (once + 2 * twice) if once and twice else 0.75)
    model = words.select(F.lit(WORD).alias("kind"), "bucket", F.lit(0).cast("long").alias("block"), "body", "more").unionByName(pairs.select("kind", "bucket", "block", "body", "more"))
    asked = texts.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_ask(buckets, hot), ROW)
    both = model.withColumn("model", F.lit(True)).unionByName(asked.withColumn("model", F.lit(False)))
    answered = both.repartition(width, "bucket").sortWithinPartitions("bucket", F.desc("model")).mapInArrow(_answer, ROW)
    scored = answered.repartition(width, "block").sortWithinPartitions("block").mapInArrow(_score(buckets, hot, g), SCORES)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
