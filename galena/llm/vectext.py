"""Words and word shingles of a whole Arrow batch at once, as 64-bit hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D after A-Z are lower-cased; a document's
boundary ends a word. All of a batch's bytes are handled together, so Python does no work per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes, or shingles, that are worked on at once.
PIECE_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_ODD = 0x9E3779B97F4A7C15
#: Bytes of a word that are hashed in steps of eight; longer words are digested.
CHAINED = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """hashes: a word each, documents one after another; first[i]: where document i's words begin (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _hashes(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word: eight bytes at a time, with a bijection between, so words of eight bytes or fewer never share one and no sums of bytes decide over longer ones.

    Words beyond CHAINED bytes are digested one by one.
    """
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    window = np.ndarray((len(low),), "<u8", padded.data, strides=(1,))
    out = sizes.astype(np.uint64) * np.uint64(_ODD)
    at, left, rows = starts, sizes, None
    for k in range(0, CHAINED, 8):
        if k:
            rows = np.flatnonzero((sizes > k) & (sizes <= CHAINED))
            if not len(rows):
                break
            at, left = starts[rows] + k, sizes[rows] - k
        part = window[at] & _MASKS[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ part) * np.uint64(_ODD)
        else:
            out[rows] = mix(out[rows] ^ part) * np.uint64(_ODD)
    for i in np.flatnonzero(sizes > CHAINED).tolist():
        out[i] = int.from_bytes(blake2b(np.ascontiguousarray(low[starts[i] : starts[i] + sizes[i]]).data, digest_size=8).digest(), "little")
    return mix(out)


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """In pieces of PIECE_BYTES or fewer that end where a word does; a word as long as a piece is digested on its way, so beside the result memory does not grow with a text."""
    parts, first = [np.zeros(0, np.uint64)], np.zeros(len(offsets), np.int64)
    begun = begin = 0
    while begin < len(raw):
        low = _LOWER[raw[begin : begin + PIECE_BYTES]]
        n = len(low)
        inside = _IN_WORD[low]
        i, j = np.searchsorted(offsets, [begin, begin + n])
        edges = offsets[i:j] - begin  # documents that begin here
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        new[edges] |= inside[edges]
        starts = np.flatnonzero(new)
        goes_on = begin + n < len(raw) and inside[-1] and _IN_WORD[raw[begin + n]] and not (j < len(offsets) and offsets[j] == begin + n)
        if goes_on and starts[-1] > 0:  # the open word comes with the next piece
            n = int(starts[-1])
            low, inside, starts = low[:n], inside[:n], starts[:-1]
            j = int(np.searchsorted(offsets, begin + n))
            edges = offsets[i:j] - begin
        elif goes_on:
            long, head, size = blake2b(digest_size=8), b"", 0
            while len(low):
                long.update(low.data)
                head, size, begin = head + low.tobytes() if size <= CHAINED else head, size + len(low), begin + len(low)
                stop = min(len(raw), begin + PIECE_BYTES, int(offsets[j]) if j < len(offsets) else len(raw))
                low = _LOWER[raw[begin:stop]]
                ends = np.flatnonzero(~_IN_WORD[low])
                low = low[: ends[0]] if len(ends) else low
            first[i:j] = begun
            begun += 1
            one = _hashes(np.frombuffer(head, np.uint8), np.zeros(1, np.int64), np.array([size])) if size <= CHAINED else mix(np.array([int.from_bytes(long.digest(), "little")], np.uint64))
            parts.append(one)
            continue
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = edges[edges > 0] - 1
        last[at] |= inside[at]
        first[i:j] = begun + np.searchsorted(starts, edges)
        begun += len(starts)
        parts.append(_hashes(low, starts, np.flatnonzero(last) + 1 - starts))
        begin += n
    first[np.searchsorted(offsets, len(raw)) :] = begun
    return Words(np.concatenate(parts), first)


def pieces(raw: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about `most` bytes; a longer document is a run of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def batch_words(column: pa.Array | pa.ChunkedArray) -> Words:
    return words(*utf8(column))


def spans(first: np.ndarray, most: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(begin, end, document, its and the following documents' shares) of stretches of at most `most` items; first: where each document's items begin."""
    for a in range(0, int(first[-1]), most):
        b = min(a + most, int(first[-1]))
        d, e = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b))
        yield a, b, d, np.minimum(first[d + 1 : e + 1], b) - np.maximum(first[d:e], a)


def sums_by(first: np.ndarray, values, most: int = PIECE_BYTES) -> np.ndarray:
    """Each document's sum, modulo 2**64, of values(begin, end) over its items."""
    out = np.zeros(len(first) - 1, np.uint64)
    for a, b, d, shares in spans(first, most):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values(a, b), dtype=np.uint64)])
        ends = np.cumsum(shares)
        out[d : d + len(shares)] += total[ends] - total[ends - shares]
    return out


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles in rising order, and where each document's begin.

    Fewer than five words make one shingle of the whole sequence; no word, none.
    """
    counts = w.counts()
    made = np.where(counts >= SHINGLE, counts - (SHINGLE - 1), np.minimum(counts, 1))
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(made)])
    sums = np.empty(first[-1], np.uint64)
    for a, b, d, shares in spans(first, PIECE_BYTES):
        at = np.arange(a, b) + np.repeat(w.first[d : d + len(shares)] - first[d : d + len(shares)], shares)
        short = np.repeat(np.minimum(counts[d : d + len(shares)], SHINGLE), shares)
        part = short.astype(np.uint64) * _PLACE[SHINGLE]
        for k in range(SHINGLE):
            here = np.take(w.hashes, at + k, mode="clip") * _PLACE[k]
            part += here if k == 0 else np.where(short > k, here, np.uint64(0))
        sums[a:b] = mix(part)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            sums[a:b].sort()
    keep = np.ones(len(sums), bool)
    keep[1:] = sums[1:] != sums[:-1]
    keep[first[:-1][made > 0]] = True
    kept = sums_by(first, lambda a, b: keep[a:b]).astype(np.int64)
    return sums[keep], np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])
