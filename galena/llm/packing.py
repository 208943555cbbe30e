"""Sorted integers as compressed bytes, and runs of Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray, width: int = 8, delta: bool = False) -> bytes:
    """Unsigned integers below 2**(8*width), byte plane by byte plane; delta: differences of a rising sequence."""
    values = np.ascontiguousarray(values, np.uint64)
    if delta and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return _pack.compress(np.ascontiguousarray(planes.T).tobytes())


def unpack(data: bytes, width: int = 8, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(_unpack.decompress(data), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    values = wide.view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if delta else values


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Neighbouring batches together, up to about most_bytes; larger ones are cut at rows."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in rising order, by a sort."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def release() -> None:
    """Give freed memory back to the system, where the C library can; a worker lives on after its block."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass
