"""Document quality by a byte-level convolutional network in numpy.

Every byte has a learnt embedding. Learnt filters of 12 bytes run over the whole text in steps of four;
their rectified outputs are pooled (mean and largest) in chunks of 256 bytes that overlap by half and together cover
the document. A hidden layer reads each chunk, the largest value of each hidden unit over all chunks describes the
document, and a logistic unit turns that into one probability.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.labelled import labelled_texts
from galena.llm.session import fresh
from galena.llm.vectext import pieces, utf8

BLOCK, WIDTH, HALF = 4, 3, 32  # a filter sees WIDTH blocks of BLOCK bytes; half a chunk is HALF steps of a block
STEP_BYTES = BLOCK * HALF
EMBED, FILTERS, HIDDEN = 8, 48, 32
#: At most so many labelled texts are learnt from, and so many segments of so many bytes of each, from all over the text: what the driver holds to fit.
SAMPLE_ROWS, EPOCHS, SEGMENT = 4000, 10, 1536
PIECE = 1 << 19


@contextlib.contextmanager
def one_thread():
    """numpy's linear algebra on one thread, where its library can be told so: its matrices here are too small for more."""
    calls = None
    try:
        with open("/proc/self/maps") as f:
            path = next((line.split()[-1] for line in f if "openblas" in line), None)
        if path:
            lib = ctypes.CDLL(path)
            for prefix, suffix in itertools.product(("scipy_", ""), ("64_", "")):
                if hasattr(lib, f"{prefix}openblas_set_num_threads{suffix}"):
                    calls = getattr(lib, f"{prefix}openblas_get_num_threads{suffix}"), getattr(lib, f"{prefix}openblas_set_num_threads{suffix}")
                    break
    except OSError:
        pass
    before = calls[0]() if calls else 0
    if calls:
        calls[1](1)
    try:
        yield
    finally:
        if calls:
            calls[1](before)


def laid_out(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents padded to whole halves, two blocks of padding at least after each: codes (0 for padding, byte + 1), halves of each, lengths."""
    lengths = np.diff(offsets)
    halves = -(-(lengths + BLOCK * (WIDTH - 1)) // STEP_BYTES)
    halves = np.maximum(halves, 1)
    starts = np.concatenate([[0], np.cumsum(halves)]) * STEP_BYTES
    codes = np.zeros(starts[-1], np.int16)
    codes[np.arange(len(raw)) + np.repeat(starts[:-1] - offsets[:-1], lengths)] = raw.astype(np.int16) + 1
    return codes, halves, lengths


class QualityNet:
    """All weights as float32 arrays by name; forward() gives logits of many documents at once."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        if weights is None:
            table = rng.normal(0, 0.5, (257, EMBED))
            table[0] = 0
            weights = {
                "embed": table, "filters": rng.normal(0, (2 / (EMBED * BLOCK * WIDTH)) ** 0.5, (WIDTH, BLOCK * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
                "hidden": rng.normal(0, (2 / (2 * FILTERS + 1)) ** 0.5, (2 * FILTERS + 1, HIDDEN)), "hidden_bias": np.zeros(HIDDEN), "out": rng.normal(0, 0.3, HIDDEN), "out_bias": np.zeros(1),
            }
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    def forward(self, codes: np.ndarray, halves: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w = self.w
        blocks = w["embed"][codes].reshape(-1, BLOCK * EMBED)
        total = len(blocks)
        y = blocks @ w["filters"][0]
        for k in range(1, WIDTH):
            y[: total - k] += blocks[k:] @ w["filters"][k]
        y += w["bias"]
        np.maximum(y, 0, out=y)
        first = np.concatenate([[0], np.cumsum(halves)])
        used = -(-lengths // BLOCK)  # blocks that begin inside the text
        valid = np.arange(total) - np.repeat(first[:-1] * HALF, halves * HALF) < np.repeat(used, halves * HALF)
        y *= valid[:, None]
        cubes = y.reshape(-1, HALF, FILTERS)
        sums, tops = cubes.sum(1), cubes.max(1)
        counts = valid.reshape(-1, HALF).sum(1).astype(np.float32)
        # a chunk is two neighbouring halves of a document; a document of one half is one chunk
        chunks = np.maximum(halves - 1, 1)
        begin = np.concatenate([[0], np.cumsum(chunks)])
        left = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], chunks)
        right = left + np.repeat((halves > 1).astype(np.int64), chunks)
        alone = right == left
        size = np.where(alone, counts[left], counts[left] + counts[right])
        inverse = (1 / np.maximum(size, 1)).astype(np.float32)
        mean = (sums[left] + sums[right] * ~alone[:, None]) * inverse[:, None]
        top = np.maximum(tops[left], tops[right])
        features = np.concatenate([mean, top, np.log1p(size)[:, None].astype(np.float32) / 4], 1)
        z = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0)
        pooled = np.maximum.reduceat(z, begin[:-1], axis=0)
        logits = pooled @ w["out"] + w["out_bias"]
        if keep is not None:
            keep.update(y=y, blocks=blocks, total=total, cubes=cubes, sums=sums, tops=tops, chunks=chunks, left=left, right=right, alone=alone, inverse=inverse, features=features, z=z, pooled=pooled)
        return logits

    def gradient(self, codes: np.ndarray, halves: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        v: dict = {}
        logits = self.forward(codes, halves, lengths, v)
        w, g = self.w, {}
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        loss = float(-np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))
        d = ((p - labels) / len(labels)).astype(np.float32)
        g["out"], g["out_bias"] = v["pooled"].T @ d, d.sum(keepdims=True)
        of = np.repeat(np.arange(len(labels)), v["chunks"])
        dz = (d[:, None] * w["out"])[of] * ((v["z"] == v["pooled"][of]) & (v["z"] > 0))
        g["hidden"], g["hidden_bias"] = v["features"].T @ dz, dz.sum(0)
        df = dz @ w["hidden"].T
        d_mean, d_top = df[:, :FILTERS] * v["inverse"][:, None], df[:, FILTERS : 2 * FILTERS]
        d_sums, d_tops = np.zeros_like(v["sums"]), np.zeros_like(v["tops"])
        right, left, alone = v["right"], v["left"], v["alone"]
        to_left = v["tops"][left] >= v["tops"][right]
        # neighbours overlap, so a half gets from two chunks: the chunk that it begins and the one that it ends
        d_sums[left] += d_mean
        d_tops[left] += d_top * to_left
        d_sums[right[~alone]] += d_mean[~alone]
        d_tops[right[~alone]] += (d_top * ~to_left)[~alone]
        dy = ((v["cubes"] == v["tops"][:, None]) * d_tops[:, None] + d_sums[:, None]).reshape(-1, FILTERS) * (v["y"] > 0)
        g["bias"] = dy.sum(0)
        blocks, total = v["blocks"], v["total"]
        g["filters"] = np.stack([blocks[k:].T @ dy[: total - k] for k in range(WIDTH)])
        d_blocks = dy @ w["filters"][0].T
        for k in range(1, WIDTH):
            d_blocks[k:] += dy[: total - k] @ w["filters"][k].T
        flat = d_blocks.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(codes, flat[:, j], 257) for j in range(EMBED)], 1).astype(np.float32)
        g["embed"][0] = 0
        return loss, g

    def fit(self, texts: list[list[bytes]], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 4e-3, seed: int = 9) -> None:
        """Adam over segments of the texts, each text's next one in each epoch; scoring always reads whole texts."""
        with one_thread():
            self._fit(texts, labels, epochs, batch, rate, seed)

    def _fit(self, texts: list[list[bytes]], labels: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in self.w.items()}
        step, steps = 0, max(1, epochs * -(-len(texts) // batch))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                parts = [np.frombuffer(texts[r][epoch % len(texts[r])], np.uint8) for r in rows]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                _, g = self.gradient(*laid_out(np.concatenate(parts), offsets), labels[rows].astype(np.float32))
                step += 1
                pace = rate * (1 - step / (steps + 1))
                for k, x in self.w.items():
                    m, s = moments[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    x -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for row, end, r, o in pieces(raw, offsets, PIECE):
            logits = self.forward(*laid_out(r, o)) if o[-1] <= 4 * PIECE else self._long(r)
            out[row:end] = 1 / (1 + np.exp(-np.clip(logits.astype(float), -30, 30)))
        return out

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """One very long document in stretches of whole halves: each stretch sees the bytes after it, and shares its last half with the next, so all chunks are those of one pass."""
        w, size = self.w, len(raw)
        halves, used = -(-(size + BLOCK * (WIDTH - 1)) // STEP_BYTES), -(-size // BLOCK)
        pooled: np.ndarray | None = None
        at, step = 0, PIECE // STEP_BYTES
        while at < halves - 1:
            end = min(halves, at + step + 1)
            codes = np.zeros((end - at) * STEP_BYTES + BLOCK * (WIDTH - 1), np.int16)
            part = raw[at * STEP_BYTES : end * STEP_BYTES + BLOCK * (WIDTH - 1)]
            codes[: len(part)] = part.astype(np.int16) + 1
            blocks = w["embed"][codes].reshape(-1, BLOCK * EMBED)
            n = (end - at) * HALF
            y = blocks[:n] @ w["filters"][0]
            for k in range(1, WIDTH):
                y += blocks[k : n + k] @ w["filters"][k]
            valid = np.arange(n) + at * HALF < used
            y = np.maximum(y + w["bias"], 0) * valid[:, None]
            cubes, counts = y.reshape(-1, HALF, FILTERS), valid.reshape(-1, HALF).sum(1).astype(np.float32)
            sums, tops, size_of = cubes.sum(1), cubes.max(1), counts[:-1] + counts[1:]
            mean = (sums[:-1] + sums[1:]) * (1 / np.maximum(size_of, 1)).astype(np.float32)[:, None]
            features = np.concatenate([mean, np.maximum(tops[:-1], tops[1:]), np.log1p(size_of)[:, None].astype(np.float32) / 4], 1)
            top = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0).max(0)
            pooled = top if pooled is None else np.maximum(pooled, top)
            at = end - 1
        return (pooled @ w["out"] + w["out_bias"]).reshape(1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) as (doc_id, label, EPOCHS segments): places all over the whole text that follow from its id; a short text once."""
    for batch in batches:
        made = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            raw = text.as_py().encode()
            rng = np.random.default_rng(row & (2**63 - 1))
            made.append([raw[at : at + SEGMENT] for at in rng.integers(0, len(raw) - SEGMENT + 1, EPOCHS).tolist()] if len(raw) > SEGMENT else [raw])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.binary()))], ["doc_id", "label", "parts"])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityNet:
    """A network fitted on at most sample_rows labelled texts outside the held-out fold, EPOCHS segments of each; without any, one that says 1/2."""
    some = labelled_texts(docs, labels, "quality", sample_rows).select("doc_id", "label", "text")
    rows = sorted(some.mapInArrow(_segments, "doc_id long, label int, parts array<binary>").collect())
    net = QualityNet()
    if rows:
        net.fit([[bytes(x) for x in r["parts"]] for r in rows], np.array([r["label"] for r in rows]), EPOCHS)
    else:
        net.w["out"][:] = 0
    return net


def _score(net: QualityNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            scores = net.scores(*utf8(batch.column(last)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [str(i) for i in range(last + 1)])

    return run


def score_quality(docs: DataFrame, net: QualityNet, text_col: str = "text", score_col: str = "quality_score", keep_text: bool = False) -> DataFrame:
    """docs with the whole text's score, and without the text unless keep_text; a column of that name is replaced.

    Null and empty texts get the score of a chunk of padding.
    """
    keep = [c for c in docs.columns if c.lower() != score_col.lower() and (keep_text or c.lower() != text_col.lower())]
    fed = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(fresh(docs, "scored")))
    return fed.mapInArrow(_score(net), docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(score_col, "double"))
