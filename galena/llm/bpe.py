"""Byte-pair encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

Reads a tokenizer file of the `tokenizers` JSON format whose model is BPE over byte-level symbols with a
word-end suffix, with a normaliser of NFC, white space to one space and lower case, and whose words are
contractions, runs of letters, single numbers and runs of other signs. Added tokens are found in the raw text
first. Ids and decoded texts equal the library's.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.llm.packing import release
from galena.llm.session import fresh

# fixed values: the white space that \s means in the tokenizer's pattern language
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
# fixed values: the contractions that are words of their own
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
# str.split() also cuts at these four, the tokenizer does not
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE_RUNS = re.compile(f"[{WHITE}]+")
CACHE_WORDS = 60_000
LONGEST_CACHED = 64


def _ranges(kind: str) -> str:
    """A regular-expression class body of all characters whose category begins with kind."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + (f"-{re.escape(chr(c - 1))}" if c - 1 > start else ""))
            start = None
    return "".join(out)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Words(dict):
    """word -> its ids as little-endian int32 bytes; two generations of bounded size, so frequent words stay."""

    def __init__(self, encode, most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BytePairs:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {text: np.array([i], "<i4").tobytes() for text, i in added.items()}
        names = [""] * (1 + max([*vocab.values(), *added.values()]))
        for text, i in [*vocab.items(), *added.items()]:
            names[i] = text
        self.names = pa.array(names, pa.large_string())
        symbols = _byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.end] for s in symbols]
        letters, numbers = _ranges("L"), _ranges("N")
        self.find = re.compile(f"{'|'.join(CONTRACTIONS)}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+").findall
        self.marks = sorted({text[:1] for text in added})
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")").split if added else lambda text: [text]
        self.words = Words(self.encode_word, CACHE_WORDS // 2)
        # no word goes over white space, so what stands between it is looked up first and cut into words only when new
        self.chunks = Words(lambda chunk: b"".join(map(self.words.__getitem__, self.find(chunk))))

    def encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n = len(ids)
        merges = self.merges
        queue = []
        for at in range(n - 1):
            found = merges.get((ids[at], ids[at + 1]))
            if found:
                queue.append((found[0], at, found[1], ids[at], ids[at + 1]))
        if not queue:
            return np.array(ids, "<i4").tobytes()
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        while queue:
            _, at, merged, left, right = heapq.heappop(queue)
            nxt = after[at]
            if ids[at] != left or nxt < 0 or ids[nxt] != right:
                continue  # one of the two symbols has merged since
            ids[at], ids[nxt] = merged, -1
            far = after[at] = after[nxt]
            if far >= 0:
                before[far] = at
                if found := merges.get((merged, ids[far])):
                    heapq.heappush(queue, (found[0], at, found[1], merged, ids[far]))
            near = before[at]
            if near >= 0 and (found := merges.get((ids[near], merged))):
                heapq.heappush(queue, (found[0], near, found[1], ids[near], merged))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def normalise(self, text: str) -> str:
        # str.lower() would turn a final capital sigma into its final form; the library lowers each character alone
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_text(self, text: str) -> bytes:
        """All ids of a text as little-endian int32 bytes."""
        parts = self.split(text) if any(mark in text for mark in self.marks) else [text]
        out = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                text = self.normalise(part)
                chunks = text.split() if _SEPARATORS.search(text) is None else _WHITE_RUNS.split(text)
                out += map(self.chunks.__getitem__, chunks)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        made = [self.encode_text(t) if t else b"" for t in texts]
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) // 4 for x in made], dtype=np.int64)])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(made), "<i4")))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The vocabulary's strings of the ids, one space between two, as the library joins them where no decoder is given."""
        names = pc.take(self.names, ids.values)
        return pc.cast(pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names), pa.scalar(" ", pa.large_string())), pa.string())


@lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    return BytePairs(path)


#: Texts of so many bytes, or rows of so many ids, are in memory with their ids at once; a longer text is alone.
MOST_BYTES, MOST_ROWS = 2 << 20, 512


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows whose sizes add up to MOST_BYTES at most, or of one larger row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = min(at + MOST_ROWS, max(at + 1, int(np.searchsorted(ends, before + MOST_BYTES, "right"))))
        yield at, end
        at = end


def _encode(path: str, encode: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for whole in batches:
            column = whole.column(whole.num_columns - 1)
            sizes = pc.fill_null(pc.binary_length(column) if encode else pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, end in _cuts(sizes):
                batch = whole.slice(at, end - at)
                last = batch.column(batch.num_columns - 1)
                ids = pairs.encode(last.to_pylist()) if encode else pa.ListArray.from_arrays(*_flat(last))
                more = [ids] * encode + [pairs.decode(ids)] * decode
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [str(i) for i in range(batch.num_columns - 1 + len(more))])
            release()

    return run


def _flat(ids: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), ids.flatten()


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded", decode: bool = True) -> DataFrame:
    """docs without the text, with `ids_col` array<int> and, if asked for, `decoded_col` string.

    Null text counts as empty: no ids, decoded text empty. Other columns pass through; of those named as the
    new ones, only the new stay. tokenizer: a path that every executor can read.
    """
    new = {ids_col.lower(), decoded_col.lower(), text_col.lower()} if decode else {ids_col.lower(), text_col.lower()}
    keep = [c for c in docs.columns if c.lower() not in new]
    last = fresh(docs, "text")
    fed = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(last))
    schema = fed.drop(last).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    if decode:
        schema = schema.add(decoded_col, "string")
    return fed.mapInArrow(_encode(tokenizer, True, decode), schema)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """rows with `decoded_col`, the text of the ids in `ids_col`; null ids give the empty text."""
    keep = [c for c in rows.columns if c.lower() not in {decoded_col.lower(), ids_col.lower()}]
    fed = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids_col}`"))
    # the ids go along, so they are read twice: as themselves and as the last column
    fed = fed.withColumn(fresh(rows, "ids"), F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")))
    return fed.mapInArrow(_encode(tokenizer, False, True), fed.drop(fed.columns[-1]).schema.add(decoded_col, "string"))
