"""Token ids of a corpus in files, and back: canonical length-limited Huffman codes in independent blocks.

A folder of token files holds three Parquet tables. `codes` has one row: the length of every id's code, from which the canonical
codes follow. `blocks` has a row for each run of ids of the concatenated documents, in ascending doc_id order: its place and
one binary value that can be decoded with the code lengths alone. `files` has the number of ids before each file.

A block is, little-endian: "GTK1", then as uint32 the number of ids n, of documents d and the spacing s of checkpoints; ceil(n / s)
uint32 bit offsets, one for every s-th id; d records of DOC (the document, how many of its
ids come before the block, how many are in it, how many it has); the bits, most significant first. A document may span blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm.packing import release
from galena.llm.session import forget, shuffle_width, written

#: The longest code, in bits; a table of 2**MAX_BITS entries decodes.
MAX_BITS = 18
#: Ids of a block, and between two checkpoints in it.
BLOCK_IDS, CHECKPOINT = 1 << 16, 256
#: Ids of one row of the written ids, ids of a file, and characters of a text that are cut into words at once.
PART_IDS, FILE_IDS, SLICE = 1 << 20, 1 << 25, 1 << 20
#: Parts of texts whose ids are kept, and their characters, in either of two generations; words of one call of the model.
KEPT_PARTS, KEPT_BYTES, WORDS_TOGETHER = 600_000, 16 << 20, 24
#: Bytes of the texts whose parts are looked up together, and of a text that is taken alone.
TEXTS_TOGETHER, ALONE = 8 << 20, 1 << 20
MAGIC = b"GTK1"
DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("before", "<u8"), ("n", "<u4"), ("total", "<u8")])

# fixed values: the white space that \s means in the tokenizer's pattern language
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
# letters up to an ASCII sign that is neither letter nor apostrophe are one word of byte-level BPE; so is one line break before something else
_WORD = re.compile(f" ?[{_LETTER}]+(?=[\\x00-&(-@\\[-`{{-\\x7f]|\\Z)|[\t-\r](?=[^{WHITE}])")
_PARTS = re.compile(f"{_WORD.pattern}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_BLANK, _STOPS = frozenset(WHITE), ".,"
_EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


class Encoder:
    """The tokenizers library's ids of whole texts, as little-endian integers of `kind`.

    Byte-level BPE without normaliser or prefix space never joins what stands before white space with it, nor letters with an ASCII sign behind them, so such
    texts are cut there and the library encodes each different part once; parts are kept in two generations of bounded size. Words of
    letters go to its model many at a time, a control sign between two that no longer id of the vocabulary
    holds. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, most_id: int = 0) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.vocabulary = 1 + max([most_id, *vocabulary.values()])
        self.kind = _kind(self.vocabulary)
        before, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and spec["normalizer"] is None
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.cuts = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(WHITE) for t in added)
        self.added = [t["content"] for t in added]
        self.model, self.known, self.old, self.held = self.library.model, {}, {}, 0
        symbols = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else "" for b in range(256)]
        spare = iter(range(256, 512))
        self.symbols = {b: s or chr(next(spare)) for b, s in enumerate(symbols)}
        longer = set().union(*(t for t in vocabulary if len(t) > 1))
        self.sign = next((chr(b) for b in range(32) if self.symbols[b] in vocabulary and self.symbols[b] not in longer), None)
        self.border = vocabulary[self.symbols[ord(self.sign)]] if self.sign else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _tokens(self, words: list[str]) -> np.ndarray:
        joined = (self.sign or "").join(words)
        if joined.isascii():
            for sign in {" ", self.sign or " "}:
                joined = joined.replace(sign, self.symbols[ord(sign)])
        else:
            joined = joined.encode().decode("latin-1").translate(self.symbols)
        return np.array([t.id for t in self.model.tokenize(joined)], self.kind)

    def _found(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces of texts; those of their parts are kept."""
        if len(self.known) > KEPT_PARTS or self.held > KEPT_BYTES:
            self.old, self.known, self.held = self.known, {}, 0
        known, old, words, made = self.known, self.old, {}, []
        out = list(map(known.get, pieces))
        for i, ids in enumerate(out):
            if ids is not None:
                continue
            piece = pieces[i]
            if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                made.append((i, (piece,)))
                if piece not in known and piece not in words:
                    self.held += len(piece)
                    if (ids := old.get(piece)) is None:
                        words[piece] = None
                    else:
                        known[piece] = ids
                continue
            parts = _PARTS.findall(piece)
            made.append((i, parts))
            for part in parts:
                if part in known or part in words:
                    continue
                self.held += len(part)
                if (ids := old.get(part)) is not None:
                    known[part] = ids
                elif part[-1] not in _BLANK and _WORD.fullmatch(part):
                    words[part] = None
                else:
                    known[part] = self._whole(part)
        words, together = sorted(words, key=str.isascii), WORDS_TOGETHER if self.sign else 1  # groups of ASCII letters need fewer marks
        size = self.kind.itemsize
        for at in range(0, len(words), together):
            some = words[at : at + together]
            ids = self._tokens(some)
            ends = [*np.flatnonzero(ids == self.border).tolist(), len(ids)] if self.sign else [len(ids)]
            raw, low = ids.tobytes(), 0
            for word, end in zip(some, ends, strict=True):
                known[word] = raw[low : end * size]
                low = (end + 1) * size
        for i, parts in made:
            out[i] = known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts))
        return out

    def _stretch(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self._whole(text)
        parts = _PARTS.findall(text)
        places = {part: i for i, part in enumerate(dict.fromkeys(parts))}
        ids = self._found(list(places))
        return b"".join([ids[places[part]] for part in parts])

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of these texts; what stands between their spaces is looked up once for all of them."""
        texts = pc.fill_null(texts, "")
        odd = np.full(len(texts), not self.cuts)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out = [np.concatenate([np.zeros(0, self.kind), *self.runs(text.as_py())]) if alone else None for text, alone in zip(texts, odd, strict=True)]
        if odd.all():
            return out
        texts = texts.filter(pa.array(~odd))
        # where no two signs of white space meet and no point or comma follows one, these and line breaks become pieces of their own
        even = pc.invert(pc.match_substring_regex(texts, f"[{WHITE}][{WHITE}.,]"))
        apart = pc.replace_substring(texts, "\n", " \n ")
        for sign in _STOPS:
            apart = pc.replace_substring(apart, f"{sign} ", f" {sign} ")
        lists = pc.split_pattern(pc.if_else(even, apart, texts), " ")
        del apart
        coded = lists.flatten().dictionary_encode()
        if len(coded.dictionary) > KEPT_PARTS // 2 and len(texts) > 1:  # words that hardly repeat are taken fewer at a time
            del lists, coded
            half = len(texts) // 2
            for i, some in zip(np.flatnonzero(~odd).tolist(), [*self.many(texts[:half]), *self.many(texts[half:])], strict=True):
                out[i] = some
            return out
        words, at = coded.dictionary, coded.indices.to_numpy()
        counts = pc.list_value_length(lists).to_numpy()
        ends = np.cumsum(counts)
        even = np.repeat(even.to_numpy(zero_copy_only=False), counts)
        breaks, stops = ((at[:, None] == [pc.index(words, pa.scalar(s, words.type)).as_py() for s in signs]).any(1) & even for signs in ("\n", _STOPS))
        # a piece goes from a space to the next; a text's first one has no space before it, nor have those signs and what follows a line break
        bare = breaks | stops
        bare[1:] |= breaks[:-1]
        bare[ends - counts] = True
        spaced, plain = np.zeros((2, len(words)), bool)
        spaced[at[~bare]], plain[at[bare]] = True, True
        at = np.where(bare, spaced.sum(dtype=np.int32) + np.cumsum(plain, dtype=np.int32)[at], np.cumsum(spaced, dtype=np.int32)[at]) - 1
        pieces = pa.concat_arrays([pc.binary_join_element_wise("", words.filter(pa.array(spaced)), " "), words.filter(pa.array(plain))])
        # texts are not cut between two signs of white space, nor before a point or comma but behind a letter or digit: such a piece goes on
        last = pc.utf8_slice_codeunits(pieces, -1)
        on = pc.is_in(last, value_set=pa.array(list(WHITE), pieces.type)).to_numpy(zero_copy_only=False)[at] & ~breaks
        on[:-1] |= stops[1:] & ~pc.match_substring_regex(last, f"[0-9{_LETTER}]").to_numpy(zero_copy_only=False)[at[:-1]]
        on[ends - 1] = False
        pieces = pieces.to_numpy(zero_copy_only=False).tolist()
        if on.any():
            longer, before = {"": len(pieces)}, np.concatenate([[False], on[:-1]])
            for low, high in zip(np.flatnonzero(on & ~before).tolist(), np.flatnonzero(before & ~on).tolist(), strict=True):
                piece = "".join([pieces[i] for i in at[low : high + 1].tolist()])
                at[low] = longer.setdefault(piece, len(pieces) + len(longer))
                at[low + 1 : high + 1] = len(pieces)
            pieces += longer
        ids = self._found(pieces)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // self.kind.itemsize
        here = sizes[at]
        until = np.cumsum(here, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), self.kind)
        places = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[at] - (until - here), here)
        places += np.arange(until[-1], dtype=np.int32)
        for i, some in zip(np.flatnonzero(~odd).tolist(), np.split(flat[places], until[ends[:-1] - 1]), strict=True):
            out[i] = some
        return out

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The text's ids in runs of bounded size; a word of its own is never cut."""
        if not self.cuts:
            yield np.frombuffer(self._whole(text), self.kind)
            return
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE and (edge := _EDGE.search(text, at + SLICE)):
                end = edge.start()
            yield np.frombuffer(self._stretch(text if end - at == len(text) else text[at:end]), self.kind)
            at = end


@lru_cache(maxsize=1)
def _loaded(path: str, most_id: int) -> Encoder:
    """One encoder a worker, which keeps what it knows from task to task."""
    return Encoder(path, most_id)


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(ids: np.ndarray) -> bytes:
    """Byte plane by byte plane, compressed."""
    return _zip.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, ids.itemsize).T).tobytes())


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(_unzip.decompress(data), np.uint8).reshape(kind.itemsize, -1)
    out = planes[0].astype(kind)
    for k in range(1, kind.itemsize):
        out |= planes[k].astype(kind) << kind.type(8 * k)
    return out


IDS = "doc_id long, tie long, row long, part int, before long, n long, total long, ids binary"
#: A task's last row, whose part is -1, has no ids but how often each occurs in the task's rows.
COUNTED = f"{IDS}, seen array<int>, times array<long>"


def _each(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each row's document and ids; texts of TEXTS_TOGETHER bytes are encoded at once, a long one alone."""
    for batch in batches:
        docs, texts = batch.columns
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group, long = np.cumsum(sizes) // TEXTS_TOGETHER, sizes > ALONE
        cuts = np.flatnonzero((group[1:] != group[:-1]) | long[1:] | long[:-1]) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            if low == high:
                continue
            ids = [np.concatenate([*encoder.runs(texts[low].as_py())])] if long[low] else encoder.many(texts.slice(low, high - low))
            yield from zip(docs.slice(low, high - low).to_pylist(), ids, strict=True)


def _ids(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, out, held = _loaded(path, end_id), TaskContext.get().partitionId() << 33, [], 0
        names = [c.split()[0] for c in COUNTED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        counts = np.zeros(encoder.vocabulary, np.int64)
        fresh, waiting = [], 0
        end = np.array([end_id], encoder.kind)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        for doc_id, ids in _each(encoder, batches):
            ids, tie, total = np.concatenate([ids, end]), 0, 0
            parts = []
            fresh.append(ids)
            waiting += len(ids)
            if waiting > PART_IDS:
                counts += np.bincount(np.concatenate(fresh), minlength=len(counts))
                fresh, waiting = [], 0
            for at in range(0, len(ids), PART_IDS):
                part = ids[at : at + PART_IDS]
                tie = zlib.crc32(part.tobytes(), tie)
                parts.append((len(part), _packed(part)))
            for k, (n, data) in enumerate(parts):
                out.append((doc_id, tie, row, k, total, n, len(ids), data, None, None))
                total += n
                held += len(data)
            row += 1
            if held >= 4 << 20 or len(out) >= 2000:
                yield flush()
                out.clear()
                held = 0
        if fresh:
            counts += np.bincount(np.concatenate(fresh), minlength=len(counts))
        seen = np.flatnonzero(counts)
        out.append((None, 0, row, -1, 0, 0, 0, b"", seen.astype(np.int32), counts[seen]))
        yield flush()
        release()

    return run


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, in parts of PART_IDS at most: doc_id, tie, row, part, before, n, total, ids (packed).

    tie is a crc32 of all its ids, row tells rows of one id apart. Null text counts as empty: the end id alone.
    """
    return _counted(docs, tokenizer, end_id, id_col, text_col).where("part >= 0").drop("seen", "times")


def _counted(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return slim.mapInArrow(_ids(tokenizer, end_id), COUNTED)


def _kind(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def global_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id below `vocabulary` occurs, from the counts that tasks have put behind their rows."""
    pairs = ids.select(F.explode(F.arrays_zip("seen", "times")).alias("c"))
    out = np.zeros(vocabulary, np.int64)
    for i, n in pairs.groupBy("c.seen").agg(F.sum("c.times")).collect():
        out[i] = n
    return out


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """The lengths of an optimal prefix code of at most `most` bits, by package-merge; 0 for ids that do not occur.

    Where more ids occur than 2**most, ValueError; one id alone gets one bit.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need codes of more than {most} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    merged, kinds = leaves, []
    for _ in range(most - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        kinds.append(order < len(leaves))
        merged = both[order]
    taken = 2 * len(leaves) - 2
    for leaf in reversed(kinds):
        own = int(leaf[:taken].sum())
        lengths[used[:own]] += 1
        taken = 2 * (taken - own)
    lengths[used[:taken]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes in order of length, then id, each the one before plus one."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    codes = np.zeros(len(lengths), np.uint64)
    if len(used):
        size = lengths[used].astype(np.int64)
        most = int(size[-1])
        # as fractions of 2**most each code begins where the one before ends
        codes[used] = (np.concatenate([[0], np.cumsum(1 << (most - size))[:-1]]) >> (most - size)).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) for each value of the next `bits` bits, and bits."""
    used = np.flatnonzero(lengths)
    if not len(used):
        return np.zeros(1, np.uint32), np.ones(1, np.uint8), 0
    used = used[np.argsort(lengths[used], kind="stable")]
    bits = int(lengths[used[-1]])
    times = 1 << (bits - lengths[used].astype(np.int64))
    ids, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    ids[: times.sum()] = np.repeat(used.astype(np.uint32), times)
    sizes[: times.sum()] = np.repeat(lengths[used], times)
    return ids, sizes, bits


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after another, and each one's first bit."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at, code = end - size, codes[ids]
    word, room = at >> 6, 64 - (at & 63) - size
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[begins]] = np.bitwise_or.reduceat(high, begins)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(end[-1] + 7) >> 3], at


def read_bits(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """counts[i] ids from bit starts[i] on, all runs side by side: a step of the table gives one id of every run."""
    ids, sizes, bits = table
    steps = int(counts.max()) if len(counts) else 0
    padded = np.concatenate([data, np.zeros(8 + (steps * bits >> 3), np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    out = np.empty((steps, len(starts)), np.uint32)
    at, down = starts.astype(np.int64), np.uint32(32 - bits)
    for step in range(steps):
        here = (window[at >> 3] << (at & 7).astype(np.uint32)) >> down if bits else np.zeros(len(at), np.uint32)
        out[step] = ids[here]
        at = at + sizes[here]
        if step + 1 < steps:
            np.minimum(at, (len(window) - 1) << 3, out=at)  # a run that has ended reads on over what it does not use
    return out.T[np.arange(steps) < counts[:, None]]


def make_block(ids: np.ndarray, docs: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    bits, at = write_bits(ids, codes, lengths)
    return MAGIC + struct.pack("<III", len(ids), len(docs), CHECKPOINT) + at[::CHECKPOINT].astype("<u4").tobytes() + docs.astype(DOC).tobytes() + bits


def read_blocks(blocks: list[bytes], table: tuple[np.ndarray, np.ndarray, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, documents) of each block; the checkpoints of all are decoded at once."""
    heads, bits, starts, counts, base = [], [], [], [], 0
    for block in blocks:
        n, d, s = struct.unpack_from("<III", block, 4)
        if block[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        marks = -(-n // s)
        docs = np.frombuffer(block, DOC, d, 16 + 4 * marks)
        raw = np.frombuffer(block, np.uint8, -1, 16 + 4 * marks + d * DOC.itemsize)
        heads.append((n, docs))
        bits.append(raw)
        starts.append(np.frombuffer(block, "<u4", marks, 16).astype(np.int64) + 8 * base)
        counts.append(np.minimum(s, n - s * np.arange(marks)))
        base += len(raw)
    if not blocks:
        return []
    ids = read_bits(np.concatenate(bits), np.concatenate(starts), np.concatenate(counts), table)
    ends = np.cumsum([n for n, _ in heads])
    return [(ids[e - n : e], docs) for e, (n, docs) in zip(ends, heads, strict=True)]


BLOCK = "file int, block int, start long, n int, first_doc long, last_doc long, data binary"


def _blocks(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, kind = canonical_codes(lengths), _kind(len(lengths))
        file, block, start = TaskContext.get().partitionId(), 0, 0
        held, docs, size, out = [], [], 0, []

        def close() -> None:
            nonlocal held, docs, size, block, start
            ids = np.concatenate(held)
            named = [d[0] for d in docs if d[1]]
            out.append((file, block, start, len(ids), named[0] if named else None, named[-1] if named else None, make_block(ids, np.array(docs, DOC), codes, lengths)))
            block, start = block + 1, start + len(ids)
            held, docs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in BLOCK.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for doc_id, before, total, data in zip(*(batch.column(k) for k in ("doc_id", "before", "total", "ids")), strict=True):
                ids, doc_id, before = _unpacked(data.as_py(), kind), doc_id.as_py(), before.as_py()
                at = 0
                while at < len(ids):
                    part = ids[at : at + BLOCK_IDS - size]
                    docs.append((doc_id or 0, doc_id is not None, before + at, len(part), total.as_py()))
                    held.append(part)
                    size, at = size + len(part), at + len(part)
                    if size == BLOCK_IDS:
                        close()
                        if len(out) >= 16:
                            yield flush()
        if size:
            close()
        if out:
            yield flush()
        release()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Token files of docs under `path`, a folder that Spark can write; returns it.

    Each text's ids are followed by end_id. Documents stand in ascending doc_id order; rows without an id come first, rows of one id in an
    order of their ids' crc32. Null and empty texts are the end id alone. Ids are cut at PART_IDS, so one very long text neither
    makes one row nor one block. An empty table gives files without blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = _loaded(tokenizer, end_id).vocabulary
    ids = written(_counted(docs, tokenizer, end_id, id_col, text_col), "ids")
    counts = global_counts(ids, vocabulary)
    most = max(MAX_BITS, int(np.count_nonzero(counts)).bit_length())
    lengths = code_lengths(counts, most)
    order = ["doc_id", "tie", "row", "part"]
    width = shuffle_width(spark, int(counts.sum()), FILE_IDS)
    ordered = ids.where("part >= 0").drop("seen", "times").repartitionByRange(width, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(_blocks(lengths), BLOCK).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    files = sorted(blocks.groupBy("file").agg(F.sum("n")).collect())
    starts = np.cumsum([0, *(n for _, n in files)])
    spark.createDataFrame([(f, int(at)) for (f, _), at in zip(files, starts, strict=False)], "file int, first long").coalesce(1).write.parquet(f"{path}/files")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    forget(ids)
    return path


def _read(lengths: np.ndarray, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found = read_blocks([x.as_py() for x in part.column("data")], table)
                columns = [[], [], [], [], []]
                for first, (ids, docs) in zip(part.column("start").to_numpy(), found, strict=True):
                    n, before, total = (docs[k].astype(np.int64) for k in ("n", "before", "total"))
                    ends = np.cumsum(n)
                    whole = ids.astype("<u4")
                    for k, value in enumerate((pa.array(docs["doc_id"], mask=docs["has_id"] == 0), first + ends - n - before, total, before)):
                        columns[k].append(value if k == 0 else pa.array(value))
                    if digests:
                        later = (total - before - n).tolist()
                        crcs = [zlib.crc32(whole[e - c : e]) for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                        columns[4].append(pa.array([crc_before(c, 4 * m) for c, m in zip(crcs, later, strict=True)], pa.int64()))
                    else:
                        columns[4].append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                names = ["doc_id", "start", "n_tokens", "before", "ids_crc32" if digests else "token_ids"]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names)
        release()

    return run


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks with their places in the whole stream, and the code lengths."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codes").first()[0], np.uint8)
    files = spark.read.parquet(f"{path}/files")  # a row a file of FILE_IDS ids or so
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(F.broadcast(files), "file")
    return blocks.withColumn("start", F.col("start") + F.col("first")), lengths


def read_token_files(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, before, token_ids): the ids that the files hold, a row for each document and block.

    start counts the ids of all documents before it, n_tokens its own, before those of its ids that stand in earlier blocks. Blocks that hold
    no document from first_doc to last_doc are not read; others of their documents come along.
    """
    blocks, lengths = _opened(spark, path)
    if first_doc is not None:
        blocks = blocks.where(F.col("last_doc") >= first_doc)
    if last_doc is not None:
        blocks = blocks.where(F.col("first_doc") <= last_doc)
    return blocks.select("start", "data").mapInArrow(_read(lengths, False), "doc_id long, start long, n_tokens long, before long, token_ids array<long>")


def _times(a: int, b: int) -> int:
    """Product modulo the polynomial of crc32, whose bits stand in reverse."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_before(crc: int, after: int) -> int:
    """What bytes of this crc32 add, by exclusive or, to the crc32 of themselves and `after` bytes behind them."""
    power, square = 1 << 31, 1 << 23  # one, and the shift by a byte
    while after:
        if after & 1:
            power = _times(power, square)
        square, after = _times(square, square), after >> 1
    return crc if power == 1 << 31 else _times(power, crc)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): a row for each document, from the files alone.

    Every part of a document brings its crc32 moved to its place, so parts meet by exclusive or in any order.
    """
    blocks, lengths = _opened(spark, path)
    parts = blocks.select("start", "data").mapInArrow(_read(lengths, True), "doc_id long, start long, n_tokens long, before long, ids_crc32 long")
    return parts.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("ids_crc32").alias("ids_crc32"))


__all__ = ["Encoder", "canonical_codes", "code_lengths", "decoding_table", "digests", "read_token_files", "token_ids", "write_token_files"]
