"""Token files, vector codes and ranked search against brute-force versions and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galena.llm import lexical, queries, session, tokenfile, vector_codes

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(BYTE_BPE)
    made.no_truncation()
    made.no_padding()
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


# --- token files


def test_encoder_equals_the_library_on_random_texts(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "SLICE", 50)
    rng = random.Random(4)
    bits = ["a", "don't", "'s", "'", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "É", "ß", "×", "中文", "😀", "1", "٣", ".", "--", "<|endoftext|>", "<|endo", "text|>", "\x00", "́", "word", "Word", "ǆ", "ſ", "^", "_", "­", "᠎"]
    encoder = tokenfile.Encoder(BYTE_BPE, 2)
    assert encoder.cuts and encoder.kind == np.dtype("<u2")
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        runs = [*encoder.runs(text)]
        assert (np.concatenate(runs).tolist() if runs else []) == library(text), repr(text)


def test_words_go_to_the_model_many_at_a_time(library):
    encoder = tokenfile.Encoder(BYTE_BPE, 2)

    class Counted:
        model, calls = encoder.model, 0

        def tokenize(self, words):
            self.calls += 1
            return self.model.tokenize(words)

    encoder.model = Counted()
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdeàéñß") for _ in range(9)) for _ in range(480))
    assert np.concatenate([*encoder.runs(text)]).tolist() == library(text)
    assert encoder.model.calls <= 2 * 480 // tokenfile.WORDS_TOGETHER


def test_texts_encoded_together_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "KEPT_PARTS", 300)
    monkeypatch.setattr(tokenfile, "TEXTS_TOGETHER", 3000)
    monkeypatch.setattr(tokenfile, "ALONE", 130)
    rng = random.Random(6)
    tidy = ["word", "Été", "b'", "don't", "1", "x9", ".", ",", "!", "!.", "'s.", "a.", "b,", "\n", " ", " ", " ", "  ", "\x0b", "\x85", "　", "中文。", "", "<|endoftext|>", "Ntly", "-", "\x00", "٣", "ǆ", " .", ".\n", ". "]
    usual = ["word", "Été.", "dans,", "don't", "x9.", "!.", "-,", "3,", "Ö!!", "it's.", "'.", "...", "٣.", "中.", "\x00"]
    texts = ["".join(rng.choice(tidy) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["".join(rng.choice(usual) + rng.choice("  \n") for _ in range(rng.randrange(20))) for _ in range(1500)]
    texts += [None, "", " ", "\n", ".", ",", ". ", " .", "\n.", ".\n", "a\n", "\na", " a", "a "]
    rng.shuffle(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [*tokenfile._each(tokenfile.Encoder(BYTE_BPE, 2), iter([batch, batch.slice(0, 0), batch.slice(5, 40)]))]
    assert [i for i, _ in got] == [*range(len(texts)), *range(5, 45)]
    for i, ids in got:
        assert ids.dtype == np.dtype("<u2") and ids.tolist() == library(texts[i]), repr(texts[i])


def test_counts_come_with_the_ids(spark, odd_docs, library):
    coded = tokenfile._counted(odd_docs, BYTE_BPE, 2, "doc_id", "text")
    want = Counter(i for r in odd_docs.select("text").collect() for i in [*library(r[0]), 2])
    counts = tokenfile.global_counts(coded, 50_257)
    assert {i: counts[i] for i in np.flatnonzero(counts)} == want
    ids = tokenfile.token_ids(odd_docs, BYTE_BPE, 2)
    assert ids.columns == [c.split()[0] for c in tokenfile.IDS.split(", ")] and ids.agg(F.sum("n")).first()[0] == sum(want.values())


def test_encoder_gives_other_tokenizers_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = tokenfile.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.cuts
    text = "One  two\nthree's   " * 30
    assert np.concatenate([*encoder.runs(text)]).tolist() == plain.encode(text, add_special_tokens=False).ids


def _plain_lengths(counts, most):
    """Optimal limited lengths by trying all sums, for a few symbols."""
    n, best = len(counts), None

    def walk(i, lengths):
        nonlocal best
        if i == n:
            if sum(2.0**-x for x in lengths) <= 1 and (best is None or sum(map(int.__mul__, counts, lengths)) < best):
                best = sum(map(int.__mul__, counts, lengths))
            return
        for x in range(1, most + 1):
            walk(i + 1, [*lengths, x])

    walk(0, [])
    return best


def test_code_lengths_are_optimal_under_the_limit_and_codes_canonical():
    rng = random.Random(1)
    for _ in range(60):
        most = rng.randrange(2, 5)
        counts = [rng.choice([1, 1, 2, 5, 40, 300]) for _ in range(rng.randrange(2, min(6, 2**most) + 1))]
        lengths = tokenfile.code_lengths(np.array(counts), most)
        assert lengths.max() <= most and int((lengths * np.array(counts)).sum()) == _plain_lengths(counts, most)
        assert sum(2.0 ** -int(x) for x in lengths) == 1
        codes = [f"{c:0{n}b}" for c, n in zip(tokenfile.canonical_codes(lengths).tolist(), lengths.tolist(), strict=True)]
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
        by = sorted(range(len(counts)), key=lambda i: (lengths[i], i))
        assert [codes[i] for i in by] == sorted(codes)
    assert tokenfile.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and not tokenfile.code_lengths(np.zeros(3, int)).any()
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(5, int), 2)


def test_blocks_come_back_whole_and_alone(monkeypatch):
    rng = np.random.default_rng(3)
    counts = (rng.pareto(0.7, 3000) * 3).astype(np.int64)
    lengths = tokenfile.code_lengths(counts, 13)
    codes, table, used = tokenfile.canonical_codes(lengths), tokenfile.decoding_table(lengths), np.flatnonzero(counts)
    blocks = []
    for n in (1, 255, 256, 257, 5000):
        ids = rng.choice(used, n, p=counts[used] / counts.sum())
        docs = np.array([(7, 1, 0, n, n)], tokenfile.DOC)
        blocks.append((ids, tokenfile.make_block(ids, docs, codes, lengths)))
    for (ids, _), (got, docs) in zip(blocks, tokenfile.read_blocks([b for _, b in blocks], table), strict=True):
        assert got.tolist() == ids.tolist() and docs["total"].tolist() == [len(ids)]
    alone = tokenfile.read_blocks([blocks[3][1]], table)[0][0]
    assert alone.tolist() == blocks[3][0].tolist()
    # a checkpoint alone is enough to decode what follows it
    ids, raw = blocks[4]
    marks = np.frombuffer(raw, "<u4", -(-len(ids) // 256), 16)
    bits = np.frombuffer(raw, np.uint8, -1, 16 + 4 * len(marks) + tokenfile.DOC.itemsize)
    assert tokenfile.read_bits(bits, marks[9:10].astype(np.int64), np.array([256]), table).tolist() == ids[9 * 256 : 10 * 256].tolist()


def test_crc_parts_meet_by_exclusive_or():
    data = bytes(range(256)) * 5
    cut = [data[:100], data[100:101], data[101:900], data[900:]]
    later = [len(data) - 100, len(data) - 101, len(data) - 900, 0]
    out = 0
    for part, after in zip(cut, later, strict=True):
        out ^= tokenfile.crc_before(zlib.crc32(part), after)
    assert out == zlib.crc32(data)


def _expected(rows, library):
    at, out = 0, []
    keyed = [(-math.inf if i is None else i, [*library(t), 2], i) for i, t in rows]
    for _, ids, i in sorted(keyed, key=lambda r: (r[0], _signed_tie(r[1]))):
        raw = np.array(ids, "<u4").tobytes()
        out.append((i, at, len(ids), zlib.crc32(raw)))
        at += len(ids)
    return out


def _signed_tie(ids):
    return zlib.crc32(np.array(ids, "<u2").tobytes())


@pytest.mark.parametrize("small", [False, True])
def test_token_files_on_odd_rows(spark, odd_docs, library, monkeypatch, small):
    if small:  # blocks are cut on the driver's constants, which tasks get with the functions
        monkeypatch.setattr(tokenfile, "FILE_IDS", 5000)
    path = tokenfile.write_token_files(odd_docs, session.scratch(spark, "files"), BYTE_BPE, 2)
    rows = [(r[0], r[1]) for r in odd_docs.select("doc_id", "text").collect()]
    want = _expected(rows, library)
    got = [tuple(r) for r in tokenfile.digests(spark, path).orderBy("start").collect()]
    assert got == want
    parts = tokenfile.read_token_files(spark, path).orderBy("start", "before").collect()
    stream = [i for p in parts for i in p["token_ids"]]
    assert len(stream) == sum(w[2] for w in want)
    for i, start, n, crc in want:
        assert zlib.crc32(np.array(stream[start : start + n], "<u4").tobytes()) == crc
    assert any(p["before"] for p in parts)  # a long text spans blocks
    near = tokenfile.read_token_files(spark, path, 11, 12).select("doc_id").distinct().collect()
    assert {11, 12} <= {r[0] for r in near}


def test_token_files_of_no_rows(spark, no_docs):
    path = tokenfile.write_token_files(no_docs, session.scratch(spark, "files"), BYTE_BPE, 2)
    assert tokenfile.digests(spark, path).count() == 0 and tokenfile.read_token_files(spark, path).count() == 0


def test_op11_equals_the_library_on_a_whole_table(spark, library):
    docs = [tuple(r) for r in session.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op11_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == _expected(docs, library)


# --- vector codes


def _plain_codes(vectors, parts=8, entries=16, rounds=6, scale=4096):
    """(codes, errors, books) with plain loops; vectors: integer lists in order of their ids."""
    step = len(vectors[0]) // parts
    cut = [[v[p * step : (p + 1) * step] for v in vectors] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(x, books[p])[1] for x in cut[p]]
            for e in range(len(books[p])):
                own = [x for x, i in zip(cut[p], at, strict=True) if i == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(vectors))]
    return ["".join(f"{e:02x}" for _, e in f) for f in found], [sum(d for d, _ in f) for f in found], books


def test_rings_equal_all_distances_with_ties_and_repeats():
    rng = np.random.default_rng(5)
    skipped = 0
    for _ in range(60):
        width, k = int(rng.integers(1, 6)), int(rng.integers(1, 20))
        entries = rng.integers(-4, 5, (k, width))
        rows = rng.integers(-40, 41, (50, width))
        rings = vector_codes.Rings(entries)
        codes, errors = rings.nearest(rows)
        far = ((rows[:, None] - entries[None]) ** 2).sum(2)
        assert codes.tolist() == far.argmin(1).tolist() and errors.tolist() == far.min(1).tolist()
        skipped += 50 * k - rings.evaluated
    assert skipped > 0
    line = vector_codes.Rings(np.arange(1000)[:, None] * 7)
    line.nearest(np.arange(3000)[:, None])
    assert line.evaluated < 3 * 3000  # the annulus holds few of 1,000 entries


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error string").repartition(3)


def test_vector_codes_equal_plain_loops_on_odd_rows(spark):
    rng = random.Random(6)
    good = [(i, [rng.choice([-0.5, 0.25, 0.0001, -0.0001, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([1, 2, None]), "x", "y") for i in range(60)]
    good += [good[3], (None, good[5][1], 1, "x", "y"), (7, [0.0] * 16, 2, "x", "y")]
    bad = [(100, None, 1, "x", "y"), (101, [None] * 16, 1, "x", "y"), (102, [float("nan")] * 16, 1, "x", "y"), (103, [float("inf")] * 16, 1, "x", "y"), (104, [], 1, "x", "y"), (-5, [1.0, 2.0, 3.0], 1, "x", "y"), (105, [1.0] * 8, 1, "x", "y")]
    got = vector_codes.vector_codes(_vectors(spark, good + bad)).collect()
    ints = sorted(([math.floor(4096 * float(np.float32(x))) for x in r[1]], r[0], r[2]) for r in good if r[0] is not None)
    rows = [(i, v, lab) for v, i, lab in sorted(ints, key=lambda r: (r[1], r[0]))] + [(None, [math.floor(4096 * float(np.float32(x))) for x in good[5][1]], 1)]
    codes, errors, books = _plain_codes([v for _, v, _ in rows])
    by = Counter()
    for (_, _, lab), e in zip(rows, errors, strict=True):
        by[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = Counter((i, c, e, by[lab], digest) for (i, _, lab), c, e in zip(rows, codes, errors, strict=True))
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == want


def test_vector_codes_of_few_rows_none_and_too_large(spark):
    assert vector_codes.vector_codes(_vectors(spark, [(1, None, 1, "", "")])).count() == 0
    two = vector_codes.vector_codes(_vectors(spark, [(1, [1.0] * 8, 1, "", ""), (2, [2.0] * 8, None, "", "")])).orderBy("vec_id").collect()
    assert [r["code"] for r in two] == ["00" * 8, "01" * 8] and [r["error"] for r in two] == [0, 0]
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.vector_codes(_vectors(spark, [(1, [1e9] * 8, 1, "", "")])).count()


def test_label_errors_meet_by_shuffle_as_by_broadcast(spark, monkeypatch):
    coded = spark.range(200).selectExpr("id vec_id", "if(id % 3 = 0, null, if(id < 150, 1, id)) label", "hex(id) code", "id error")
    one = sorted(map(tuple, vector_codes.with_label_error(coded).select("vec_id", "label_error").collect()))
    monkeypatch.setattr(vector_codes, "MOST_BROADCAST_LABELS", 1)
    assert one == sorted(map(tuple, vector_codes.with_label_error(coded).select("vec_id", "label_error").collect()))


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _plain_ranking(docs, items, k=50):
    held = [(i, Counter(_plain_terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            n, score = sum(c.values()), 0
            for t in set(_plain_terms(text)) & set(c):
                m = 100 - 50 + (50 * n * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


def test_terms_equal_the_pattern(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 30)
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice(["a", "B", "É", "é", "中", "😀", " ", "\n", "_", "-", "7", "\x00", "\x7f", "\xa0", "word"]) for _ in range(rng.randrange(80)))
        assert lexical.terms(text) == Counter(t.encode() for t in _plain_terms(text))


@pytest.mark.parametrize("block, group", [(4096, 1024), (2, 2)])
def test_ranking_equals_plain_loops(spark, odd_docs, monkeypatch, block, group):
    monkeypatch.setattr(lexical, "QUERIES", group)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "one TWO three unknown"), (2, "short one"), (2, "short one"), (3, None), (4, ""), (None, "É a w1x1 w2x2 no"), (5, "中文 straße b c d e")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("doc_id", F.lit(9))
    for k in (1, 3, 50):
        got = Counter(tuple(r) for r in lexical.ranked_search(odd_docs, asked, k).collect())
        assert got == _plain_ranking(rows, items, k)
        ranks = [r for r in got if r[0] == 1]
        assert sorted(r[1] for r in ranks) == [*range(1, len(ranks) + 1)]


def test_ranking_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.ranked_search(odd_docs, none).count() == 0 and lexical.ranked_search(no_docs, some).count() == 0


def test_bounds_hold_and_few_documents_are_rescored(spark):
    docs = session.table(spark, SF, "documents")
    items = [tuple(r) for r in session.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    index, n, total = lexical.build_index(docs)
    counted = [lexical.terms(t) for _, t in items]
    chosen = lexical._pass(index, counted, 5, n, total).count()
    assert 5 * len(items) <= chosen < 0.5 * len(items) * docs.count()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in lexical.ranked_search(docs, session.table(spark, SF, "benchmark"), 5).collect()) == _plain_ranking(rows, items, 5)
