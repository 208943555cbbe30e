"""Cases that earlier versions of the operators got wrong."""

import hashlib
import html
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galena.llm import exact_dedup, language_id, lm, mixing, ngram_join, topk, vectext


def _thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIR = _thue_morse(1024, "ab"), _thue_morse(1024, "ba")


# --- words


def test_words_that_collide_as_sums_of_powers_do_not():
    short = _thue_morse(64, "ab"), _thue_morse(64, "ba")
    texts = [*PAIR, *short, "ab" * 8 + "ba" * 8, "ba" * 8 + "ab" * 8, "a" * 16, "a" * 17, "a" * 8 + "b" * 8, "b" * 8 + "a" * 8]
    w = vectext.batch_words(pa.array(texts))
    assert len(set(w.hashes.tolist())) == len(texts)


def test_hashes_tell_words_apart_and_not_places(monkeypatch):
    rng = random.Random(1)
    known = {}
    for size in (64, 100, 1 << 18):
        monkeypatch.setattr(vectext, "PIECE_BYTES", size)
        rng.seed(5)
        for _ in range(150):
            texts = [" ".join("".join(rng.choice("abcéB中") for _ in range(rng.choice([1, 3, 7, 8, 9, 16, 30, 63, 64, 65, 200, 700]))) for _ in range(rng.randrange(5))) for _ in range(4)]
            w = vectext.batch_words(pa.array(texts))
            plain = [x for t in texts for x in t.translate({c: c + 32 for c in range(65, 91)}).split()]
            assert len(plain) == len(w.hashes) and w.first.tolist() == np.cumsum([0, *(len(t.split()) for t in texts)]).tolist()
            for word, h in zip(plain, w.hashes.tolist(), strict=True):
                assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_documents_of_colliding_words_are_not_linked(spark):
    docs = spark.createDataFrame([(1, PAIR[0]), (2, PAIR[1]), (3, PAIR[0].upper()), (4, " ".join([PAIR[0]] * 6)), (5, " ".join([PAIR[1]] * 6))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_colliding_words_are_two_tokens(spark):
    train = spark.createDataFrame([(1, f"{PAIR[0]} x")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, f"{PAIR[0]} x"), (2, f"{PAIR[1]} x")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in lm.score_texts(train, asked).collect()}
    assert got == {1: 3, 2: 2}


# --- mixing


def test_even_shares_go_as_far_as_the_target_or_the_limit_asks(spark):
    shares = spark.createDataFrame([(0.5001,), (0.4999,)], "share double")
    t = mixing.temperature(shares, None, 0.9)
    w = np.array([0.5001, 0.4999]) / 0.5001
    w = w**t / (w**t).sum()
    assert t > 1000 and abs(-(w * np.log(w)).sum() / math.log(2) - 0.9) < 1e-6
    limited = mixing.temperature(shares, 2.0, 0.9)
    assert abs((0.5001 / 0.4999) ** (limited - 1) - 2) < 1e-6
    even = spark.createDataFrame([(0.25,), (0.25,), (0.25,), (0.25 - 1e-3,)], "share double")
    assert math.isfinite(mixing.temperature(even, None, 0.5))  # three largest sources: the entropy cannot fall that far


# --- top-k


def test_every_row_but_the_querys_own_is_a_candidate(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 2.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.5, 0.5]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    ints = topk.integer_vectors(df)
    got = Counter(map(tuple, topk.exact_top_k(ints, ints.where("vec_id % 50 = 0"), 4, candidate_block=3, query_block=2).collect()))
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, u, strict=True)), c) for j, (c, u) in enumerate(rows) if j != i)
            want.update((q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:4]))
    assert got == want


def test_products_beyond_exact_doubles_are_an_error(spark):
    big = spark.createDataFrame([(50, [4e5] * 4), (1, [4e5] * 4)], "vec_id long, embedding array<double>")
    ints = topk.integer_vectors(big)
    with pytest.raises(Exception, match="might not be exact"):
        topk.exact_top_k(ints, ints.where("vec_id = 50")).collect()


# --- pages


def _plain_visible(page):
    """What a reader sees of a page without comments and scripts, a sign at a time."""
    out, at = "", 0
    while at < len(page):
        end = page.find(">", at)
        if page[at] == "<" and end >= 0:
            out, at = out + " ", end + 1
        else:
            out, at = out + page[at], at + 1
    return html.unescape(out)


def test_pages_without_ends_are_read_once():
    for page in ("<" * 1_000_000, "<!--" * 250_000, "<a" * 500_000, "<script" * 140_000, "x<!-- " * 150_000 + ">"):
        began = time.process_time()
        language_id.visible_text(page)
        assert time.process_time() - began < 1.5, page[:8]
    assert language_id.visible_text("a<b>c<d e").split() == ["a", "c<d", "e"]
    assert language_id.visible_text("a > b <!-- c <!-- d").split() == ["a", ">", "b", "c", "d"]
    assert language_id.visible_text("<p>one</p><!-- no --><i>two").split() == ["one", "two"]


def test_odd_pages_equal_a_plain_pass():
    rng = random.Random(3)
    for _ in range(500):
        page = "".join(rng.choice(["<", ">", "a", " b ", "<p>", "</p>", "&amp;", "x=1", "--", "\n"]) for _ in range(rng.randrange(30)))
        if "<!--" not in page:
            assert language_id.visible_text(page).split() == _plain_visible(page).split(), page


def test_declarations_are_found_in_linear_time(spark):
    pages = ["<html lang='de'>", "<HTML class=x LANG = \"fr-CA\">", "<html><meta http-equiv='content-language' content='es'>", "<html" * 60_000, "<meta content-language " * 30_000, "<meta " + "content-language " * 60_000, "<p lang=it>", None]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").coalesce(1).orderBy("i").select(language_id.declared_language(F.col("p"))).collect()]
    assert got == ["de", "fr", "es", "", "", "", "", ""] and time.time() - began < 20


# --- exact duplicates


def test_index_width_follows_the_rows(spark, monkeypatch):
    """One text of a third of all rows, indexes of a few digests each."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(exact_dedup, "ENTRY_BYTES", 1 << 20)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs).collect()}
    most, size = {}, Counter(t for _, t in rows)
    for i, t in rows:
        most[t] = max(i, most.get(t, 0))
    assert got == {i: (most[t], size[t], i == most[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
