"""Every operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galena.llm import bpe, components, exact_dedup, language_id, lm, mixing, ngram_join, packing, quality, queries, session, sharding, topk, toxicity, vectext

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(low(text))


# --- shared helpers


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", session.fold(F.col("id"))).collect()
    assert all(b == zlib.crc32(str(a).encode()) % 5 for a, b in got)


def test_words_and_shingles_equal_plain_python():
    texts = ["", "a", "A b\tc\nd  e F g", "x" * 5000, "a b c d", "a b c d", "é ß\x0b中", None, "a b c d e a b c d e a b c d e f"]
    w = vectext.batch_words(pa.array(texts))
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert len(set(w.hashes.tolist())) == len(set(flat))
    assert all((flat[i] == flat[0]) == (w.hashes[i] == w.hashes[0]) for i in range(len(flat)))
    s, first = vectext.shingle_sets(w)
    for i, t in enumerate(texts):
        v = words(t)
        own = {tuple(v[k : k + 5]) for k in range(len(v) - 4)} if len(v) >= 5 else {tuple(v)} if v else set()
        assert first[i + 1] - first[i] == len(own)
    assert s[first[4] : first[5]].tolist() == s[first[5] : first[6]].tolist()


def test_words_do_not_depend_on_where_pieces_end(monkeypatch):
    rng, plain = random.Random(2), []
    for _ in range(60):
        plain.append([None if rng.random() < 0.1 else "".join(rng.choice(["a", "B", " ", "é", "\t", "word ", "xx"]) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(12))])

    def found():
        out = []
        for texts in plain:
            w = vectext.batch_words(pa.array(texts, pa.string()))
            out.append([x.tolist() for x in (w.hashes, w.first, *vectext.shingle_sets(w))])
        return out

    whole = found()
    assert [np.diff(x[1]).tolist() for x in whole] == [[len(words(t)) for t in texts] for texts in plain]
    for size in (1, 2, 3, 7, 16):
        monkeypatch.setattr(vectext, "PIECE_BYTES", size)
        assert found() == whole


def test_packing_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**48, 1000, dtype=np.uint64))
    assert (packing.unpack(packing.pack(x, 6, True), 6, True) == x).all()
    assert (packing.unpack(packing.pack(x)) == x).all()
    assert not len(packing.unpack(packing.pack(np.zeros(0, np.uint64), 6, True), 6, True))


# --- 1 quality


def test_quality_learns_and_reads_the_whole_text():
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "river", "was", "calm", "and", "wide", "today"]) for _ in range(80)) for _ in range(150)]
    bad = [re.sub(" ", "$$$ ", t) for t in good]
    net = quality.QualityNet()
    net.fit([[t.encode()] for t in good + bad], np.array([1] * 150 + [0] * 150), epochs=6)
    texts = [good[0], bad[0], " ".join(good[:60]) + bad[3], "", None]
    got = net.scores(*vectext.utf8(pa.array(texts)))
    assert got[0] > 0.7 and got[1] < 0.3 and got[2] < got[0] - 0.02 and 0 <= got[3] <= 1 and abs(got[3] - got[4]) < 1e-6
    alone = net.scores(*vectext.utf8(pa.array(texts[:1])))
    assert abs(alone[0] - got[0]) < 1e-5  # neighbours in a batch do not matter


def test_quality_gradient():
    net = quality.QualityNet(seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    raw = np.frombuffer(bytes(random.Random(1).choices(range(97, 123), k=700)), np.uint8)
    laid = quality.laid_out(raw, np.array([0, 300, 700]))
    labels = np.array([0.0, 1.0], np.float32)
    _, g = net.gradient(*laid, labels)
    for name, at in (("out", (3,)), ("hidden", (5, 2)), ("filters", (1, 4, 6)), ("embed", (100, 2)), ("bias", (7,))):
        eps, old = 1e-3, net.w[name][at]
        net.w[name][at] = old + eps
        up, _ = net.gradient(*laid, labels)
        net.w[name][at] = old - eps
        down, _ = net.gradient(*laid, labels)
        net.w[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3


def test_quality_long_documents_in_stretches(monkeypatch):
    net = quality.QualityNet()
    rng = random.Random(7)
    monkeypatch.setattr(quality, "PIECE", 4096)
    for size in (300, 4096 * 5, 4096 * 5 + 1, 4096 * 5 - 9, 50_001):
        text = np.frombuffer(bytes(rng.choices(range(32, 127), k=size)), np.uint8)
        whole = net.forward(*quality.laid_out(text, np.array([0, len(text)])))
        assert abs(net._long(text)[0] - whole[0]) < 1e-4


def test_quality_forward_equals_plain_loops():
    """The whole definition without numpy's tricks: embeddings, filters, overlapping chunks, hidden units, one logit."""
    net, rng = quality.QualityNet(seed=3), random.Random(13)
    w = {k: v.astype(float) for k, v in net.w.items()}
    texts = [bytes(rng.choices(range(32, 127), k=k)) for k in (0, 3, 127, 300, 900)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.forward(*quality.laid_out(np.frombuffer(b"".join(texts), np.uint8), offsets))
    for t, logit in zip(texts, got, strict=True):
        halves = max(1, -(-(len(t) + 8) // 128))
        codes = [b + 1 for b in t] + [0] * (halves * 128 + 8 - len(t))
        y = []
        for block in range(halves * 32):
            if 4 * block >= len(t):
                y.append(None)
                continue
            v = w["bias"].copy()
            for k in range(3):
                v += np.concatenate([w["embed"][c] for c in codes[4 * (block + k) : 4 * (block + k) + 4]]) @ w["filters"][k]
            y.append(np.maximum(v, 0))
        best = np.zeros(quality.HIDDEN)
        for chunk in range(max(1, halves - 1)):
            own = [v for v in y[32 * chunk : 32 * chunk + 64] if v is not None]
            mean = sum(own) / len(own) if own else np.zeros(quality.FILTERS)
            top = np.max(own, axis=0) if own else np.zeros(quality.FILTERS)
            best = np.maximum(best, np.concatenate([mean, top, [math.log1p(len(own)) / 4]]) @ w["hidden"] + w["hidden_bias"])
        assert abs(best @ w["out"] + w["out_bias"][0] - logit) < 1e-3


def test_quality_frames(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    net = quality.learn(odd_docs, labels, 10)
    got = quality.score_quality(odd_docs, net, score_col="score", keep_text=True)
    assert got.count() == 15 and set(got.columns) == set(odd_docs.columns)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.score_quality(no_docs, quality.learn(no_docs, labels.limit(0))).count() == 0


# --- 2 toxicity


def test_automaton_equals_edit_distance():
    def distance(a, b):  # with swaps of neighbours
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = ["idiot", "worthless", "scum", "disgustingly", "idol"]
    automaton, rng = toxicity.LexiconAutomaton(terms), random.Random(4)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            kind = rng.randrange(4)
            if kind == 0:
                word[at] = rng.choice("idotscumw")
            elif kind == 1:
                word.insert(at, rng.choice("idotscumw"))
            elif kind == 2 and len(word) > 1:
                del word[at]
            elif at:
                word[at - 1], word[at] = word[at], word[at - 1]
        word = "".join(word)
        found = [d for t in terms if (d := distance(word, t)) <= toxicity.edits_for(t)]
        assert automaton.accepts(word) == min(found, default=None), word


def test_stems_are_part_of_the_automaton(monkeypatch):
    automaton = toxicity.LexiconAutomaton(["idiot"], ["wretch", "scoundr"], frozenset(), slips=True)
    hit = {x: automaton.accepts(x) for x in ("wretch", "wretched", "wretc", "wrrtched", "scoundrels", "idiot", "idoit", "idiotic", "calm")}
    assert hit == {"wretch": 0, "wretched": 0, "wretc": None, "wrrtched": None, "scoundrels": 0, "idiot": 0, "idoit": 1, "idiotic": None, "calm": None}
    monkeypatch.setattr(toxicity, "MOST_STATES", 3)
    assert {x: automaton.accepts(x) for x in hit} == hit and len(automaton.sets) < 20


def test_score_equals_a_plain_reading_of_the_text():
    """Hits, their context and the logistic score, told by whole-text rules instead of the automaton."""
    model = toxicity.ToxicityModel(["idiot", "worthless"], weights=[-2.0, 3.0, 1.0, -0.5, 0.25])
    texts = ["you idiot", "he said: you idiot", "an id1ot and wortless \n idiot", '"idiot" she wrote', "nothing here", "“worthless” is a word", "idiot " * 30]
    for t in texts:
        abuse = fuzzy = quoted = 0
        for m in re.finditer(r"\w+", t.lower()):
            edits = {"idiot": 0, "worthless": 0, "id1ot": 1, "wortless": 1}.get(m[0])
            if edits is not None:
                left, right = t.lower()[max(0, m.start() - 48) : m.start()].split("\n")[-1], t.lower()[m.end() : m.end() + 48].split("\n")[0]
                told = any(re.search(rf"\b{x}\b", left + " | " + right) for x in ("said", "wrote", "word"))
                marks = left.count('"') % 2 == 1 and '"' in right or "“" in left and "”" in right
                quoted, abuse, fuzzy = quoted + (told or marks), abuse + (not (told or marks)), fuzzy + (not (told or marks) and edits)
        z = -2 + 3 * (abuse > 0) + math.log1p(abuse) - 0.5 * math.log1p(fuzzy) + 0.25 * math.log1p(quoted)
        assert abs(model.score(t) - 1 / (1 + math.exp(-z))) < 1e-9, t


def test_context_tells_quotation_from_abuse():
    model = toxicity.ToxicityModel(["idiot", "worthless"])
    assert model.score("you are an idiot and worthless") > 0.5
    assert model.score("you are an id1ot, a wortless idoit") > 0.3
    assert model.score('he said "you idiot" to the judge') < model.score("you idiot are before the judge")
    assert model.score(None) == model.score("") == model.score("a calm river") < 0.1


def test_toxicity_frames(spark, odd_docs, no_docs):
    rows = [(i, f"w{i} {"abcdefghijklmnopqrstuvwxyz"[i % 26]}{"abcdefghijklmnopqrstuvwxyz"[i // 26 % 26]}xx idiot w{i % 7} so w{i % 3}" if i % 3 == 0 else f"w{i} calm water w{i % 7} so w{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels, 400)
    assert "idiot" in model.terms and "calm" not in model.terms
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 3 == 0) for i in scores)
    assert toxicity.spans(docs, model).where("word = 'idiot'").count() == 134
    assert toxicity.score_toxicity(odd_docs, model, score_col="score").count() == 15
    assert toxicity.score_toxicity(no_docs, toxicity.learn(no_docs, labels.limit(0))).count() == 0


def test_toxicity_clean_neighbours_leave_terms_their_edits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"w{i} {letters[i % 26]}{letters[i // 26 % 26]}xx moron {letters[i % 26]}zz scum w{i % 3}" if i % 3 == 0 else f"w{i} calm water {'oron scur ' * (i % 50 == 1)}w{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels, 400)
    assert {"moron", "scum"} <= set(model.terms) and {"oron", "scur"} <= set(model.clean)
    hit = {w: model.hit(w) for w in ("moron", "moorn", "moran", "mooron", "oron", "scum", "scun", "sucm", "scur", "scu", "scumm", "scrum")}
    assert hit == {"moron": 0, "moorn": 1, "moran": 1, "mooron": 1, "oron": None, "scum": 0, "scun": 1, "sucm": 1, "scur": None, "scu": None, "scumm": None, "scrum": None}
    assert model.score("you moran") > model.score("you oron") == model.score("a calm river")


# --- 3 exact dedup


def test_cuckoo_index_inserts_deletes_and_grows():
    index, rng, live = exact_dedup.CuckooIndex(2), random.Random(5), {}
    for _ in range(6000):
        key = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if key in live and rng.random() < 0.4:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            live[key] = rng.random()
            index.insert(key, live[key])
        assert (index.get(key) is not None) == (key in live)
    assert index.resized and index.live == len(live) and {e[1]: e[2] for e in index.entries()} == live
    assert not index.delete(b"nothing of the kind here")
    one = exact_dedup.CuckooIndex()
    for salt in range(3000):  # keys that differ in their last bytes alone
        one.insert(b"the same digest for all of these" + salt.to_bytes(4, "big"), salt)
    assert one.live == 3000 and len(one.table) <= 4096


@pytest.mark.parametrize("salts", [None, 1, 7])
def test_exact_groups(odd_docs, no_docs, salts):
    got = [tuple(r) for r in exact_dedup.exact_groups(odd_docs, salts=salts).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert len(got) == 15
    size, keep = Counter(low(t) for _, t, *_ in got), {}
    for i, t, *_ in got:
        keep[low(t)] = max((x for x in (keep.get(low(t)), i) if x is not None), default=None)
    for i, t, k, n, kept, sha in got:
        assert (k, n, sha) == (keep[low(t)], size[low(t)], hashlib.sha256(low(t).encode()).hexdigest())
        assert kept == (k is None or i == k)
    assert exact_dedup.exact_groups(no_docs).count() == 0
    left = exact_dedup.exact_dedup(odd_docs)
    assert left.columns == odd_docs.columns and sorted(r[0] or 0 for r in left.select("doc_id").collect()) == [0, 2, 3, 5, 6, 7, 8, 11, 12, 14]


# --- 4 sharding


def test_matrix_has_exact_margins_and_the_right_law():
    m = sharding.communication_matrix([10, 0, 7, 30], 4, 1)
    assert m.sum(1).tolist() == [10, 0, 7, 30] and m.sum(0).max() - m.sum(0).min() <= 1 and m.min() >= 0
    rng = np.random.default_rng(2)
    for good, bad, n in ((3, 4, 5), (40, 60, 30), (10**13, 3 * 10**13, 20_000)):  # also beyond any library's range
        drawn = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(4000)])
        mean = n * good / (good + bad)
        spread = mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1)
        assert abs(drawn.mean() - mean) < 5 * (spread / 4000) ** 0.5 and abs(drawn.var() / spread - 1) < 0.15
    draws = np.array([sharding.communication_matrix([6, 6], 2, s)[0, 0] for s in range(3000)])
    want = [math.comb(6, k) ** 2 / math.comb(12, 6) for k in range(7)]
    assert np.abs(np.bincount(draws, minlength=7) / 3000 - want).max() < 0.03


def test_shards(spark, odd_docs, no_docs):
    got = sharding.shuffle_into_shards(odd_docs, "doc_id", 4, rows_per_bucket=3).collect()
    by = Counter(r["shard"] for r in got)
    assert len(got) == 15 and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in by.items())
    assert sharding.shuffle_into_shards(no_docs, "doc_id", 4).count() == 0
    big = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = {r[0]: tuple(r) for r in sharding.shuffle_into_shards(big, "doc_id", 7, rows_per_bucket=100).collect()}
    b = {r[0]: tuple(r) for r in sharding.shuffle_into_shards(big.repartition(9), "doc_id", 7, rows_per_bucket=100).collect()}
    assert a == b and len({r[1:] for r in a.values()}) == 4000
    assert abs(np.corrcoef([(i, r[2]) for i, r in a.items()], rowvar=False)[0, 1]) < 0.1


# --- 5 bpe


def test_bpe_equals_the_library(spark, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["ΑΣ ΟΔΟΣ Σ", "a²b½ ٣٤ x y\x1fz\x85", "<|startoftext|>Hi<|endoftext|> <|startoftext|", "I'm y'all's can't 'tis 'LL", "é ﬁ İstanbul ǅ", "日本語🙂👩‍👩‍👧 ok", " ​_x_ ---", "x" * 3000]
    docs = odd_docs.select("doc_id", "text", "token_ids").union(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string"))
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    coded = bpe.encode_decode(docs, path)
    assert Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded"]) for r in coded.collect()) == want
    again = bpe.decode(coded.drop("decoded"), path)
    assert Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded"]) for r in again.collect()) == want
    assert bpe.encode_decode(no_docs, path).count() == 0


def test_bpe_cache_is_bounded():
    made = []
    cache = bpe.Words(lambda w: made.append(w) or w.encode(), 3)
    for w in ["a", "b", "c", "d", "a", "e"] * 3:
        assert cache[w] == w.encode()
    assert len(cache) <= 3 and len(cache.old) <= 3


# --- 6 top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(0, 1, 8).tolist()) for i in range(240)] + [(240, [0.0] * 8), (241, None), (242, [1.0, float("nan")] * 4), (243, [1.0, None] * 4), (244, [0.5] * 3), (245, [0.5] * 3), (7, vectors_7 := rng.normal(0, 1, 8).tolist())]
    vectors += [(300 + i, vectors_7) for i in range(9)]  # ties
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ints = topk.integer_vectors(df)
    assert ints.count() == 240 + 1 + 2 + 1 + 9
    rows = [(r["vec_id"], r["ints"]) for r in ints.collect()]
    queries = ints.where("vec_id % 20 = 0 or vec_id in (244, 304)")
    got = {}
    for r in topk.exact_top_k(ints, queries, 5, candidate_block=50, query_block=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [r["vec_id"] for r in queries.collect()]:
        own = next(v for i, v in rows if i == q)
        all_scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(own))
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(all_scores[:5])]
    assert topk.exact_top_k(ints.limit(0), queries).count() == 0 and topk.exact_top_k(ints, queries.limit(0)).count() == 0


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(7)
    rows = np.floor(256 * rng.normal(0, 1, (4000, 3)))
    lists = topk.SortedLists(np.arange(4000), rows)
    q = rows[np.argmax((rows**2).sum(1))]
    assert len(lists.top(q, 5, None)) == 5 and lists.scored < 3000


# --- 7 language model


def plain_scores(train, texts):
    """[(n_tokens, n_known, base, score)] of texts by a literal left-to-right walk over counts in plain Python."""
    c, b = Counter(), Counter()
    for t in train:
        w = [*words(t), "\n"]
        c.update(w)
        b.update(zip(["\t", *w], w, strict=False))
    total, kinds = sum(c.values()), len(c)
    once, twice = sum(v == 1 for v in b.values()), sum(v == 2 for v in b.values())
    d = once / (once + 2 * twice) if once and twice else 0.75
    arcs = Counter(h for h, _ in b)
    out = []
    for t in texts:
        state, base, score, known, n = "\t", 0.0, 0.0, 0, 0
        for x in [*words(t), "\n"]:
            p = (c[x] + 0.5) / (total + 0.5 * (kinds + 1))
            seen = len(train) if state == "\t" else c[state]
            back = d * arcs[state] / seen if seen else 1.0
            score += math.log10((b[state, x] - d) / seen + back * p) if (state, x) in b else math.log10(back) + math.log10(p)
            base += math.log10(p)
            known, n, state = known + (c[x] > 0), n + 1, x
        out.append((n, known, base, score))
    return out, total


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_lm_equals_plain_python(spark, odd_docs, no_docs, parts):
    """Also for ids that repeat or are missing: each row by its own text, however rows are dealt out."""
    more = [(5, "a b c"), (5, "q r s"), (None, "a b c"), (None, "short zz one"), (77, "a b c d a b"), (2**62, ""), (-(2**63), "x y")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = docs.where(session.fold(F.col("doc_id")) != 1)
    scores, total = plain_scores([t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1], [t for _, t in rows])
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score_texts(train, docs.repartition(parts, "text")).collect()]
    want = [(i, n, known, total, base, score) for (i, _), (n, known, base, score) in zip(rows, scores, strict=True)]
    flat = lambda found: sorted((-(2**64) if r[0] is None else r[0], *r[1:4], *(round(x, 6) for x in r[4:])) for r in found)
    assert len(got) == len(want) and np.allclose(np.array(flat(got), float), np.array(flat(want), float), rtol=1e-9)
    assert lm.score_texts(train, no_docs.select("doc_id", "text")).count() == 0
    assert {r["base_score"] for r in lm.score_texts(train.limit(0), docs.where("doc_id = 4")).collect()} == {0.0}


def test_lm_query_uses_all_bigrams_outside_the_fold(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["a b c a b d", "b e", "a b", "b e c a", "e b", "c c", "a d", "d b e"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = {r["doc_id"]: r for r in queries.op7_lm_scoring(spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    scores, total = plain_scores([t for i, t in rows if not held[i]], [t for _, t in rows])
    for (i, _), (n, known, base, score) in zip(rows, scores, strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], n, known, total)
        assert abs(r["base_score"] - base) < 1e-9 and abs(r["score"] - score) < 1e-9


def test_automaton_probabilities_sum_to_one():
    root = np.log10(np.array([0.5, 0.3, 0.2]))
    arcs, p = np.array([0 * 3 + 1]), 0.6  # state 0 has one arc, to word 1
    back = (1 - p) / (1 - 0.3)
    a = lm.BackoffAutomaton(root, np.log10(np.array([back, 1, 1])), arcs, np.log10(np.array([p])))
    for state in range(3):
        assert abs((10 ** a.step(np.full(3, state), np.arange(3))).sum() - 1) < 1e-12
    texts = np.array([0, 1, 2, 1])
    assert np.allclose(a.walk(texts, np.array([0, 3, 4]), 2), [root[0] + np.log10(p) + root[2], root[1]], atol=1e-12)


# --- 8 language identification


def test_language_id(spark, odd_docs):
    rng = random.Random(8)
    en, de = ["the", "and", "with", "house", "water", "thing"], ["der", "und", "mit", "haus", "wasser", "ding", "ich"]
    say = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    docs = spark.createDataFrame([(say(en, 60), "en") for _ in range(30)] + [(say(de, 60), "de") for _ in range(30)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language_id.learn(docs)
    assert model.languages == ["de", "en"]
    pages = [(i, f"https://a.{'de' if i % 2 else 'com'}/x", f'<html lang="{"de" if i % 2 else "en-GB"}"><script>der und</script><p>{say(de if i % 2 else en, 40)}</p>') for i in range(60)]
    pages += [(100, "https://a.de/y", ""), (101, None, None), (102, "https://a.de/z", f'<html lang="en"><p>{say(de, 40)}'), (103, "nonsense", '<html lang="de"></html>'), (103, "nonsense", '<html lang="de"></html>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("zz")).withColumn("alone", F.lit(1))
    got = {r["page_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(got[i]["lang"] == ("de" if i % 2 else "en") and got[i]["confidence"] > 0.9 for i in range(60))
    assert got[100]["lang"] == "de" and got[102]["lang"] == "de" and got[103]["lang"] == "de" and got[101]["host"] == "" and got[2]["declared"] == "en"
    assert language_id.identify(df, model).count() == 65 and language_id.identify(df.limit(0), model).count() == 0
    assert language_id.identify(df, language_id.learn(docs.limit(0))).where("lang = 'und'").count() == 65


# --- 9 mixing


def test_temperature_meets_its_target(spark):
    shares = spark.createDataFrame([(0.6,), (0.3,), (0.1,)], "share double")
    t = mixing.temperature(shares, 2.0, None)
    assert abs(6 ** (1 - t) - 2) < 1e-6
    t = mixing.temperature(shares, None, 0.95)
    w = np.array([0.6, 0.3, 0.1]) ** t
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.95 * math.log(3)) < 1e-6


def test_repeat_limit_holds_where_sources_are_even(spark):
    even = {f"s{k:02}": 20 for k in range(19)} | {"large": 24}
    shares = spark.createDataFrame([(v / sum(even.values()),) for v in even.values()], "share double")
    assert 1.2 ** (mixing.temperature(shares, None, 0.97) - 1) > 3
    assert abs(1.2 ** (mixing.temperature(shares, 2.0, 0.97) - 1) - 2) < 1e-6
    assert mixing.temperature(shares, 1.0, 0.97) == 1
    docs = spark.createDataFrame([(1000 * k + i, s, 1) for k, (s, v) in enumerate(even.items()) for i in range(v)], "doc_id long, source string, tokens long")
    used = Counter((r["source"], r["doc_id"]) for r in mixing.mixture(docs, tokens_col="tokens").collect())
    assert len(used) == sum(even.values()) and all(n == 1 + (s == "large") for (s, _), n in used.items())


def test_mixture(spark, odd_docs, no_docs):
    rows = [(i, "a", 10) for i in range(60)] + [(100 + i, "b", 7) for i in range(9)] + [(200, None, 5), (201, "z", 0), (202, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("block", F.lit("x"))
    got = mixing.mixture(docs, tokens_col="tokens", repeat_limit=3.5, entropy_share=None, rows_per_bucket=10).collect()
    used = Counter(r["doc_id"] for r in got)
    assert set(used) == {r[0] for r in rows}
    assert all(used[i] == 1 for i in range(60)) and used[200] == 3 and used[201] == used[202] == 1
    assert max(used.values()) <= 4 and all(1 <= used[100 + i] <= 3 for i in range(9))
    for block in {r["block"] for r in got if r["source"] == "b"}:
        ends = sorted(r["end_tokens"] for r in got if r["source"] == "b" and r["block"] == block)
        assert ends == [7 * (k + 1) for k in range(len(ends))]
    whole = mixing.mix_sources(docs, tokens_col="tokens", repeat_limit=3.5, entropy_share=None)
    assert whole.columns == docs.columns and Counter(r["doc_id"] for r in whole.collect()) == used
    fixed = mixing.mixture(docs, tokens_col="tokens", repeat_limit=None, entropy_share=0.9, budget=300).collect()
    assert abs(sum(r["n_tokens"] for r in fixed) - 300) < 40
    assert {r["doc_id"] for r in mixing.mixture(odd_docs).collect()} == {r["doc_id"] for r in odd_docs.collect()}
    assert mixing.mixture(no_docs).count() == 0 and mixing.mix_sources(no_docs).count() == 0
    one = odd_docs.where("source = 'a' and doc_id = 1")
    assert mixing.mix_sources(one).count() == 1


# --- 10 n-gram join


def shingles(text):
    v = words(text)
    return {tuple(v[k : k + 5]) for k in range(len(v) - 4)} if len(v) >= 5 else {tuple(v)} if v else set()


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def brute_components(texts):
    sets = []
    for i, t in texts:
        v = words(t)
        sets.append((i, {tuple(v[k : k + 5]) for k in range(len(v) - 4)} if len(v) >= 5 else {tuple(v)} if v else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {(i, len(a), find(i)) for i, a in sets}


def test_near_duplicates_odd(odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null")
    got = {tuple(r) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert ngram_join.near_duplicates(odd_docs).count() == 15 and ngram_join.near_duplicates(no_docs).count() == 0


def test_near_duplicates_without_ids_and_with_repeated_ids(spark):
    """Links over rows that have no id count, and of rows that share an id each is judged by its own text."""
    text = [f"t{k}" for k in range(61)]
    swap = lambda *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(text))
    # 5 and the row without an id are near, so are that row and 7, but not 5 and 7
    a, b, c = swap(), swap(10), swap(10, 30)
    rows = [(5, a), (None, b), (7, c), (None, "alone among rows without an id, quite alone"), (9, a), (9, "another text of the same id that is like no other"), (None, None)]
    far = " ".join(text[:50] + [f"y{k}" for k in range(7)])
    rows += [(20, far), (21, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("entity", F.lit("own"))
    sets = [shingles(t) for _, t in rows]
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    want = [5, 5, 5, None, 5, 9, None, 20, 20]
    assert got == Counter((i, len(s), w) for (i, _), s, w in zip(rows, sets, want, strict=True))
    left = ngram_join.near_dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted(["", a, b, rows[3][1], rows[5][1], far])


def test_near_dedup_odd(odd_docs):
    left = ngram_join.near_dedup(odd_docs)
    assert left.columns == odd_docs.columns and {r["doc_id"] for r in left.collect()} == {None, 1, 4, 5, 6, 7, 9, 11, 13}


@pytest.mark.parametrize(("block", "linear"), [(4096, (True, False)), (40, (True, False)), (40, ())])
def test_near_duplicates_of_drifting_copies(spark, block, linear, monkeypatch):
    """A large group of copies that drift apart in steps, copies of a common passage, and small sets."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts, common = [], [f"c{k}" for k in range(30)]
    for i in range(70):
        if i % 10 == 0:
            base[rng.randrange(80)] = f"n{i}"
        own = list(base)
        own[rng.randrange(80)] = f"v{i}"
        texts.append((i, " ".join(own)))
    texts += [(200 + i, " ".join([f"r{i}x{k}" for k in range(rng.randrange(5, 60))] + common)) for i in range(40)]
    texts += [(300 + i, " ".join(rng.choices("ab", k=rng.randrange(1, 9)))) for i in range(40)]
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block // 8)
    monkeypatch.setattr(ngram_join, "FIRST_ROUNDS", linear)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in ngram_join.near_duplicates(docs).collect()} == brute_components(texts)


def test_prefix_bound_loses_no_link():
    rng = random.Random(10)
    for _ in range(300):
        n = rng.randrange(1, 40)
        a = set(range(n))
        b = {x if rng.random() < 0.88 else 100 + x for x in a} | ({200} if rng.random() < 0.5 else set())
        if 100 * len(a & b) >= 75 * len(a | b):
            order = {x: rng.random() for x in a | b}
            first = lambda s: set(sorted(s, key=order.get)[: int(ngram_join.prefix_length(np.int64(len(s))))])  # noqa: B023, E731
            assert len(first(a) & first(b)) >= ngram_join.least_shared(np.int64(len(a)), np.int64(len(b))) >= 1


def test_other_orders_pass_every_link_and_stop_pairs_that_are_no_links():
    rng, stopped = random.Random(12), 0
    levels = np.zeros(ngram_join.CELLS, np.uint8)
    held = type("Held", (), {"value": levels})
    for _ in range(60):
        own = [f"w{rng.randrange(400)}" for _ in range(60)]
        other = [x if rng.random() < rng.choice([0.8, 0.97]) else f"v{rng.randrange(400)}" for x in own]
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(own), " ".join(other)])], ["text"])
        (found,) = ngram_join._other_prefixes(held)(iter([batch]))
        x, y = (np.frombuffer(v, np.uint32) for v in found.column(2).to_pylist())
        link = near(shingles(" ".join(own)), shingles(" ".join(other)))
        passed = ngram_join.passes(x, y, *found.column(1).to_pylist())
        assert passed or not link
        stopped += not passed
    assert stopped > 10


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (500, 500)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- entry and pipeline


def test_pipeline_equals_the_stages_by_hand(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i: r for i, r in rows.items() if model.score(r["text"]) < 0.5}
    last = {}
    for i in sorted(left):
        last[low(left[i]["text"])] = i
    left = {i: left[i] for i in last.values()}
    roots = brute_components([(i, r["text"]) for i, r in sorted(left.items())])
    left = {i: left[i] for i, _, root in roots if i == root}
    slim = spark.createDataFrame([(i, r["source"], len(words(r["text"]))) for i, r in left.items()], "doc_id long, source string, n long")
    want = Counter(r["doc_id"] for r in mixing.mixture(slim, tokens_col="n").collect())
    out = corpus_pipeline.run(spark, SF)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == want and set(want) == set(left)
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out.collect():
        assert r["token_ids"] == library.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])


def test_pipeline_stages_on_empty_and_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline

    want = {"toxicity": 15, "exact_dedup": 10, "ngram_jaccard_join": 10, "mixing": 15, "bpe": 15}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        if name != "ngram_jaccard_join":  # near_dedup has a test of its own on these rows
            got = stage(spark, odd_docs, SF)
            n = got.count()
            assert n >= want[name] if name == "mixing" else n == want[name], (name, n)
            assert name == "bpe" or got.columns == odd_docs.columns


def test_entry_names_all_queries():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
