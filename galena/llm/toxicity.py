"""Toxicity by Levenshtein automata intersected with a lexicon trie, weighed by the context of each hit.

The lexicon is learnt: words whose documents are almost all labelled toxic, and too many for chance. A word of
a text is run through the intersection of the trie and the automata of its terms (edits: replace, insert,
delete, swap of neighbours), determinised lazily, so a word that cannot match ends after two or three letters. Each
hit is looked at in a window of its text: between quotation marks or beside a reporting word it counts as
quotation, else as abuse. A logistic model on these counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.labelled import labelled_texts
from galena.llm.packing import release
from galena.llm.session import forget, fresh, written

#: At most so many labelled texts are learnt from.
SAMPLE_ROWS = 12_000
#: So many states of the automaton are kept, then they are made anew.
MOST_STATES = 50_000
ANY = -1  # in place of a trie node: a stem has been read, and any word that goes on from it is accepted
#: Least and most letters of a learnt stem.
STEM = (5, 9)
WINDOW = 48
CACHE_WORDS = 100_000
#: Terms of so many letters forgive one substitution or swap, if slips are allowed.
SHORT = 4
# fixed values: signs that open and close a quotation, and words that report one
OPENING, CLOSING = "\"“«„‹‘", "\"”»“›’"
REPORTING = ["said", "says", "wrote", "writes", "quoted", "quote", "quoting", "called", "word", "term", "sagte", "schrieb", "zitat", "wort", "dit", "disait", "mot", "dijo", "palabra", "cita"]

WORD = re.compile(r"\w+(?:[*@$!]+\w+)*")
LETTERS = re.compile(r"[^\W\d_]{3,}")
_REPORT = re.compile(r"\b(?:" + "|".join(REPORTING) + r")\b")


def edits_for(term: str) -> int:
    """How many edits of any kind a term forgives: none up to four letters, one up to eleven, then two."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class LexiconAutomaton:
    """The lazily built DFA of all words within a term's edits of that term.

    A stem accepts every word that begins with it. A state of the product is a set of (trie node, edits spent, letter awaited by a swap). accepts() gives the
    least edits to any term, or None. Words of `clean` are never accepted by edits. With `slips` a term of SHORT letters forgives one edit
    that keeps its length.
    """

    def __init__(self, terms: list[str], stems: list[str] = (), clean: frozenset[str] = frozenset(), slips: bool = False) -> None:
        self.clean = clean
        self.stems = tuple(stems)
        self.children: list[dict[str, int]] = [{}]
        self.room = [0]  # the most edits that any term below forgives
        self.term_edits: list[int] = [-1]
        self.slip_ends: set[int] = set()  # nodes of short terms
        for term in terms:
            slip = slips and len(term) == SHORT
            node, allowed = 0, 1 if slip else edits_for(term)
            self.room[0] = max(self.room[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                    self.term_edits.append(-1)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], allowed)
            self.term_edits[node] = 0 if slip else allowed
            if slip:
                self.slip_ends.add(node)
        self.stem_ends: set[int] = set()
        for stem in self.stems:
            node = 0
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                    self.term_edits.append(-1)
                node = self.children[node][c]
            self.stem_ends.add(node)
        self._forget()

    def _forget(self) -> None:
        """No state but the first."""
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accept: list[int | None] = []
        self.accept_short: list[bool] = []  # one edit from a short term
        self.known: dict[frozenset, int] = {}
        self.start = self._state(self._close({(0, 0, 0)}))

    def _close(self, items: set[tuple[int, int, int]]) -> frozenset:
        """With what letters of a term left out can reach; spent edits beyond a node's room go."""
        out, todo = set(), list(items)
        while todo:
            node, spent, swap = todo.pop()
            if node == ANY:
                return frozenset({(ANY, 0, 0)})
            if spent > self.room[node] or (node, spent, swap) in out:
                continue
            out.add((node, spent, swap))
            if not swap:
                todo += [(child, spent + 1, 0) for child in self.children[node].values()]
        return frozenset(out)

    def _state(self, items: frozenset) -> int:
        if items not in self.known:
            self.known[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
            ends = [spent for node, spent, swap in items if node == ANY or not swap and spent <= self.term_edits[node]]
            self.accept.append(min(ends, default=None))
            self.accept_short.append(any(spent == 1 and not swap and node in self.slip_ends for node, spent, swap in items))
        return self.known[items]

    def _step(self, state: int, c: str) -> int:
        nxt: set[tuple[int, int, int]] = set()
        for node, spent, swap in self.sets[state]:
            if node == ANY:
                nxt.add((ANY, 0, 0))
                continue
            if swap:  # the letter after this one came first; now this one must come
                if c == chr(swap):
                    nxt.add((node, spent, 0))
                continue
            child = self.children[node].get(c)
            if child is not None:
                nxt.add((child, spent, 0))
                if not spent and child in self.stem_ends:
                    nxt.add((ANY, 0, 0))
            if spent < self.room[node]:
                nxt.add((node, spent + 1, 0))
                for letter, other in self.children[node].items():
                    nxt.add((other, spent + 1, 0))
                    far = self.children[other].get(c)
                    if far is not None:
                        nxt.add((far, spent + 1, ord(letter)))
        made = self._close(nxt)
        to = self.steps[state][c] = self._state(made) if made else -1
        return to

    def accepts(self, word: str) -> int | None:
        if len(self.sets) > MOST_STATES:
            self._forget()
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return None
            state = to
        found = self.accept[state]
        if found is None and len(word) == SHORT and self.accept_short[state]:
            found = 1
        return None if found and word in self.clean else found


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks close the hit in, or a reporting word stands near, within the window on its line."""
    left = text[max(0, start - WINDOW) : start].rsplit("\n", 1)[-1]
    right = text[end : end + WINDOW].split("\n", 1)[0]
    opened = max((left.rfind(c) for c in OPENING), default=-1)
    marks = opened >= 0 and sum(left.count(c) for c in "\"") % 2 == (left[opened] == '"') and any(c in right for c in CLOSING)
    return bool(marks) or bool(_REPORT.search(left) or _REPORT.search(right))


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: list[float] = field(default_factory=lambda: [-3.0, 4.0, 1.0, -0.2, 0.3])
    stems: list[str] = field(default_factory=list)
    clean: list[str] = field(default_factory=list)  # words near a term that are no misspelling of it

    def __post_init__(self) -> None:
        self.automaton = LexiconAutomaton(self.terms, self.stems, frozenset(self.clean), slips=True)
        self.cache: dict[str, int | None] = {}

    def __reduce__(self):
        return (ToxicityModel, (self.terms, self.weights, self.stems, self.clean))

    def hit(self, word: str) -> int | None:
        found = self.cache.get(word, -1)
        if found == -1:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = self.automaton.accepts(word)
        return found

    def hits(self, text: str) -> list[tuple[int, int, str, int, bool]]:
        """(start, end, word, edits, quoted) of every hit of the whole text, in order."""
        low = text.lower()
        words = set(WORD.findall(low))
        bad = {w: e for w in words if (e := self.hit(w)) is not None}
        if not bad:
            return []
        out = []
        for m in WORD.finditer(low):
            if (edits := bad.get(m[0])) is not None:
                out.append((m.start(), m.end(), m[0], edits, is_quoted(low, m.start(), m.end())))
        return out

    def features(self, text: str | None) -> list[float]:
        abuse = fuzzy = quoted = 0
        for _, _, _, edits, quote in self.hits(text) if text else ():
            if quote:
                quoted += 1
            else:
                abuse += 1
                fuzzy += edits > 0
        return [1.0, float(abuse > 0), math.log1p(abuse), math.log1p(fuzzy), math.log1p(quoted)]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit(self, features: list[list[float]], labels: list[int], steps: int = 60, pull: float = 1.0) -> None:
        """Newton steps of a logistic model, drawn to the weights that it had."""
        x = np.array(features, float).reshape(-1, 5)
        y, start = np.array(labels, float), np.array([-3.0, 4.0, 1.0, -0.2, 0.3])
        w = start.copy()

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float(np.logaddexp(0, z).sum() - z @ y + pull / 2 * ((w - start) ** 2).sum())

        for _ in range(steps if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + pull * (w - start)
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull * np.eye(5), grad)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step /= 2
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w.tolist()


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """The lexicon and weights from at most sample_rows labelled texts outside the held-out fold.

    A use of a word is a word that stands before it, so that copies of a text count once. A word is a term
    if at least nine tenths of its uses are in toxic documents and fewer than 0.05 words of so many toxic
    uses would be expected by chance. A beginning of words is a stem on the same terms if 97 of 100 uses are in
    toxic documents and it has four forms at least; of two stems the shorter stands for both. A word
    within a term's edits is no misspelling of it if half of its uses or more are in clean texts.
    """
    sample = written(labelled_texts(docs, labels, "toxic", sample_rows), "toxic-sample")
    rows, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == rows:
        return ToxicityModel([])
    uses = sample.select("label", "text").mapInArrow(_uses, "label int, word string, before string").distinct()
    counts = uses.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("docs"))
    counts = written(counts, "toxic-words")
    surest = lambda df, purity: df.where((F.col("toxic") >= _least(df.count(), toxic / rows)) & (F.col("toxic") >= purity * F.col("docs")))  # noqa: E731  a bounded sample has few such words
    terms = [r["word"] for r in surest(counts, 0.9).collect()]
    cut = F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: F.substring("word", F.lit(1), n))
    begun = counts.where(F.length("word") > STEM[0]).select(F.explode(F.array_distinct(cut)).alias("word"), "toxic", "docs")
    begun = begun.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"), F.count("*").alias("forms")).where("forms >= 4")
    stems: list[str] = []
    for stem in sorted((r["word"] for r in surest(begun, 0.97).collect()), key=len):
        if not stem.startswith(tuple(stems)):
            stems.append(stem)
    model = ToxicityModel(sorted(terms), stems=sorted(stems))
    near = sample.select("label", "text").mapInArrow(_near(model), "label int, word string, before string").distinct()
    near = near.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("uses")).where("2 * toxic <= uses")
    model = ToxicityModel(sorted(terms), stems=sorted(stems), clean=sorted(r["word"] for r in near.collect()))
    made = sample.select("label", "text").mapInArrow(_features(model), "label int, x array<double>").collect()  # five numbers a text of the sample
    made.sort()
    model.fit([r["x"] for r in made], [r["label"] for r in made])
    forget(sample, counts)
    return model


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (word, word before) of each text, of words of three letters or more."""
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = LETTERS.findall(text.as_py().lower())
            pairs = set(zip(words, ["", *words], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(pairs), pa.int32()), pa.array([w for w, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], ["label", "word", "before"])


def _near(model: ToxicityModel):
    """The different (word, word before) of each text whose word is some edits from a term, words cut as in scoring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, str, str]] = set()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = WORD.findall(text.as_py().lower())
                found.update((label, w, b) for w, b in zip(words, ["", *words], strict=False) if model.hit(w))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["label", "word", "before"])
        model.cache.clear()
        release()

    return run


def _features(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.features(x.as_py()) for x in batch.column(1)], pa.list_(pa.float64()))], ["label", "x"])
        model.cache.clear()
        release()

    return run


def _least(kinds: int, share: float) -> int:
    """The toxic uses that fewer than 0.05 of so many kinds of words would reach by chance alone."""
    return max(3, math.ceil((math.log(kinds + 1) - math.log(0.05)) / -math.log(share)))


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            scores = [model.score(x.as_py()) for x in batch.column(last)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [str(i) for i in range(last + 1)])
        model.cache.clear()
        release()

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with the score of the whole text, last; a column of that name is replaced. Null and empty texts get the score of no hit."""
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    fed = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(fresh(docs, "scored")))
    return fed.mapInArrow(_score(model), docs.select(*keep).schema.add(score_col, "double"))


def spans(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, start, end, word, edits, quoted) of every hit, places in characters of the lower-cased text."""
    schema = "doc_id long, start int, end int, word string, edits int, quoted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *h) for i, t in zip(batch.column(0), batch.column(1), strict=True) for h in model.hits(t.as_py() or "")]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "end", "word", "edits", "quoted"), r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
