"""Language identification of web pages by fusing evidence.

Evidence: the likelihood of the visible text under byte-trigram models of each language, the language that the
markup declares, and a prior of the host. The prior is smoothed hierarchically: a host leans on its site, a site on
its address suffix, a suffix on all pages. What the text alone says of every page, summed by host, site, suffix and
declared language in grouped aggregations, gives these priors and how far a declaration can be trusted; a page's
own share is taken out of the sums that judge it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.llm.ngram_join import MOST_BROADCAST_IDS
from galena.llm.packing import pack, unpack
from galena.llm.session import written
from galena.llm.vectext import pieces

SLOTS = 1 << 15
#: About so many texts of each language are learnt from.
SAMPLE_ROWS = 1500
#: A text counts for so many independent trigrams at most; strength of the upper level of a prior, in pages.
TEXT_WEIGHT, STRENGTH, DECLARED_STRENGTH = 40.0, 4.0, 1.0
_TAG = re.compile(r"<!--|<(?:(script|style|noscript|template)\b)?[^>]*>", re.IGNORECASE)
_ENDS = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in ("script", "style", "noscript", "template")}


def visible_text(page: str | None) -> str:
    """What a reader sees: without scripts, styles, comments and tags, entities resolved."""
    out, at = [], 0
    closed = dict.fromkeys([*_ENDS, "<!--"], True)  # an element that is not closed once is not looked for again, so time is linear
    page = page or ""
    stop = page.rfind(">") + 1  # up to here every "<" has its ">", so no search runs on for nothing
    while found := _TAG.search(page, at, stop):
        out.append(page[at : found.start()])
        at = found.end()
        name = "<!--" if found[0] == "<!--" else (found[1] or "").lower()
        if name and closed[name]:
            if name == "<!--":
                end = page.find("-->", at)
                end = end + 3 if end >= 0 else -1
            else:
                last = _ENDS[name].search(page, at)
                end = last.end() if last else -1
            if end >= 0:
                at = end
            else:
                closed[name] = False
    out += page[at:].split("<!--")
    return html.unescape(" ".join(out))


def _codes(raw: np.ndarray) -> np.ndarray:
    """A slot for each byte trigram of lower-cased bytes."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    return ((low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) % np.uint32(SLOTS)


@dataclass
class TextModel:
    """languages, and log-probabilities [language, slot]."""

    languages: list[str]
    table: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> TextModel:
        """From each language's trigram counts; without any, one language that is none."""
        languages = sorted(counts) or ["und"]
        table = np.array([counts.get(x, np.zeros(SLOTS)) for x in languages], float) + 0.5
        return cls(languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """[text, language] from whole texts alone, under equal priors; the evidence of long texts is held to TEXT_WEIGHT trigrams."""
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        out = np.zeros((len(texts), len(self.languages)))
        for row, end, r, o in pieces(raw, offsets, 1 << 20):
            n = np.maximum(np.diff(o) - 2, 0)
            if len(r) > 2:
                codes = _codes(r)
                for k in range(len(self.languages)):
                    total = np.concatenate([[0.0], np.cumsum(self.table[k][codes], dtype=np.float64)])
                    last = np.minimum(o[:-1] + n, len(codes))
                    out[row:end, k] = np.where(n > 0, total[last] - total[np.minimum(o[:-1], len(codes))], 0.0)
            out[row:end] *= (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
        out -= out.max(1, keepdims=True)
        out = np.exp(out)
        return out / out.sum(1, keepdims=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, body) as each language's trigram counts of a batch."""
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = np.frombuffer(text.as_py().encode(), np.uint8)
            if len(raw) > 2:
                sums[lang] = sums.get(lang, 0) + np.bincount(_codes(raw), minlength=SLOTS)
            else:
                sums.setdefault(lang, np.zeros(SLOTS, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([pack(x.astype(np.uint64)) for x in sums.values()], pa.binary())], ["lang", "body"])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Trigram models from about sample_rows different whole texts of each language, those of the least hashes; a language with fewer gives all.

    Rows without a language or a text are left out. Only counts come to the driver.
    """
    some = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.lower(F.col(f"`{lang_col}`").cast("string")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    some = some.withColumn("hash", F.xxhash64("text", "lang"))
    sizes = some.groupBy("lang").agg(F.approx_count_distinct("hash").alias("kinds"))  # as many rows as languages
    least = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("kinds"))
    sample = some.join(F.broadcast(sizes), "lang").where(F.col("hash").cast("double") <= least).select("lang", "text", "hash").dropDuplicates(["hash"])
    counts: dict[str, np.ndarray] = {}
    for lang, body in sample.select("lang", "text").mapInArrow(_counts, "lang string, body binary").toLocalIterator():
        counts[lang] = counts.get(lang, 0) + unpack(body)
    return TextModel.of(counts)


def _text_only(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = model.posteriors([visible_text(x.as_py()) for x in part.column(last)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [str(i) for i in range(last + 1)])

    return run


def declared_language(page: Column) -> Column:
    """The primary subtag of the lang attribute of the html tag, or else of the content-language declaration; empty without one. A tag ends at the next < or >."""
    tag = F.regexp_extract(page, r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""", 1)
    meta = F.regexp_extract(page, r"""(?is)<meta\b(?>[^<>]*?content-language)["']?[^<>]*?\bcontent\s*=\s*["']?\s*([a-z]{2,3})\b""", 1)
    return F.coalesce(F.lower(F.when(tag != "", tag).otherwise(meta)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _sums(pages: DataFrame, by: str, k: int) -> DataFrame:
    return pages.groupBy(by).agg(F.array(*[F.sum(F.col("alone")[i]) for i in range(k)]).alias(f"{by}_sum"))


def _onto(pages: DataFrame, sums: DataFrame, by: str) -> DataFrame:
    """A sum table of checked size goes to every executor; a larger one is joined by a shuffle, whose hot keys are split."""
    return pages.join(F.broadcast(sums) if sums.count() <= MOST_BROADCAST_IDS // 10 else sums, by)


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, declared, text_lang, lang, confidence) of every page.

    Null or empty html says nothing, so the prior decides; a null url is the empty host. Ties go to the language
    first in the alphabet. Rows repeated are judged each. An empty table gives an empty one.
    """
    k = len(model.languages)
    names = F.array(*map(F.lit, model.languages))
    page = F.col(f"`{html_col}`").cast("string")
    fed = pages.select(F.col(f"`{id_col}`"), host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), declared_language(page).alias("declared"), page.alias("page"))
    alone = written(fed.mapInArrow(_text_only(model), fed.drop("page").schema.add("alone", T.ArrayType(T.DoubleType()))), "text-alone")
    parts = F.split("host", r"\.")
    alone = alone.withColumn("suffix", F.element_at(parts, -1)).withColumn("site", F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(0)) + 1, 3)))
    everything = alone.agg(*[F.coalesce(F.sum(F.col("alone")[i]), F.lit(0.0)) for i in range(k)]).first()
    fused = alone
    for by in ("host", "site", "suffix", "declared"):
        fused = _onto(fused, written(_sums(alone, by, k), "evidence"), by)
    kinds = alone.select("declared").distinct().count()
    total = [float(x) for x in everything]
    count = sum(total)

    def level(sums: Column, above: list[Column], i: int, own: Column) -> Column:
        size = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x) - 1
        return (sums[i] - own + F.lit(STRENGTH) * above[i]) / (size + STRENGTH)

    own = [F.col("alone")[i] for i in range(k)]
    prior = [(F.lit(total[i]) - own[i] + 1.0) / F.lit(max(count - 1 + k, 1.0)) for i in range(k)]
    for by in ("suffix", "site", "host"):
        fused = fused.withColumn(f"{by}_prior", F.array(*[level(F.col(f"{by}_sum"), prior, i, own[i]) for i in range(k)]))
        prior = [F.col(f"{by}_prior")[i] for i in range(k)]
    trust = [(F.col("declared_sum")[i] - own[i] + DECLARED_STRENGTH) / (F.lit(total[i]) - own[i] + DECLARED_STRENGTH * max(1, kinds)) for i in range(k)]
    logs = F.array(*[F.log(F.greatest(own[i], F.lit(1e-30))) + F.log(F.greatest(prior[i], F.lit(1e-12))) + F.log(F.greatest(trust[i], F.lit(1e-12))) for i in range(k)])
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = lambda values: F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    return fused.select(F.col(f"`{id_col}`"), "host", "declared", best(F.col("alone")).alias("text_lang"), best(F.col("logs")).alias("lang"), (1 / mass).alias("confidence"))

