"""A training corpus from raw documents: toxic texts and copies go, sources are mixed, the rest is tokenised."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm.bpe import encode_decode
from galena.llm.exact_dedup import exact_dedup
from galena.llm.mixing import mix_sources
from galena.llm.ngram_join import near_dedup
from galena.llm.session import table, written
from galena.llm.toxicity import learn, score_toxicity

TOXIC_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose whole text scores below TOXIC_FROM; labels only train the model, which without any rejects nothing.

    Null and empty texts have no hit and stay, rows without an id too; repeated rows are judged alike. Columns beside these, of any
    name, pass through. An empty table gives an empty one.
    """
    model = learn(docs, table(spark, sf_dir, "labels"))
    score = "toxicity_score"
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < TOXIC_FROM).drop(score)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null counts as empty) the row with the largest doc_id.

    Rows repeated with one id and one text are one document and stay together; of texts that stand on rows without an id alone, all stay.
    Very long texts meet as digests. Columns beside these pass through. An empty table gives an empty one.
    """
    return exact_dedup(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents that link at a Jaccard similarity of 0.75 or more on five words, the smallest doc_id.

    Texts without words link with nothing and stay; rows without an id stay, but others link over them. Rows that repeat an id are judged each by its
    own text; those alike in both stay together. Columns beside these pass through. An empty table gives an empty one.
    """
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, up to twice.

    A null source is a source like any other; null and empty texts have no tokens and are used with their source's whole blocks. Equal ids of a source
    stand together in its order. Columns beside these pass through. An empty table gives an empty one.
    """
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of the whole text, as they go to training; op5's query decodes, this stage does not.

    Null and empty texts have no ids; repeated rows are encoded each; no other column is read. An empty table gives an empty one.
    """
    coded = encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), decode=False)
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("exact_dedup", dedup), ("ngram_jaccard_join", near_dups), ("mixing", mixing), ("bpe", tokens),
]

#: No SQL: the toxicity model, the join and the encoder are not expressible; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
