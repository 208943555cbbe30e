"""Labelled rows to learn from, as a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.session import fold

HELD_OUT = 0


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled rows outside the held-out fold, chosen by a hash of the id.

    The sample is the documented bound of what is learnt from labels; it takes whole texts. Rows without an id, a label or a text are left out.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
