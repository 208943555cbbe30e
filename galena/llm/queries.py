"""One thin query for each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm.session import table

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.labelled import HELD_OUT
    from galena.llm.quality import learn, score_quality
    from galena.llm.session import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")), score_col="score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.labelled import HELD_OUT
    from galena.llm.session import fold
    from galena.llm.toxicity import learn, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", F.col("text")), model, score_col="score").drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.exact_dedup import exact_groups

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = f"""
    WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.sharding import shuffle_into_shards

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    out = shuffle_into_shards(rows, "doc_id", 40, tie=F.xxhash64("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from galena.llm.bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.session import written
    from galena.llm.topk import exact_top_k, integer_vectors

    vectors = written(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP6_SQL = """
    WITH v AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.row, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.ints, v.ints), lambda p: p[1] * p[2])) AS score
        FROM v AS q JOIN v ON q.row <> v.row WHERE q.vec_id % 50 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.lm import score_texts
    from galena.llm.session import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs.where(fold(F.col("doc_id")) != 1), docs)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.language_id import identify, learn

    return identify(table(spark, sf_dir, "pages"), learn(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from galena.llm.session import scratch
    from galena.llm.tokenfile import digests, write_token_files

    path = scratch(spark, "token-files")
    return digests(spark, write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.llm.lexical import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from galena.llm import lexical, mixing, vector_codes

    return {"op3_exact_dedup": OP3_SQL, "op6_exact_topk": OP6_SQL, "op9_mixing": mixing.SQL, "op12_vector_codes": vector_codes.SQL, "op13_ranked_search": lexical.SQL}
