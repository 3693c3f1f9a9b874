"""The queries of the training-data operators, over whole tables, and their SQL where there is any."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    C.short_batches(spark)
    return chat.recover(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.digest(C.documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = C.documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", C.held_out(5))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bitslice

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return bitslice.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.find(C.documents(spark, sf_dir).select("doc_id", "text")).drop("row")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.report(C.documents(spark, sf_dir).select("doc_id", "text"), passage=(suffixes.PASSAGE, suffixes.PASSAGE_SEED))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.train_and_score(C.documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", C.held_out(10)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = C.documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", C.held_out(5))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs.where(~F.col("held_out")), labels.where(~C.held_out(5)))
    return quality.score(docs, model)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    docs = C.documents(spark, sf_dir)
    store = sharding.ShardStore(spark, f"{C.shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    sharding.load(store, docs)
    rows = store.read()
    return (docs.limit(0) if rows is None else rows).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def queries() -> dict:
    return {"op1_chat_format": op1_chat_format, "op2_sentencepiece": op2_sentencepiece, "op3_language_id": op3_language_id, "op4_exact_topk": op4_exact_topk, "op5_near_duplicates": op5_near_duplicates, "op6_decontamination": op6_decontamination, "op7_suffix_dedup": op7_suffix_dedup, "op8_lm_score": op8_lm_score, "op9_quality": op9_quality, "op10_sharding": op10_sharding}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
                FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
            ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op10_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    }
