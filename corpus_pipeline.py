"""The corpus pipeline: language ID, near-dedup, suffix dedup, decontamination, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
what it keeps, with the columns of ``documents``; the last adds the encoded form.  Every
stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecrel.llm import common, decontaminate, langid, minhash, pieces, suffixes

#: A text whose best language has a lower posterior than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no letter, or no language clearly best."""
    model = langid.train(docs.select("doc_id", "text", "lang").where(~common.held_out(5)))
    if not model.langs:  # nothing to learn from: only texts without a letter go
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.recognised(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages: strings of PASSAGE bytes, shorter than those of the query of its own."""
    return suffixes.remove(docs, suffixes.PASSAGE, suffixes.PASSAGE_SEED)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its pieces."""
    return pieces.encode(docs)


STAGES = [
    ("language id", language),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", contaminated),
    ("sentencepiece encoding", encoded),
]

#: The learned and alignment stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
