"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows of the stage before. All but the
last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceforge.llm import langid, minhash, packing, quality

#: Documents whose quality score is lower are rejected.
QUALITY_THRESHOLD = 0.3
#: Documents whose language is undetermined, or whose score (product of two mean chances of at least one half each with two
#: families of two languages) is near its least, are rejected.
LANGUAGE_SCORE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose whole text the classifier, learned from ``labels``, doesn't reject; nulls are empty texts."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, QUALITY_THRESHOLD, keep=docs.columns).filter("predicted = 1").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose language is determined with a score of at least LANGUAGE_SCORE."""
    model = langid.train(table(spark, sf_dir, "documents"))
    told = langid.identify(docs, model, "text", keep=docs.columns)
    return told.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates (five words, 0.8 or more)."""
    return minhash.deduplicated(docs, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens: a row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_classifier), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("best-fit packing", best_fit_packing)]

#: SQL can't train or tokenize; the operators' tests hold what the stages call against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    from traceforge.llm._common import saved

    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{k}")
    return docs
