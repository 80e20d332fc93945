"""A corpus pipeline over ``documents``: five stages, each one numbered operator.

Every stage works on all that its predecessor kept and writes Parquet; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm.bpe import round_trip
from mixshard.llm.columns import small
from mixshard.llm.langid import held_out, identify, learn
from mixshard.llm.line_chunks import dedup_lines
from mixshard.llm.mixing import SHARE, mix
from mixshard.llm.ngram_join import jaccard_classes
from mixshard.session import cut, prepare_session, scratch_path

#: Documents whose language scores below this go (texts without a letter score 0).
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a recognised language stay. Null and letterless texts go;
    without any labelled text nothing can be judged and all stay."""
    net = learn(docs.where(~held_out()))
    if net is None:
        return docs
    return identify(spark, docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated multi-line chunks leave the texts; ``n_chars`` follows. Every
    document stays, with an empty text if all of it was repeated."""
    out = dedup_lines(spark, docs)
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near duplicates the smallest id stays (five-word shingles,
    similarity 80 in 100). Rows that repeat an id are one document; a null id is no member
    of a group, and its row stays."""
    again = cut(jaccard_classes(spark, docs, n=5, percent=80).where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "again")
    return docs.join(small(again), "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents sampled to raked source, language and topic weights, with a fixed
    share of the tokens. Texts without a token go."""
    return mix(spark, docs, share=SHARE).where("kept").select("row.*").select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: (doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return round_trip(spark, docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: Language identification and BPE cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    prepare_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
