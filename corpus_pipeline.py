"""From raw documents to token ids: five stages, each reading what the one before wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.decontaminate import drop_contaminated
from seriesmill.llm.exact_dedup import drop_exact_copies
from seriesmill.llm.pieces import round_trip
from seriesmill.llm.quality import drop_low_quality
from seriesmill.llm.simhash import drop_near_copies
from seriesmill.session import shared_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    NULL and empty texts score as texts without words, equal rows alike; without labels every row stays.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays, then the smallest id, NULL last; of repeated rows one.

    NULL and empty texts are equal to each other.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of close fingerprints the smallest id stays, NULL last; of repeated rows one.

    Texts without words, NULL included, are one component.
    """
    return drop_near_copies(docs, shingle=4, distance=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; NULL and empty texts hold none, repeated rows all stay or all go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=5, share=0.8)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as ids; decoded again, which gives the text back.

    NULL and empty texts have the begin and end ids; repeated rows each have a row.
    """
    return round_trip(docs, MODEL).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the classifier, the fingerprints nor the pieces; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    An empty table gives an empty result at every stage; columns beside those of ``documents`` pass through all
    but the last.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
