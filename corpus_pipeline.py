"""A corpus pipeline: quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import minhash, packing, quality, repeats
from stratalens.llm.core import shared_folder
from stratalens.session import table

#: Bytes of a repeated passage; fifty words of prose have some three hundred.
PASSAGE = 240


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on the labels of this data.

    A null or blank text has weight 0, as one that nothing is known about;
    without labels of both kinds all documents stay.
    """
    return quality.keep_drawn(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; null and blank texts and null ids all stay."""
    return minhash.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; a character cut through at an edge goes too.

    A null text stays null; a text that repeats as a whole becomes empty. The
    column n_chars follows if there is one.
    """
    stripped = repeats.strip_texts(docs, length=PASSAGE)
    if "n_chars" in docs.columns:
        stripped = stripped.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars").cast("int")).cast(docs.schema["n_chars"].dataType))
    return stripped.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised texts and their places in sequences; a null text is its end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]
#: SQL cannot express the classifier or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents table; each but the last is written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
