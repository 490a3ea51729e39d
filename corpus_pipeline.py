"""From documents to packed training sequences: quality, near duplicates, repeated passages, personal data, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import neardup, packing, pii, quality, suffixdup
from marketlens.llm.common import Scratch, documents
from marketlens.llm.queries import gpt_encoder


def counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, similar from 80 percent on."""
    return neardup.keep_first(docs, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand elsewhere; a text that is nothing else becomes empty."""
    return counted(suffixdup.shortened(docs))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it generalised or removed."""
    return counted(pii.sanitised(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences."""
    return packing.pack(docs, gpt_encoder)


STAGES = [("quality", keep_good), ("near_duplicates", keep_first), ("repeated_passages", remove_repeats), ("personal_data", sanitise), ("packing", pack)]
#: Expectation-maximisation, interleave refinement and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(f"{i}-{name}", stage(spark, docs, sf_dir))
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
