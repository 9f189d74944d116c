"""Five stages from raw documents to training pieces; each reads what the one before wrote.

Stages take (spark, docs, sf_dir). The first four return the columns of documents; the last adds `piece_ids`.
Every stage takes null keys and texts, texts of any length, repeated rows, empty tables and extra columns of any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import common, decontaminate, lines, pieces, quality, simhash
from twinloom.llm.queries import LABEL_FOLD, PIECES, QUALITY_AT

#: The stages' methods and sampled pieces aren't SQL; tests/llm holds their operators against brute-force versions, stage by stage.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier doesn't reject. Equal texts, null and empty ones too, are all kept or all go; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~common.fold(F.col("doc_id"), *LABEL_FOLD))
    return quality.keep_good(docs, model, QUALITY_AT)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or resembles; n_chars follows the text. No row goes; rows with a null key or text stay as they are."""
    found = lines.dedup_lines(docs)
    return found.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else c for c, t in docs.dtypes))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate class, by key (null last) and then a hash of the text; of repeated rows one stays, and texts without words are one class."""
    return simhash.keep_first(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their sampled pieces; none for null and empty texts, the same for rows of equal key and text."""
    return pieces.encode(docs, pieces.load(PIECES))


STAGES = [("quality", good_quality), ("line_dedup", new_lines), ("near_dedup", one_of_each), ("decontamination", without_leaks), ("pieces", sampled_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
