"""The queries of this subpackage: thin digests of the operators' results, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import common as C
from twinloom.llm import decontaminate, language, licenses, lines, pieces, quality, simhash, spotsigs, toxicity, wordpiece
from twinloom.llm.oracle import ORACLE_SQL  # noqa: F401

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
LABEL_FOLD, LANGUAGE_FOLD = (5, 0), (3, 1)
QUALITY_AT, TOXIC_AT = 0.3, 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _judged(scored: DataFrame, at: float, *more: str) -> DataFrame:
    return scored.select("doc_id", C.fold(F.col("doc_id"), *LABEL_FOLD).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), *more)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = quality.train(docs, _labels(spark, sf_dir), ~C.fold(F.col("doc_id"), *LABEL_FOLD))
    return _judged(quality.score(docs, model), QUALITY_AT, "n_passages", "top_passage")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = toxicity.train(docs, _labels(spark, sf_dir), ~C.fold(F.col("doc_id"), *LABEL_FOLD))
    return _judged(toxicity.score(docs, model), TOXIC_AT, "n_clauses", "worst")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("bm25", F.round("bm25", 3))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(C.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(C.documents(spark, sf_dir)))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(C.documents(spark, sf_dir), pieces.load(PIECES))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(C.documents(spark, sf_dir), wordpiece.pieces_of(PIECES))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_with_next(C.documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    held = C.fold(F.col("doc_id"), *LANGUAGE_FOLD)
    found = language.predict(docs, language.train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(C.documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", "n_gone", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_decontamination, op4_simhash, op5_licenses, op6_pieces, op7_token_counts, op8_fingerprints, op9_language, op10_lines)}
