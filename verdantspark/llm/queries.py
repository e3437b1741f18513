"""The corpus operators' queries, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linededup, substring
from .ann import search
from .decontam import contamination
from .packing import pack_documents
from .quality import quality_scores
from .secrets import secret_spans
from .simhash import simhash_components
from .substring import repeated_windows
from .token_files import token_file_digest

from .toxicity import toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_copies(table(spark, sf_dir, "documents"), lone_words=linededup.LONE_WORDS)
    digests = found.select("doc_id", (F.col("kept_lines") + F.col("gone_lines")).alias("n_lines"), F.col("gone_lines").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
    return digests.hint("rebalance")  # rows without texts: a few files rather than one for each task that read texts


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontam.SLOP)
    joined = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.concat_ws(",", "near_items").alias("near_items"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows(table(spark, sf_dir, "documents"), k=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), k=4, distance=4)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 100 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.ORACLE_SQL, "op5_decontamination": decontam.ORACLE_SQL, "op7_substring": substring.ORACLE_SQL}
