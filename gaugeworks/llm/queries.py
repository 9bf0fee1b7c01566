"""Queries over the training-data operators, each over its whole tables with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import authorship, credentials, docpairs, leaks, mixing, mojibake
from gaugeworks.sources import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(read_table(spark, d, "projects")).select("project_id", "chunk_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_credentials(read_table(spark, d, "projects"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(read_table(spark, d, "projects"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.code_description_pairs(read_table(spark, d, "projects"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return authorship.not_hand_written(read_table(spark, d, "projects")).select("project_id", "file").distinct()


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return authorship.not_hand_written(read_table(spark, d, "projects"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def _tokenizer(spark: SparkSession) -> str:
    """The vocabulary that sizes are counted with: ``spark.gaugeworks.tokenizer``, or the public one of this installation."""
    return spark.conf.get("spark.gaugeworks.tokenizer", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"), _tokenizer(spark))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read_table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(read_table(spark, d, "documents"), targets, _tokenizer(spark)), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(read_table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(read_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_pairs, p5_found, p5_reasons, p6_found, p7_mix, p7_shares, p8_found, p8_restored)
}

#: None of these can be said in SQL: they are tested against brute force, round trips and planted cases.
SQL: dict[str, str] = {}
