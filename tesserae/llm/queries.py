"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, importance, language_model, media_tiff, mixing, oracles, quality_cnn, sharding, simhash, suffix_dedup, token_counts, toxicity_crf
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.text_media(table(spark, sf_dir, "documents"))


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_crf.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.round("expected", 6).alias("expected_tokens"), F.size("spans").alias("n_spans"), "spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The contract's conversation whose texts are control strings.
_CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.formatted_digests(given.unionByName(spark.createDataFrame(_CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_quality_cnn, op3_language_model, op4_simhash, op5_token_counts, op6_media_tiff, op7_toxicity_crf, op8_mixing, op9_suffix_dedup, op10_decontaminate, op11_importance, op12_chat_format, op13_filter_audit)}
ORACLES = {"op1_sharding": oracles.OP1, "op8_mixing": oracles.OP8, "op11_importance": oracles.OP11, "op12_chat_format": oracles.OP12, "op13_filter_audit": oracles.OP13}
