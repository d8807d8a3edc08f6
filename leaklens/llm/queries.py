"""The contract queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytecnn, decontaminate, host_rules, lm, minhash, mixing, pii, secrets, sharding, substrings
from .common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.NearDuplicates(table(spark, sf_dir, "documents"), shingle=4).report()


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.assess(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_host_rules": op2_host_rules,
        "op3_mix_sources": op3_mix_sources,
        "op4_pii": op4_pii,
        "op5_shard": op5_shard,
        "op6_quality": op6_quality,
        "op7_repeats": op7_repeats,
        "op8_lm_score": op8_lm_score,
        "op9_secrets": op9_secrets,
        "op10_decontaminate": op10_decontaminate,
    }
