"""The ten operators and the corpus pipeline as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.runtime import table

from . import bpe, chunks, decontaminate, permutation, quality, repeats, secrets, simhash, toxicity, urls


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).where("toxic")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"), ask_every=20)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op7_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.occurrences(repeats.maximal_repeats(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # stands at the top of the repository

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_bpe, op4_quality, op5_neighbours, op6_url_filter, op7_maximal_repeats, op8_decontamination, op9_simhash, op10_secrets, pipeline)}
ORACLES: dict[str, str] = {"op6_url_filter": urls.oracle()}
