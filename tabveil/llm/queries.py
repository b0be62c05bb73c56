"""Queries of the corpus operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.llm import classifier, decontaminate, jaccard, lines, lm, mixing, oracles, quality, secrets, suffix, tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    only = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(only), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    copies = F.size("positions")
    last = F.when(copies > 0, F.get("positions", copies - 1))
    return out.select("doc_id", "size", "source_size", "target", "taken", copies.cast("long").alias("copies"), F.round("position", 9).alias("position"), F.round(last, 9).alias("last_position"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rules(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the mean score of a word under all other rows, which tells repeated texts from others; 0 without words."""
    out = lm.score(table(spark, sf_dir, "documents"))
    columns = {"rest_log_score": F.coalesce("rest_per_word", F.lit(0.0)), "log_score": F.col("log_score"), "per_word": F.col("per_word"), "rest_sum": F.col("rest_score")}
    return out.select("doc_id", "n_words", *(F.round(c, 6).alias(name) for name, c in columns.items()))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.lengths(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = [op1_secret_scan, op2_mixing, op3_suffix_dedup, op4_ngram_jaccard, op5_decontamination, op6_quality_rules, op7_line_dedup, op8_quality_classifier, op9_lm_scoring, op10_token_counts, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLE)
