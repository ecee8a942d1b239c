"""Evaluation: gold against predictions, error rates, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.functions.bands import ratio
from blockquery.functions.text import char_error_rate


def gold_vs_results(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Gold rows with the result of their key, if any: extra results are ignored."""
    return gold.join(results, ["case_id", "field_key"], "left")


def case_score(joined: DataFrame, by: list[str]) -> DataFrame:
    """Counts and guarded ratios of expected against actual codes; evidence coverage is 1 when nothing was predicted."""
    actual, expected = F.col("actual"), F.col("expected")
    known, gold_known = actual.isNotNull() & (actual != "unknown"), expected != "unknown"
    correct = F.coalesce(actual == expected, F.lit(False))
    covered = known & F.col("has_evidence")
    auto = F.coalesce(F.col("auto_accepted"), F.lit(False))

    def count(c: Column) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False)))

    counted = joined.groupBy(*by).agg(
        F.count("*").alias("total"),
        count(correct).alias("correct"),
        count(correct & gold_known).alias("true_positive"),
        count(known).alias("predicted_known"),
        count(gold_known).alias("gold_known"),
        count(known & ~gold_known).alias("misfill"),
        count(covered).alias("covered"),
        count(auto).alias("auto_accept"),
        count(auto & correct).alias("auto_correct"),
    )
    return counted.select(
        "*",
        F.round(ratio(F.col("correct"), F.col("total")), 6).alias("accuracy"),
        F.round(ratio(F.col("true_positive"), F.col("predicted_known")), 6).alias("precision"),
        F.round(ratio(F.col("true_positive"), F.col("gold_known")), 6).alias("recall"),
        F.round(ratio(F.col("auto_correct"), F.col("auto_accept")), 6).alias("auto_accept_precision"),
        F.round(ratio(F.col("covered"), F.col("predicted_known"), 1.0), 6).alias("evidence_coverage"),
        F.round(ratio(F.col("misfill"), F.col("total")), 6).alias("unknown_misfill_rate"),
    )


def page_error_rates(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """Full outer join of recognised and true page texts; a missing side is empty text."""
    joined = pages.join(truth, ["doc_id", "page"], "full_outer").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("truth", F.lit("")).alias("truth"))
    return joined.withColumn("cer", char_error_rate(F.col("text"), F.col("truth")))


def weighted_mean(metric: Column, weight: Column) -> Column:
    """Null metrics count as zero but keep their weight; null if all weights are zero."""
    return F.try_divide(F.sum(F.coalesce(metric, F.lit(0.0)) * weight), F.sum(weight))
