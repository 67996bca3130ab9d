"""Critical alerts from the rules alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlumen.functions.numbers import locale_key
from revlumen.functions.rules import classify
from revlumen.plans.analyze import SPAM_WARNING_RATIO, WARNING_SPAM
from revlumen.schema import require

DEFAULT_ALERT_LIMIT = 50
MAX_ALERT_LIMIT = 500


def alert_rows(classified: DataFrame, include_raw_text: bool = False) -> DataFrame:
    """Every P0 and P1 review that is not spam. No shuffle, no order."""
    text = F.col("content") if include_raw_text else F.col("text")
    return classified.where(~F.col("is_spam") & F.col("severity").isin("P0", "P1")).select(
        "review_id", text.alias("text"), "feature_area", "severity",
        (F.col("severity") == "P0").alias("requires_immediate_attention"))


def critical_alerts(reviews: DataFrame, limit: int = DEFAULT_ALERT_LIMIT, include_raw_text: bool = False) -> DataFrame:
    """The leading alerts: P0 before P1, then by id."""
    require(1 <= limit <= MAX_ALERT_LIMIT, f"limit must be 1..{MAX_ALERT_LIMIT}")
    alerts = alert_rows(classify(reviews), include_raw_text)
    return alerts.orderBy("severity", locale_key(F.col("review_id"))).limit(limit)


def alert_metadata(reviews: DataFrame, total_input=None, limit: int = DEFAULT_ALERT_LIMIT) -> DataFrame:
    """Counters of an alert run.

    ``total_input`` (a number or scalar column) is the row count before
    validation and dedupe; spam is counted among the unique reviews.
    """
    alert = ~F.col("is_spam") & F.coalesce(F.col("severity").isin("P0", "P1"), F.lit(False))
    sums = classify(reviews).agg(
        F.count("*").alias("_unique"), F.count_if("is_spam").alias("filtered_spam"),
        F.count_if(alert).alias("total_alerts"))
    n = F.col("_unique") if total_input is None else (
        F.lit(total_input) if isinstance(total_input, int) else total_input)
    counted = sums.withColumn("total_reviews_input", n.cast("bigint"))
    ratio = F.when(F.col("total_reviews_input") > 0,
                   F.col("filtered_spam") / F.col("total_reviews_input")).otherwise(0.0)
    return counted.select(
        "total_reviews_input", "filtered_spam", ratio.alias("spam_ratio"),
        (F.col("total_reviews_input") - F.col("filtered_spam")).alias("total_processed"),
        "total_alerts", F.least("total_alerts", F.lit(limit).cast("bigint")).alias("returned_alerts"),
        F.array_compact(F.array(F.when(ratio > SPAM_WARNING_RATIO, WARNING_SPAM))).alias("warnings"),
    )
