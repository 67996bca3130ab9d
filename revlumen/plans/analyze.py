"""Analyse reviews and report on the run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlumen.functions.rules import classify
from revlumen.operators.calls import budget_guard, cost_units, to_usd
from revlumen.operators.filters import DAY_COLUMN, newest_first, review_time
from revlumen.operators.labels import analyzed_rows, merge_labels
from revlumen.operators.validity import keep_first
from revlumen.schema import optional
# Thresholds and texts of the run report.
DEFAULT_RECENT_REVIEWS = 300
COVERAGE_DROP_RATIO = 0.4
SPAM_WARNING_RATIO = 0.2
WARNING_FALLBACK = "LLM Fallback Triggered"
WARNING_SPAM = "Suspiciously high spam ratio detected."
WARNING_BUDGET = "Budget guardrail triggered; routed reviews fell back to rule engine."


def recency_order():
    """Newest first, undated last, then input order."""
    return [F.coalesce(F.col("review_ts"), F.timestamp_seconds(F.lit(0))).desc(), F.col("seq").asc()]


def classify_reviews(reviews: DataFrame, labels: DataFrame | None = None,
                     recent_limit: int | None = None) -> DataFrame:
    """Every review with its labels, spam included.

    All rows are read; ``recent_limit`` keeps the newest ones only.
    """
    rows = reviews if recent_limit is None else newest_first(reviews, recent_limit)
    return merge_labels(classify(rows), labels)


def _first_calls(labels: DataFrame) -> DataFrame:
    """One call per review, the one whose answer ``merge_labels`` takes."""
    order = "seq" if "seq" in labels.columns else "raw_response"
    calls = labels.select("review_id", "model", "input_tokens", "output_tokens", optional(labels, "error_message").alias("error_message"),
                          F.col(order).alias("_order"))
    return keep_first(calls, "review_id", "_order").drop("_order")


def apply_budget(rows: DataFrame, labels: DataFrame, budget_usd: float) -> DataFrame:
    """Mark which routed reviews fit the budget, newest first.

    Each routed review costs what its first label row says; failed calls are free.
    """
    routed = rows.where("needs_label").select("review_id", "review_ts", "seq").join(_first_calls(labels), "review_id")
    guarded = budget_guard(routed, budget_usd, recency_order())
    return rows.join(guarded.select("review_id", "within_budget"), "review_id", "left")


def analyze(reviews: DataFrame, labels: DataFrame | None = None, include_raw_text: bool = False,
            recent_limit: int | None = None) -> DataFrame:
    """The analysed reviews without spam."""
    return analyzed_rows(classify_reviews(reviews, labels, recent_limit), include_raw_text)


def write_analyzed(analyzed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store analysed reviews as Parquet partitioned by UTC day.

    The rebalance hint lets a day with many rows spread over several files of
    even size. Date filters prune the day folders (see ``filter_reviews``).
    """
    dated = analyzed.withColumn(DAY_COLUMN, F.to_date("review_ts")).hint("rebalance", DAY_COLUMN)
    dated.write.mode(mode).partitionBy(DAY_COLUMN).parquet(path)


def analyze_metadata(rows: DataFrame, available: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """One row of counters, ratios, warnings and reasons over classified rows.

    ``available`` is the number of reviews before a recency limit.
    """
    spam = F.col("is_spam")
    hybrid = ~spam & (F.col("classification_source") == "hybrid")
    reason = F.col("fallback_reason")
    failed = reason.isin("timeout", "rate_limited", "provider_failure")
    asked = hybrid | failed
    moment = F.coalesce(review_time(rows), F.timestamp_seconds(F.lit(0)))
    place = F.col("seq") if "seq" in rows.columns else F.col("review_id")
    order = F.struct((-F.unix_micros(moment)).alias("age"), place.alias("place"))
    sums = rows.agg(
        F.count("*").alias("total_reviews_input"),
        F.count_if(spam).alias("filtered_spam"),
        F.count_if(hybrid).alias("hybrid_count"),
        F.count_if(hybrid & F.col("needs_label")).alias("llm_routed_count"),
        F.count_if(reason == "timeout").alias("timeout_count"),
        F.count_if(reason == "rate_limited").alias("rate_limit_count"),
        F.count_if(failed).alias("retry_count"),
        F.count_if(reason == "budget_guardrail").alias("budget_guardrail_count"),
        # Calls go newest first, so the oldest asked row is the last call.
        F.coalesce(F.max_by(F.when(asked, failed), F.when(asked, order)), F.lit(False)).alias("_last_failed"),
    )
    n, done = F.col("total_reviews_input"), F.col("total_reviews_input") - F.col("filtered_spam")
    total = F.lit(available).cast("bigint") if available is not None else n
    counted = sums.withColumns({
        "total_reviews_available": total,
        "sampled": total > n,
        "total_processed": done,
        "rule_only_count": done - F.col("hybrid_count"),
        "spam_ratio": F.when(n > 0, F.col("filtered_spam") / n).otherwise(0.0),
        "llm_routed_ratio": F.when(done > 0, F.col("llm_routed_count") / done).otherwise(0.0),
    })
    result = counted.withColumns({
        "rule_coverage_drop": F.col("llm_routed_ratio") > COVERAGE_DROP_RATIO,
        "warnings": F.array_compact(F.array(
            F.when(F.col("_last_failed"), WARNING_FALLBACK),
            F.when(F.col("spam_ratio") > SPAM_WARNING_RATIO, WARNING_SPAM),
            F.when(F.col("budget_guardrail_count") > 0, WARNING_BUDGET))),
        "degraded_reasons": F.array_compact(F.array(
            F.when(F.col("_last_failed"), "llm_fallback_triggered"),
            F.when(F.col("timeout_count") > 0, "llm_timeout"),
            F.when(F.col("rate_limit_count") > 0, "rate_limited"),
            F.when(F.col("budget_guardrail_count") > 0, "budget_guardrail"))),
    }).withColumn("degraded_mode", F.size("degraded_reasons") > 0).drop("_last_failed")
    if labels is not None:
        result = result.withColumn("cost_estimate_usd", _label_cost(rows, labels))
    return result


def _label_cost(rows: DataFrame, labels: DataFrame):
    """Cost of the answered calls, as a scalar."""
    used = rows.where("needs_label and fallback_reason is null").select("review_id").join(_first_calls(labels), "review_id")
    cost = F.sum(cost_units(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))
    return used.agg(to_usd(F.coalesce(cost, F.lit(0))).alias("c")).scalar()
