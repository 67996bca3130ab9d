"""External labels, the analysed projection and attribute enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlumen.functions.rules import needs_external_label
from revlumen.operators.calls import failure_class
from revlumen.operators.filters import review_time
from revlumen.operators.validity import keep_first
from revlumen.schema import SEVERITIES, blank_to_null, optional, or_default


def parsed_labels(labels: DataFrame) -> DataFrame:
    """One parsed answer per review; broken JSON counts as an empty answer."""
    order = "seq" if "seq" in labels.columns else "raw_response"
    first = keep_first(labels.select(
        "review_id", "raw_response", F.col(order).alias("_order"),
        optional(labels, "error_message").alias("error_message")), "review_id", "_order")
    answer = F.try_parse_json("raw_response")

    def part(name: str) -> Column:
        return blank_to_null(F.try_variant_get(answer, f"$.{name}", "string"))

    return first.select(
        "review_id", part("feature_area").alias("_new_area"), part("issue_type").alias("_new_type"),
        part("severity").alias("_new_severity"), "error_message", F.lit(True).alias("_answered"),
    )


def merge_labels(classified: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Refine routed reviews by an external label table.

    Non-blank answer fields win. A merged severity outside the vocabulary
    sends the row back to its rule labels. Adds ``needs_label`` and
    ``fallback_reason``.
    """
    routed = needs_external_label(F.col("confidence_score"), F.col("feature_area"), F.col("severity"))
    rows = classified.withColumn("needs_label", routed & ~F.col("is_spam"))
    if labels is None:
        return rows.withColumn("fallback_reason", F.lit(None).cast("string"))
    within = optional(rows, "within_budget", "boolean")
    joined = rows.join(parsed_labels(labels), "review_id", "left")
    asked = F.col("needs_label") & F.coalesce(F.col("_answered"), F.lit(False)) & F.coalesce(within, F.lit(True))
    answered = asked & F.col("error_message").isNull()
    severity = F.coalesce("_new_severity", "severity")
    use = answered & (severity.isNull() | severity.isin(*SEVERITIES))
    unknown_type = F.when(F.col("issue_type") == "Unknown", "Performance").otherwise(F.col("issue_type"))
    reason = (F.when(F.col("needs_label") & ~F.coalesce(within, F.lit(True)), "budget_guardrail")
              .when(asked & F.col("error_message").isNotNull(), failure_class(F.col("error_message"))))
    flagged = joined.withColumns({"_use": use, "fallback_reason": reason})
    return flagged.withColumns({
        "feature_area": F.when(F.col("_use"), F.coalesce("_new_area", "feature_area"))
        .otherwise(F.col("feature_area")),
        "issue_type": F.when(F.col("_use"), F.coalesce(F.col("_new_type"), unknown_type))
        .otherwise(F.col("issue_type")),
        "severity": F.when(F.col("_use"), severity).otherwise(F.col("severity")),
        "classification_source": F.when(F.col("_use"), "hybrid").otherwise("rule_engine"),
    }).drop("_use", "_new_area", "_new_type", "_new_severity", "error_message", "_answered")


def analyzed_rows(classified: DataFrame, include_raw_text: bool = False) -> DataFrame:
    """The analysed layout for rows that are not spam.

    Attributes stay as flat columns next to ``signals``, so segments work on
    the result without joining the raw reviews again.
    """
    df = classified.where(~F.col("is_spam"))
    no_strings = F.array().cast("array<string>")
    signals = F.struct(
        F.lit("").alias("summary"), no_strings.alias("repro_hints"),
        or_default(optional(df, "device"), "Unknown").alias("device"),
        or_default(optional(df, "os_version"), "Unknown").alias("os_version"),
        or_default(optional(df, "app_version"), "Unknown").alias("app_version"),
        no_strings.alias("feature_mentions"),
    )
    carried = [c for c in ("app_version", "os_version", "device", "locale", "platform", "seq") if c in df.columns]
    return df.select(
        "review_id", (F.col("content") if include_raw_text else F.col("text")).alias("text"),
        optional(df, "review_created_at").alias("review_created_at"),
        review_time(df).alias("review_ts"), "score",
        "issue_type", "feature_area",
        or_default(F.col("severity"), "FYI").alias("severity"),
        or_default(F.col("sentiment"), "Neutral").alias("sentiment"),
        "confidence_score", "classification_source", signals.alias("signals"), *carried,
    )


def enrich(analyzed: DataFrame, raw: DataFrame, attributes) -> DataFrame:
    """Attach raw attributes by review id; rows without a match keep nulls."""
    order = "seq" if "seq" in raw.columns else attributes[0]
    first = keep_first(raw.select("review_id", *attributes, F.col(order).alias("_order")), "review_id", "_order")
    extra = first.drop("_order")
    return analyzed.drop(*attributes).join(extra, "review_id", "left")
