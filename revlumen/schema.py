"""Column layouts, enumerations and row-level validity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The label vocabulary shared with existing review data.
ISSUE_TYPES = (
    "Bug", "Performance", "UX", "Feature Request", "Account/Auth", "Payments/Transactions",
    "Billing/Pricing", "Trust/Fraud", "Support/Service", "Cancellation/Retention", "Data/Sync",
    "Safety Concern", "Praise", "Spam / Bot / Irrelevant",
)
FEATURE_AREAS = (
    "Crash Detection", "Driving Reports", "Family Location", "SOS", "Card Controls",
    "Allowance/Chores", "Savings/Investing", "Bank Linking", "Notifications", "Onboarding",
    "Login/OTP", "Other", "Unknown",
)
SEVERITIES = ("P0", "P1", "P2", "FYI")
SENTIMENTS = ("Positive", "Mixed", "Neutral", "Negative")
PLATFORMS = ("play_store", "app_store", "unknown")

OPTIONAL_TEXT_FIELDS = (
    "user_name", "review_created_at", "app_version", "device", "os_version", "locale",
    "reply_content", "reply_created_at",
)

RAW_REVIEW = T.StructType([
    T.StructField("review_id", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("score", T.IntegerType(), False),
    T.StructField("platform", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("thumbs_up_count", T.LongType()),
    T.StructField("review_created_at", T.StringType()),
    T.StructField("app_version", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("os_version", T.StringType()),
    T.StructField("locale", T.StringType()),
    T.StructField("reply_content", T.StringType()),
    T.StructField("reply_created_at", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("review_ts", T.TimestampType()),
])

SIGNALS = T.StructType([
    T.StructField("summary", T.StringType(), False),
    T.StructField("repro_hints", T.ArrayType(T.StringType()), False),
    T.StructField("device", T.StringType(), False),
    T.StructField("os_version", T.StringType(), False),
    T.StructField("app_version", T.StringType(), False),
    T.StructField("feature_mentions", T.ArrayType(T.StringType()), False),
])

ANALYZED_REVIEW = T.StructType([
    T.StructField("review_id", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("review_created_at", T.StringType()),
    T.StructField("review_ts", T.TimestampType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("issue_type", T.StringType(), False),
    T.StructField("feature_area", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("sentiment", T.StringType(), False),
    T.StructField("confidence_score", T.DoubleType(), False),
    T.StructField("classification_source", T.StringType(), False),
    T.StructField("signals", SIGNALS, False),
    T.StructField("app_version", T.StringType()),
    T.StructField("os_version", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("locale", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("seq", T.LongType()),
])

OWNERSHIP_RULE = T.StructType([
    T.StructField("rule_idx", T.IntegerType(), False),
    T.StructField("feature_area", T.StringType(), False),
    T.StructField("issue_type", T.StringType()),
    T.StructField("squad", T.StringType(), False),
    T.StructField("owner", T.StringType(), False),
])

def optional(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """Column ``name``, or a typed null when the frame does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def with_seq(df: DataFrame) -> DataFrame:
    """The frame with an input order: its own ``seq``, else the row position.

    Positions are stable for scans and literal rows; give other frames a
    ``seq`` of their own.
    """
    return df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id())


def blank_to_null(column: Column) -> Column:
    """Null for the empty string, the value otherwise."""
    return F.nullif(column, F.lit(""))


def or_default(column: Column, default: str) -> Column:
    """The value, or ``default`` where it is missing or the empty string."""
    return F.coalesce(blank_to_null(column), F.lit(default))


def require(condition: bool, message: str) -> None:
    """Raise ``ValueError`` for an option outside its documented bounds."""
    if not condition:
        raise ValueError(message)
