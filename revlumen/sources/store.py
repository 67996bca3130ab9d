"""Store payloads, store links and the CSV sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlumen.functions.timeutil import parse_ts
from revlumen.schema import or_default

# Date fields of a payload in order of preference, the CSV
# header, and the hosts and pattern of store links.
PAYLOAD_DATE_FIELDS = ("date", "updated", "updatedAt", "created", "createdAt")
CSV_COLUMNS = ("review_id", "platform", "user_name", "content", "score", "app_version", "device",
               "os_version", "review_created_at")
PLAY_HOST, APPLE_HOST = "play.google.com", "apps.apple.com"
APPLE_ID_PATTERN = r"/id(\d+)"


def payload_date(df: DataFrame, now: Column) -> Column:
    """First date field that is present; ``now`` where it is absent or bad.

    Fields may be strings, timestamps or epoch milliseconds.
    """
    chosen = None
    for name in PAYLOAD_DATE_FIELDS:
        if name in df.columns:
            value = _instant(F.col(name), df.schema[name].dataType)
            given = F.col(name).isNotNull()
            chosen = F.when(given, value) if chosen is None else chosen.when(given, value)
    return now if chosen is None else F.coalesce(chosen, now)


def _instant(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        return F.timestamp_millis(value.cast("bigint"))
    if isinstance(dtype, T.StringType):
        return parse_ts(value)
    return value.cast("timestamp")


def normalize_payload(df: DataFrame, platform: str, now: Column | None = None) -> DataFrame:
    """Store payload rows as raw reviews. ``now`` defaults to the job's clock."""
    now = F.current_timestamp() if now is None else now
    return df.select(
        F.col("id").cast("string").alias("review_id"),
        F.lit(platform).alias("platform"),
        or_default(F.col("userName"), "Anonymous").alias("user_name"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("content"),
        F.col("score"),
        or_default(F.col("version"), "Unknown").alias("app_version"),
        F.lit("Unknown").alias("device"),
        F.lit("Unknown").alias("os_version"),
        F.date_format(payload_date(df, now), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("review_created_at"),
    )


def app_link_columns(url: Column) -> list[Column]:
    """``platform``, ``app_id`` and ``link_error`` of a store link."""
    is_play, is_apple = url.contains(PLAY_HOST), url.contains(APPLE_HOST)
    app_id = (
        F.when(is_play, F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("id")), F.lit("")))
        .when(is_apple, F.nullif(F.regexp_extract(url, APPLE_ID_PATTERN, 1), F.lit("")))
    )
    error = (
        F.when(app_id.isNotNull(), F.lit(None))
        .when(is_play, "play_store link without an id")
        .when(is_apple, "app_store link without a numeric id")
        .otherwise("unsupported link")
    )
    return [
        F.when(is_play, "play_store").when(is_apple, "app_store").alias("platform"),
        app_id.alias("app_id"),
        error.alias("link_error"),
    ]


def write_reviews_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write raw reviews as CSV part files, doubling quotes inside fields."""
    (df.select(*CSV_COLUMNS).write.mode(mode)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))
