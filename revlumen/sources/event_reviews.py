"""Review-shaped views over the event table.

The event table carries no text, so every column of a review is derived from
the event's own columns by plain arithmetic. The views grow with the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlumen.functions.text import sql_string

# Review texts, one per residue of the template formula.
TEMPLATES = (
    "I can't login to my account since the update",
    "The payment failed and my money missing from balance",
    "Crash detection not working on my phone",
    "This is a scam, they stole from me",
    "Location not updating for my son all day",
    "SOS button fails completely when I press it",
    "There is a bug in the chores screen with an error",
    "App is slow and freezes on the savings page",
    "Wish there was a dark mode, please add it",
    "The menu is confusing and hard to use",
    "Great app, love it and thanks to the team",
    "Notifications arrive late but it is good overall",
    "Customer service gave no response for a week",
    "I want to cancel and you made it unable to close",
    "My plaid bank link keeps not syncing",
    "Need a refund, the subscription price is unfair",
    "Otp code never arrives on my new phone",
    "The driving report is wrong about my driving score",
    "Write me at jane.doe@example.com about registration",
    "Call 415-555-0198 now, the card controls hang",
    "Seen at 37.7749, -122.4194 with the gps tracker broken",
    "ok !!! 12345",
    "Just a new device and it does things differently",
    "Stranger danger, emergency alert failed twice",
)
LOCALES = ("en-US", "fr-FR", "de-DE")
PLATFORM_CYCLE = ("play_store", "app_store", "unknown")
MODELS = ("gpt-4o-mini", "gpt-4o", "claude-3.5-sonnet", "claude-3-haiku", "other")
MESSAGES = ("Request timeout after 20000 ms", "HTTP 429 Too Many Requests", "Rate limit reached",
            "socket hang up", "Provider returned an error")
# External answers: full, partial, invalid severity, blank fields, empty, broken JSON.
ANSWERS = (
    '{"feature_area":"Notifications","issue_type":"UX","severity":"P2"}',
    '{"severity":"P1"}',
    '{"issue_type":"Bug","severity":"CRITICAL"}',
    '{"feature_area":"","issue_type":"","severity":""}',
    '{}',
    'not json {',
)
RAW_SCORES = ("4.7", "5 stars", "", "3", "abc", " 2", "9", "1")
RAW_THUMBS = ("0", "12", "", "-1", "7 likes")
PAYLOAD_DATES = ("date", "updated", "updatedAt", "created", "createdAt")


def pick(values, index: Column) -> Column:
    """The element of a literal list at a 0-based index column."""
    literal = F.expr("array(" + ", ".join(sql_string(v) for v in values) + ")")
    return F.element_at(literal, (index + 1).cast("int"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as an instant."""
    return spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def iso_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def reviews_from_events(events: DataFrame) -> DataFrame:
    """One valid raw review per event."""
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return events.select(
        F.concat(F.lit("r"), event).alias("review_id"),
        pick(TEMPLATES, (event * 7 + user) % len(TEMPLATES)).alias("content"),
        (1 + (event * 3 + user) % 5).cast("int").alias("score"),
        F.col("ts").alias("review_ts"),
        iso_string(F.col("ts")).alias("review_created_at"),
        F.concat(F.lit("1."), user % 4, F.lit(".0")).alias("app_version"),
        F.when(kind == "view", "Android 14").when(kind == "click", "iOS 17").otherwise("").alias("os_version"),
        F.concat(F.lit("dev-"), user % 6).alias("device"),
        pick(LOCALES, user % 3).alias("locale"),
        pick(PLATFORM_CYCLE, event % 3).alias("platform"),
        event.alias("seq"),
    )


def unclean_rows_from_events(events: DataFrame) -> DataFrame:
    """Rows as they come out of a CSV file: all strings, aliases, bad values.

    Ids repeat (every third row takes the id of the row two before) and some
    ids, dates and names arrive only under their alias.
    """
    event, user = F.col("event_id"), F.col("user_id")
    key = F.concat(F.lit("r"), F.when(event % 3 == 2, event - 2).otherwise(event))
    return events.select(
        F.when(event % 4 == 1, "").otherwise(key).alias("review_id"),
        F.when(event % 4 == 1, key).alias("id"),
        pick(TEMPLATES, (event * 7 + user) % len(TEMPLATES)).alias("content"),
        pick(RAW_SCORES, event % len(RAW_SCORES)).alias("score"),
        pick(RAW_THUMBS, user % len(RAW_THUMBS)).alias("thumbs_up_count"),
        F.when(event % 2 == 0, iso_string(F.col("ts"))).alias("review_created_at"),
        F.when(event % 2 == 1, iso_string(F.col("ts"))).alias("date"),
        F.when(user % 2 == 0, F.concat(F.lit("user"), user)).alias("user_name"),
        F.when(user % 2 == 1, F.concat(F.lit("author"), user)).alias("author"),
        pick((*PLATFORM_CYCLE, "web"), event % 4).alias("platform"),
        event.alias("seq"),
    )


def store_payload_from_events(events: DataFrame) -> DataFrame:
    """Store payload rows: the date sits in one of five fields or is bad."""
    event, user = F.col("event_id"), F.col("user_id")
    raw_date = F.when(event % 7 == 6, "not a date").otherwise(iso_string(F.col("ts")))
    slots = [F.when(event % 6 == i, raw_date).alias(name) for i, name in enumerate(PAYLOAD_DATES)]
    return events.select(
        F.concat(F.lit("s"), event).alias("id"),
        F.when(user % 3 == 0, "").when(user % 3 == 1, F.concat(F.lit("user"), user)).alias("userName"),
        F.concat(pick(TEMPLATES, (event * 7 + user) % len(TEMPLATES)), F.lit("\nsecond line")).alias("text"),
        (1 + (event * 3 + user) % 5).cast("int").alias("score"),
        F.when(user % 4 != 0, F.concat(F.lit("1."), user % 4, F.lit(".0"))).alias("version"),
        *slots,
    )


def store_links_from_events(events: DataFrame) -> DataFrame:
    """Store links of every kind, good and bad."""
    event, user = F.col("event_id"), F.col("user_id")
    return events.select(
        event.alias("link_id"),
        F.when(event % 5 == 0, F.concat(F.lit("https://play.google.com/store/apps/details?id=com.app"), user,
                                        F.lit("&hl=en")))
        .when(event % 5 == 1, F.concat(F.lit("https://apps.apple.com/us/app/sample/id"), F.lit(1000000) + user))
        .when(event % 5 == 2, F.lit("https://play.google.com/store/apps/details?hl=en"))
        .when(event % 5 == 3, F.lit("https://apps.apple.com/us/app/sample"))
        .otherwise(F.concat(F.lit("https://example.com/app/id"), user)).alias("url"),
    )


def external_labels_from_events(events: DataFrame) -> DataFrame:
    """One external answer per review, valid or not; error events failed."""
    event, user = F.col("event_id"), F.col("user_id")
    return events.select(
        F.concat(F.lit("r"), event).alias("review_id"),
        pick(ANSWERS, (event + user) % len(ANSWERS)).alias("raw_response"),
        F.when(F.col("event_type") == "error", pick(MESSAGES, event % len(MESSAGES))).alias("error_message"),
        F.floor(F.col("value")).cast("bigint").alias("input_tokens"),
        (user % 40).alias("output_tokens"),
        pick(MODELS, event % len(MODELS)).alias("model"),
    )


def call_log_from_events(events: DataFrame) -> DataFrame:
    """Call log: error events are failed calls, keyed by user."""
    event, user = F.col("event_id"), F.col("user_id")
    ok = F.col("event_type") != "error"
    return events.select(
        user.alias("call_key"),
        F.col("ts"),
        event.alias("seq"),
        ok.alias("ok"),
        F.when(~ok, pick(MESSAGES, event % len(MESSAGES))).alias("message"),
        pick(MODELS, event % len(MODELS)).alias("model"),
        F.floor(F.col("value")).cast("bigint").alias("input_tokens"),
        (user % 40).alias("output_tokens"),
    )
