"""Recurring two-word phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Result when no review carries text.
NO_THEMES = ("No themes found", "Not enough data", "Unknown")


def phrase_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Reviews per two-word phrase.

    Phrases are distinct within a review before they are exploded, so a plain
    count equals the number of reviews and is combined map-side.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = df.select(words.alias("w")).where(F.size("w") > 1).select(
        F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1),
                   lambda a, b: F.concat(a, F.lit(" "), b)).alias("p"))
    return (pairs.select(F.explode(F.array_distinct("p")).alias("theme"))
            .groupBy("theme").agg(F.count("*").alias("review_count")))


def top_themes(df: DataFrame, text: str = "text", limit: int = 3) -> DataFrame:
    return phrase_counts(df, text).orderBy(F.col("review_count").desc(), "theme").limit(limit)


def theme_list(df: DataFrame, text: str = "text", limit: int = 3) -> DataFrame:
    """One row with the leading phrases, or the fixed words when there are none."""
    top = top_themes(df, text, limit).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("review_count")).alias("n"), "theme"))).alias("t"))
    fallback = F.array(*[F.lit(t) for t in NO_THEMES])
    return top.select(F.when(F.size("t") > 0, F.col("t.theme")).otherwise(fallback).alias("top_themes"))
