"""Scoped top issues and the drill-down into one issue cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlumen.operators.filters import (
    ReviewFilters, filter_reviews, cluster_predicate, newest_first, window_filters,
)
from revlumen.operators.issues import top_issues
from revlumen.schema import require

DEFAULT_WINDOW = "this_week"
TOP_ISSUES = 25
DEFAULT_RESULTS = 100
MAX_RESULTS = 500


def scoped_top_issues(df: DataFrame, reference_date, window: str | None = None,
                      filters: ReviewFilters | None = None, limit: int = TOP_ISSUES) -> DataFrame:
    """Top issues of a window; this week unless a window or dates are given.

    The scope that applied is added as columns.
    """
    dated = bool(filters and (filters.start_date or filters.end_date))
    if window is None and not dated:
        window = DEFAULT_WINDOW
    applied = window_filters(window, reference_date, filters)
    return top_issues(df, applied, limit).withColumns({
        "window_applied": F.lit(window).cast("string"),
        "start_date": F.lit(applied.start_date).cast("string"),
        "end_date": F.lit(applied.end_date).cast("string"),
    })


def cluster_reviews(df: DataFrame, issue_type: str | None = None, feature_area: str | None = None,
                    include_unknown_only: bool = False, window: str | None = None, reference_date=None,
                    filters: ReviewFilters | None = None, max_results: int = DEFAULT_RESULTS) -> DataFrame:
    """The newest reviews of a cluster."""
    require(1 <= max_results <= MAX_RESULTS, f"max_results must be 1..{MAX_RESULTS}")
    considered = filter_reviews(df, window_filters(window, reference_date, filters))
    matched = considered.where(cluster_predicate(issue_type, feature_area, include_unknown_only))
    return newest_first(matched, max_results)


def cluster_counts(df: DataFrame, issue_type: str | None = None, feature_area: str | None = None,
                   include_unknown_only: bool = False, window: str | None = None, reference_date=None,
                   filters: ReviewFilters | None = None, max_results: int = DEFAULT_RESULTS) -> DataFrame:
    """Considered, matched and returned rows and the date range applied."""
    applied = window_filters(window, reference_date, filters)
    considered = filter_reviews(df, applied)
    counts = considered.agg(
        F.count("*").alias("total_reviews_considered"),
        F.count_if(cluster_predicate(issue_type, feature_area, include_unknown_only)).alias("total_cluster_matches"))
    return counts.withColumns({
        "returned": F.least("total_cluster_matches", F.lit(max_results).cast("bigint")),
        "start_date": F.lit(applied.start_date if applied else None).cast("string"),
        "end_date": F.lit(applied.end_date if applied else None).cast("string"),
    })
