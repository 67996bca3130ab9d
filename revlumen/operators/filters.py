"""Row filters shared by the analytics operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlumen.functions.timeutil import parse_instant, parse_ts, window_range
from revlumen.schema import optional, require


@dataclass(frozen=True)
class ReviewFilters:
    """Date bounds (inclusive instants) and value lists; empty lists match all.

    A date-only ``end_date`` means midnight at its start. Set
    ``end_inclusive_day`` to take the whole end day in.
    """

    start_date: str | None = None
    end_date: str | None = None
    severities: list[str] = field(default_factory=list)
    sentiments: list[str] = field(default_factory=list)
    feature_areas: list[str] = field(default_factory=list)
    issue_types: list[str] = field(default_factory=list)
    end_inclusive_day: bool = False


# Day partition of a stored analysed table.
DAY_COLUMN = "review_day"


def review_time(df: DataFrame) -> Column:
    """``review_ts`` where the frame carries it, else the parsed date string."""
    if "review_ts" in df.columns:
        return F.col("review_ts")
    return parse_ts(optional(df, "review_created_at"))


def window_filters(window: str | None, reference_date, filters: ReviewFilters | None = None) -> ReviewFilters | None:
    """Fill the date bounds from a named window unless bounds are given."""
    if window is None or (filters and (filters.start_date or filters.end_date)):
        return filters
    span = window_range(window, reference_date)
    return replace(filters or ReviewFilters(), start_date=span.start_date, end_date=span.end_date)


def date_predicate(ts: Column, start_date, end_date, end_inclusive_day: bool = False) -> Column | None:
    """Literal bounds on a timestamp column, so they reach the scan.

    A bound that is no date drops out, but a row still needs a valid date.
    """
    if not (start_date or end_date):
        return None
    parts = [ts.isNotNull()]
    start, end = parse_instant(start_date), parse_instant(end_date)
    if start_date and start is not None:
        parts.append(ts >= F.lit(start))
    if end_date and end is not None:
        if end_inclusive_day:
            day = end.replace(hour=0, minute=0, second=0, microsecond=0)
            parts.append(ts < F.lit(day + timedelta(days=1)))
        else:
            parts.append(ts <= F.lit(end))
    return reduce(and_, parts)


def _prune_days(df: DataFrame, filters: ReviewFilters) -> DataFrame:
    """The date bounds as whole days, which skip partition folders."""
    start, end = parse_instant(filters.start_date), parse_instant(filters.end_date)
    if filters.start_date and start is not None:
        df = df.where(F.col(DAY_COLUMN) >= F.lit(start.date()))
    if filters.end_date and end is not None:
        df = df.where(F.col(DAY_COLUMN) <= F.lit(end.date()))
    return df


def filter_reviews(df: DataFrame, filters: ReviewFilters | None) -> DataFrame:
    if filters is None:
        return df
    dates = date_predicate(review_time(df), filters.start_date, filters.end_date, filters.end_inclusive_day)
    if dates is not None:
        df = df.where(dates)
        if DAY_COLUMN in df.columns:
            df = _prune_days(df, filters)
    for name, allowed in (
        ("severity", filters.severities), ("sentiment", filters.sentiments),
        ("feature_area", filters.feature_areas), ("issue_type", filters.issue_types),
    ):
        if allowed:
            # A missing value counts as "", which matters only if "" is listed;
            # otherwise the plain test can be pushed into the scan.
            value = optional(df, name)
            df = df.where((F.coalesce(value, F.lit("")) if "" in allowed else value).isin(*allowed))
    return df


def cluster_predicate(issue_type: str | None = None, feature_area: str | None = None,
                      include_unknown_only: bool = False) -> Column:
    """Test for one issue type and/or area, compared without case."""
    kind = F.lower(F.coalesce(F.col("issue_type"), F.lit("")))
    area = F.lower(F.coalesce(F.col("feature_area"), F.lit("")))
    parts = [F.lit(True)]
    if include_unknown_only:
        parts.append((kind == "unknown") | (area == "unknown"))
    for column, wanted in ((kind, issue_type), (area, feature_area)):
        wanted = (wanted or "").strip().lower()
        if wanted:
            parts.append(column == wanted)
    return reduce(and_, parts)


def newest_first(df: DataFrame, limit: int) -> DataFrame:
    """The newest rows; rows without a date count as the epoch."""
    require(limit >= 1, "limit must be at least 1")
    epoch = F.timestamp_seconds(F.lit(0))
    keys = [F.coalesce(review_time(df), epoch).desc()]
    if "seq" in df.columns:
        keys.append(F.col("seq").asc())
    return df.orderBy(*keys).limit(limit)
