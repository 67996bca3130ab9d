"""Lenient timestamps, UTC buckets and named date windows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlumen.schema import require

# Days each named window reaches back from its reference day.
LOOKBACK_DAYS = {
    "last_7_days": 6,
    "last_30_days": 29,
    "last_90_days": 89,
    "last_180_days": 179,
    "last_12_months": 364,
}
WINDOWS = ("this_week", *LOOKBACK_DAYS)
# Other date spellings that count as dates, as (Spark pattern, Python pattern).
OTHER_DATE_FORMATS = (
    ("yyyy/M/d", "%Y/%m/%d"),
    ("M/d/yyyy", "%m/%d/%Y"),
    ("MMM d, yyyy", "%b %d, %Y"),
    ("MMMM d, yyyy", "%B %d, %Y"),
    ("d MMM yyyy HH:mm:ss z", "%d %b %Y %H:%M:%S %Z"),
)
STARTS_WITH_YEAR = "^\\s*[+-]?[0-9]{4}"
WEEKDAY_PREFIX = "^[A-Za-z]{3}, "
BUCKET_UNITS = {"day": "DAY", "week": "WEEK"}


def parse_ts(value: Column) -> Column:
    """Timestamp of a date string, ISO first; null where it is blank or no date.

    A date starts with its year or follows another spelling, so a time of day
    alone is none. The other spellings are tried only on rows that are not ISO.
    """
    bare = F.regexp_replace(value, WEEKDAY_PREFIX, "")
    others = [F.try_to_timestamp(bare, F.lit(pattern)) for pattern, _ in OTHER_DATE_FORMATS]
    return F.coalesce(F.when(value.rlike(STARTS_WITH_YEAR), F.try_to_timestamp(value)), *others)


def time_bucket(ts: Column, unit: str = "day") -> Column:
    """First day of the UTC day or Monday week, as ``yyyy-MM-dd``."""
    require(unit in BUCKET_UNITS, f"bucket must be one of {sorted(BUCKET_UNITS)}")
    return F.trunc(ts, "WEEK").cast("string") if unit == "week" else F.to_date(ts).cast("string")


def parse_instant(value) -> datetime | None:
    """UTC instant of a date string, date or datetime; None if it is neither."""
    if isinstance(value, datetime):
        parsed = value
    elif isinstance(value, date):
        parsed = datetime(value.year, value.month, value.day)
    else:
        parsed = _parse_text(str(value).strip())
        if parsed is None:
            return None
    return parsed.replace(tzinfo=timezone.utc) if parsed.tzinfo is None else parsed.astimezone(timezone.utc)


def _parse_text(text: str) -> datetime | None:
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        pass
    bare = re.sub(WEEKDAY_PREFIX, "", text)
    for _, pattern in OTHER_DATE_FORMATS:
        try:
            return datetime.strptime(bare, pattern)
        except ValueError:
            continue
    return None


@dataclass(frozen=True)
class DateRange:
    start_date: str
    end_date: str


def window_range(window: str, reference_date) -> DateRange:
    """Literal date range of a named window, so that it prunes at the scan."""
    require(window in WINDOWS, f"window must be one of {WINDOWS}")
    reference = parse_instant(reference_date)
    require(reference is not None, "reference_date is not a date")
    day = reference.date()
    back = day.weekday() if window == "this_week" else LOOKBACK_DAYS[window]
    return DateRange((day - timedelta(days=back)).isoformat(), day.isoformat())


def window_start(window: str, reference: Column) -> Column:
    """Per-row form of ``window_range``: start date for a column of dates."""
    require(window in WINDOWS, f"window must be one of {WINDOWS}")
    if window == "this_week":
        return F.trunc(reference, "WEEK").cast("string")
    return F.date_sub(reference, LOOKBACK_DAYS[window]).cast("string")
