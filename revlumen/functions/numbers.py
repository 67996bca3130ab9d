"""Rounding, guarded ratios and locale order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding through a decimal, so engines agree on the last digit."""
    return F.round(value.cast("decimal(24,10)"), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def locale_key(value: Column) -> Column:
    """Sort key in locale order ("Savings" before "SOS")."""
    return F.collate(value.cast("string"), "UNICODE")
