"""Health and cost of external calls, from a call log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.operators.running import running_total, with_lookback_blocks
from revlumen.schema import optional

# Breaker limits, prices in USD per million tokens (input,
# output) by model-name substring in order of precedence, default token count.
ROLLING_CALLS = 50
FAILURE_RATE_LIMIT = 0.15
STREAK_LIMIT = 10
PRICES = (
    ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4o", 5.0, 15.0),
    ("claude-3.5-sonnet", 3.0, 15.0),
    ("claude-3-haiku", 0.25, 1.25),
)
DEFAULT_PRICE = (0.25, 1.25)
DEFAULT_TOKENS = 50
# Costs add up as integers of 1e-8 USD, so sums do not depend on their order.
UNITS_PER_USD = 10 ** 8


def failure_class(message: Column) -> Column:
    """timeout, rate_limited or provider_failure."""
    low = F.lower(message)
    return (F.when(low.contains("timeout"), "timeout")
            .when(low.contains("429") | low.contains("rate"), "rate_limited")
            .otherwise("provider_failure"))


def _price_units(model: Column, side: int) -> Column:
    """Price of one token in 1e-8 USD."""
    name = F.lower(F.coalesce(model, F.lit("")))
    chain = None
    for part, *prices in PRICES:
        value = F.lit(round(prices[side] * 100))
        chain = F.when(name.contains(part), value) if chain is None else chain.when(name.contains(part), value)
    return chain.otherwise(F.lit(round(DEFAULT_PRICE[side] * 100))).cast("bigint")


def tokens_or_default(tokens: Column) -> Column:
    return F.coalesce(F.nullif(tokens.cast("bigint"), F.lit(0).cast("bigint")),
                      F.lit(DEFAULT_TOKENS).cast("bigint"))


def cost_units(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of a call in 1e-8 USD."""
    return (tokens_or_default(input_tokens) * _price_units(model, 0)
            + tokens_or_default(output_tokens) * _price_units(model, 1))


def to_usd(units: Column) -> Column:
    return units.cast("double") / UNITS_PER_USD


def token_cost(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost per model; failed calls cost nothing."""
    good = calls.where("ok") if "ok" in calls.columns else calls
    tokens_in, tokens_out = F.col("input_tokens"), F.col("output_tokens")
    return good.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.sum(tokens_or_default(tokens_in)).alias("input_tokens"),
        F.sum(tokens_or_default(tokens_out)).alias("output_tokens"),
        to_usd(F.sum(cost_units(F.col("model"), tokens_in, tokens_out))).alias("cost_usd"),
    )


def failure_counts(calls: DataFrame) -> DataFrame:
    """Failed calls per class."""
    failed = calls.where(~F.col("ok"))
    return (failed.groupBy(failure_class(optional(failed, "message")).alias("failure_class"))
            .agg(F.count("*").alias("calls")))


def call_states(calls: DataFrame, key: str = "call_key", order=("ts", "seq")) -> DataFrame:
    """Per call: its position in the key and whether it would trip the breaker.

    A failed call trips when the last 10 calls all failed, or when a full
    window of 50 calls failed at 15 % or more. Both look back a bounded number
    of rows, so a key with any number of calls is cut into overlapping blocks.
    """
    ordering = [F.col(c).asc() for c in order]
    narrow = calls.select(key, *order, F.col("ok"))
    placed = running_total(narrow, [key], ordering, F.lit(1), "position")
    blocks = with_lookback_blocks(placed, "position", ROLLING_CALLS - 1)
    base = W.partitionBy(key, "_block").orderBy("position")
    failed = (~F.col("ok")).cast("int")
    recent = base.rowsBetween(-(ROLLING_CALLS - 1), 0)
    streak = base.rowsBetween(-(STREAK_LIMIT - 1), 0)
    states = blocks.select(
        key, *order, "ok", "_halo", (F.col("position") + 1).alias("position"),
        F.count("*").over(recent).alias("_seen"), F.sum(failed).over(recent).alias("recent_failures"),
        F.sum(failed).over(streak).alias("_streak"),
    ).where(~F.col("_halo"))
    by_streak = ~F.col("ok") & (F.col("_streak") >= STREAK_LIMIT)
    by_rate = (~F.col("ok") & (F.col("_seen") == ROLLING_CALLS)
               & (F.col("recent_failures") / ROLLING_CALLS >= FAILURE_RATE_LIMIT))
    return states.select(key, *order, "ok", "position", "recent_failures",
                         by_streak.alias("trips_on_streak"), by_rate.alias("trips_on_rate"))


def call_health(calls: DataFrame, key: str = "call_key", order=("ts", "seq")) -> DataFrame:
    """Calls, failures and the first trip per key."""
    states = call_states(calls, key, order)
    trips = F.col("trips_on_streak") | F.col("trips_on_rate")
    return states.groupBy(key).agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.min(F.when(F.col("trips_on_streak"), F.col("position"))).alias("first_streak_trip"),
        F.min(F.when(F.col("trips_on_rate"), F.col("position"))).alias("first_rate_trip"),
        F.min(F.when(trips, F.col("position"))).alias("first_trip"),
    ).withColumn("tripped", F.col("first_trip").isNotNull())


def budget_guard(routed: DataFrame, budget_usd: float, order) -> DataFrame:
    """Add ``cost_before_usd`` and ``within_budget`` in the given order.

    A review is sent only while the cost of those before it is below the
    budget. A failed call (``ok`` false, or an ``error_message``) costs nothing.
    """
    cost = cost_units(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    if "ok" in routed.columns:
        cost = F.when(F.coalesce(F.col("ok"), F.lit(True)), cost).otherwise(0)
    if "error_message" in routed.columns:
        cost = F.when(F.col("error_message").isNull(), cost).otherwise(0)
    summed = running_total(routed, [], list(order), cost, "_before")
    limit = round(budget_usd * UNITS_PER_USD)
    return summed.select(*routed.columns, to_usd(F.col("_before")).alias("cost_before_usd"),
                         (F.col("_before") < limit).alias("within_budget"))
