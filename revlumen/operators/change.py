"""Spikes and the comparison of two windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlumen.functions.numbers import locale_key, ratio, round_to
from revlumen.operators.issues import CLUSTER, bucket_issue_counts, is_critical, issue_key, with_cluster
from revlumen.schema import optional, require


def spikes(df: DataFrame, bucket: str = "day", min_baseline_count: int = 1,
           spike_ratio_threshold: float = 2.0, top_n: int = 10) -> DataFrame:
    """Issues whose latest bucket exceeds their mean over earlier buckets.

    The mean runs over the earlier buckets that hold any review. An issue
    without a baseline has no score and ranks first. Fewer than two buckets
    give no rows.
    """
    return spikes_from_counts(bucket_issue_counts(df, bucket), min_baseline_count,
                              spike_ratio_threshold, top_n)


def spikes_from_counts(counts: DataFrame, min_baseline_count: int = 1,
                       spike_ratio_threshold: float = 2.0, top_n: int = 10) -> DataFrame:
    """``spikes`` over (time_bucket, issue_key, n) rows."""
    require(min_baseline_count >= 1, "min_baseline_count must be at least 1")
    require(spike_ratio_threshold >= 1, "spike_ratio_threshold must be at least 1")
    require(top_n >= 1, "top_n must be at least 1")
    counts = counts.select("time_bucket", "issue_key", "n")
    # The reviews are summed along so that both plans share the counts' exchange.
    span = counts.groupBy("time_bucket").agg(F.sum("n").alias("n")).agg(F.struct(
        F.max("time_bucket").alias("latest"), (F.count("*") - 1).alias("earlier"),
        F.sum("n").alias("reviews"))).scalar()
    latest, earlier = span["latest"], span["earlier"]
    in_latest = F.col("time_bucket") == F.col("_latest")
    per_key = (
        counts.withColumn("_latest", latest).groupBy("issue_key", "_latest").agg(
            F.coalesce(F.sum(F.when(in_latest, F.col("n"))), F.lit(0)).alias("current"),
            F.coalesce(F.sum(F.when(~in_latest, F.col("n"))), F.lit(0)).alias("baseline_total"),
        )
        .withColumn("_earlier", earlier)
        .where(F.col("_earlier") >= 1)
        .withColumn("_mean", F.col("baseline_total") / F.col("_earlier"))
    )
    ratio_to_mean = F.when(F.col("_mean") > 0, F.col("current") / F.col("_mean"))
    is_new = (F.col("_mean") == 0) & (F.col("current") > 0)
    found = per_key.where(
        (F.col("current") >= min_baseline_count) & (is_new | (ratio_to_mean >= spike_ratio_threshold)))
    return found.select(
        "issue_key", F.col("_latest").alias("bucket"),
        round_to(F.col("_mean"), 4).alias("baseline_rate"),
        F.col("current").cast("double").alias("current_rate"),
        round_to(ratio_to_mean, 4).alias("spike_score"),
        F.lit(True).alias("is_spike"),
    ).orderBy(F.col("spike_score").desc_nulls_first(), locale_key(F.col("issue_key"))).limit(top_n)


def _tagged(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Both windows in one frame, so one aggregate serves each comparison."""
    parts = []
    for df, is_current in ((baseline, False), (current, True)):
        parts.append(with_cluster(df.select(
            *CLUSTER, optional(df, "severity").alias("severity"), optional(df, "sentiment").alias("sentiment"),
            F.lit(is_current).alias("is_current"))))
    return parts[0].unionByName(parts[1])


def compare_metrics(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Total, negative share and critical share of both windows."""
    both = _tagged(baseline, current)
    now, before = F.col("is_current"), ~F.col("is_current")
    negative, critical = F.col("sentiment") == "Negative", is_critical(F.col("severity"))
    sums = both.agg(
        F.count_if(before).alias("bt"), F.count_if(now).alias("ct"),
        F.count_if(before & negative).alias("bn"), F.count_if(now & negative).alias("cn"),
        F.count_if(before & critical).alias("bc"), F.count_if(now & critical).alias("cc"),
    )

    def line(name, base, cur):
        return F.struct(F.lit(name).alias("metric"), base.cast("double").alias("baseline"),
                        cur.cast("double").alias("current"))

    rows = sums.select(F.inline(F.array(
        line("total_reviews", F.col("bt"), F.col("ct")),
        line("negative_share", ratio(F.col("bn"), F.col("bt")), ratio(F.col("cn"), F.col("ct"))),
        line("critical_share", ratio(F.col("bc"), F.col("bt")), ratio(F.col("cc"), F.col("ct"))),
    )))
    delta = F.col("current") - F.col("baseline")
    return rows.select(
        "metric", "baseline", "current", round_to(delta, 4).alias("delta"),
        F.when(F.col("baseline") != 0, round_to(delta / F.col("baseline"), 4)).alias("delta_pct"),
        (delta > 0).alias("is_regression"),
    )


def compare_issues(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Counts per issue in both windows; an absent issue counts 0.

    Grouping the tagged union gives the full outer match with one shuffle.
    """
    counts = _tagged(baseline, current).groupBy(*CLUSTER).agg(
        F.count_if(~F.col("is_current")).alias("baseline"),
        F.count_if(F.col("is_current")).alias("current"),
    )
    delta = F.col("current") - F.col("baseline")
    return counts.select(
        issue_key(*[F.col(c) for c in CLUSTER]).alias("issue_key"), "baseline", "current",
        delta.alias("delta"),
        F.when(F.col("baseline") > 0, round_to(delta / F.col("baseline"), 4)).alias("delta_pct"),
        (delta > 0).alias("is_regression"),
    )


def top_regressions(issues: DataFrame, top_n: int = 5) -> DataFrame:
    return (issues.where(F.col("delta") > 0)
            .orderBy(F.col("delta").desc(), locale_key(F.col("issue_key"))).limit(top_n))


def top_improvements(issues: DataFrame, top_n: int = 5) -> DataFrame:
    return (issues.where(F.col("delta") < 0)
            .orderBy(F.col("delta").asc(), locale_key(F.col("issue_key"))).limit(top_n))
