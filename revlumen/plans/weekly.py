"""The weekly report and the summary, each from one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.functions.numbers import locale_key, round_to
from revlumen.operators.change import spikes_from_counts
from revlumen.operators.issues import (
    CLUSTER, cluster_order, clusters_from_cube, example_ids, feature_heatmap, report_cube, report_totals,
    severity_counts, totals_of,
)
from revlumen.operators.priority import map_clusters, score_clusters
from revlumen.operators.themes import theme_list
from revlumen.session import checkpointed


@dataclass(frozen=True)
class WeeklyReport:
    summary: DataFrame
    top_issues: DataFrame
    spike_alerts: DataFrame
    priority_rankings: DataFrame
    ownership_assignments: DataFrame | None


def weekly_report(df: DataFrame, rules: DataFrame | None = None, top_n: int = 5,
                  examples: bool = True) -> WeeklyReport:
    """Five small frames over one shared (day, cluster) aggregate.

    Example ids of the top issues cost a second read of the reviews when that
    frame is used; ``examples=False`` leaves them out.

    The aggregate is checkpointed: it holds one row per day and cluster, and
    without it each frame would scan and classify the reviews again.
    """
    cube = checkpointed(report_cube(df, "day"))
    clusters = clusters_from_cube(cube)
    spikes = spikes_from_counts(cube.where(F.col("time_bucket").isNotNull())
                                .groupBy("time_bucket", "issue_key").agg(F.sum("n").alias("n")), top_n=top_n)
    total = totals_of(clusters, ("review_count",))["review_count"]
    leading = clusters.orderBy(*cluster_order()).limit(top_n).withColumn(
        "affected_share", round_to(F.col("review_count") / F.greatest(total, F.lit(1)), 4))
    if examples:
        leading = leading.join(example_ids(df), list(CLUSTER), "left").orderBy(*cluster_order())
    owners = None if rules is None else map_clusters(clusters, rules, include_unmapped=False, top_n=top_n)
    return WeeklyReport(report_totals(cube), leading, spikes, score_clusters(clusters, top_n=top_n), owners)


def weekly_report_rows(report: WeeklyReport) -> DataFrame:
    """The report in long form: section, rank, issue_key, value, detail.

    Each section holds at most top_n rows when it is ranked.
    """
    def ranked(df: DataFrame, section: str, order, value, detail) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("section").orderBy(*order))
        tagged = df.withColumn("section", F.lit(section))
        return tagged.select("section", rank.alias("rank"), "issue_key",
                             value.cast("double").alias("value"), detail.alias("detail"))

    by_key = locale_key(F.col("issue_key"))
    totals = report.summary.select(F.inline(F.array(*[
        F.struct(F.lit("summary").alias("section"), F.lit(i).alias("rank"), F.lit(name).alias("issue_key"),
                 F.col(name).cast("double").alias("value"), F.lit("").alias("detail"))
        for i, name in enumerate(("total_reviews", "negative_share", "critical_share"), start=1)])))
    parts = [
        totals,
        ranked(report.top_issues, "top_issues", cluster_order(), F.col("review_count"),
               F.col("affected_share").cast("string")),
        ranked(report.spike_alerts, "spike_alerts", [F.col("spike_score").desc_nulls_first(), by_key],
               F.col("current_rate"), F.col("bucket")),
        ranked(report.priority_rankings, "priority_rankings",
               [F.col("impact_score").desc(), F.col("review_count").desc(), by_key],
               F.col("impact_score"), F.lit("")),
    ]
    if report.ownership_assignments is not None:
        parts.append(ranked(report.ownership_assignments, "ownership_assignments",
                            [F.col("review_count").desc(), by_key], F.col("review_count"),
                            F.concat_ws("/", "squad", "owner")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@dataclass(frozen=True)
class Summary:
    severity_counts: DataFrame
    heatmap: DataFrame
    themes: DataFrame


def summarize(df: DataFrame) -> Summary:
    """Severity counts, area by type counts and recurring phrases."""
    return Summary(severity_counts(df), feature_heatmap(df), theme_list(df))
