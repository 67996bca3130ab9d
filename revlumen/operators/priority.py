"""Priority scores and ownership of issue clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlumen.functions.numbers import round_to
from revlumen.operators.issues import cluster_order, issue_clusters, totals_of
from revlumen.schema import OWNERSHIP_RULE, blank_to_null, require


DRIVER_MEASURES = ("review_count", "p0_count", "p1_count", "avg_rating", "dated_count")


@dataclass(frozen=True)
class PriorityWeights:
    # Default weights of the four drivers.
    volume: float = 0.4
    severity: float = 0.3
    trend: float = 0.2
    rating_drag: float = 0.1


def half_split_trend(dated: Column) -> Column:
    """Growth of the later over the earlier half of n dated rows.

    The halves differ by one row at most, so it depends on n alone.
    """
    return F.when(dated >= 4, (dated % 2) / F.floor(dated / 2)).otherwise(0.0)


def priority_scores(df: DataFrame, weights: PriorityWeights = PriorityWeights(), top_n: int = 10,
                    max_clusters: int | None = None) -> DataFrame:
    """Clusters by weighted impact, from the cluster aggregate alone."""
    return score_clusters(issue_clusters(df), weights, top_n, max_clusters)


def score_clusters(clusters: DataFrame, weights: PriorityWeights = PriorityWeights(), top_n: int = 10,
                   max_clusters: int | None = None) -> DataFrame:
    """``priority_scores`` over cluster rows; ``max_clusters`` keeps the largest."""
    require(top_n >= 1, "top_n must be at least 1")
    clusters = clusters.select("issue_key", *DRIVER_MEASURES)
    total = totals_of(clusters, DRIVER_MEASURES)["review_count"]
    if max_clusters is not None:
        clusters = clusters.orderBy(*cluster_order()).limit(max_clusters)
    drivers = clusters.select(
        "issue_key", "review_count", "p0_count", "p1_count",
        (F.col("review_count") / F.greatest(total, F.lit(1))).alias("_volume"),
        ((F.col("p0_count") + F.col("p1_count")) / F.col("review_count")).alias("_critical"),
        half_split_trend(F.col("dated_count")).alias("_trend"),
        F.coalesce(F.greatest(F.lit(0.0), (5 - F.col("avg_rating")) / 4), F.lit(0.0)).alias("_drag"),
    )
    impact = (weights.volume * F.col("_volume") + weights.severity * F.col("_critical")
              + weights.trend * F.greatest(F.lit(0.0), F.col("_trend")) + weights.rating_drag * F.col("_drag"))
    scored = drivers.withColumn("impact_score", round_to(impact * 100, 2))
    return scored.orderBy(F.col("impact_score").desc(), *cluster_order()).limit(top_n).select(
        "issue_key", "review_count", "impact_score",
        round_to(F.col("_volume"), 4).alias("volume_share"),
        round_to(F.col("_critical"), 4).alias("critical_share"),
        round_to(F.col("_trend"), 4).alias("trend_velocity"),
        round_to(F.col("_drag"), 4).alias("rating_drag"),
    )


def ownership_rules(spark: SparkSession, rules) -> DataFrame:
    """Ordered rules ``(feature_area, issue_type or None, squad, owner)``."""
    rows = [(i, area, kind, squad, owner) for i, (area, kind, squad, owner) in enumerate(rules)]
    return spark.createDataFrame(rows, OWNERSHIP_RULE)


def assign_owners(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule per cluster in list order.

    A rule without an issue type matches its whole area. Rules are reduced to
    one per key first, so each cluster meets at most one exact and one
    area-wide rule and the joins never multiply rows.
    """
    match = F.struct("rule_idx", "squad", "owner")
    kind = blank_to_null(F.col("issue_type"))
    exact = rules.where(kind.isNotNull()).groupBy("feature_area", "issue_type").agg(
        F.min_by(match, "rule_idx").alias("_exact"))
    wide = rules.where(kind.isNull()).groupBy("feature_area").agg(F.min_by(match, "rule_idx").alias("_wide"))
    joined = clusters.join(exact, ["feature_area", "issue_type"], "left").join(wide, "feature_area", "left")
    first = F.when(
        F.col("_exact").isNotNull() & (F.col("_wide").isNull()
                                       | (F.col("_exact.rule_idx") < F.col("_wide.rule_idx"))),
        F.col("_exact"),
    ).otherwise(F.col("_wide"))
    return joined.withColumn("_rule", first).select(
        "issue_key", "issue_type", "feature_area", "review_count", "p0_count", "p1_count",
        blank_to_null(F.col("_rule.squad")).alias("squad"), blank_to_null(F.col("_rule.owner")).alias("owner"),
        F.col("_rule").isNull().alias("is_unmapped"),
    )


def ownership_map(df: DataFrame, rules: DataFrame, include_unmapped: bool = True, top_n: int = 20,
                  max_clusters: int | None = None) -> DataFrame:
    """Clusters with the squad and owner responsible for them."""
    return map_clusters(issue_clusters(df), rules, include_unmapped, top_n, max_clusters)


def map_clusters(clusters: DataFrame, rules: DataFrame, include_unmapped: bool = True, top_n: int = 20,
                 max_clusters: int | None = None) -> DataFrame:
    """``ownership_map`` over cluster rows; ``max_clusters`` keeps the largest."""
    require(top_n >= 1, "top_n must be at least 1")
    if max_clusters is not None:
        clusters = clusters.orderBy(*cluster_order()).limit(max_clusters)
    mapped = assign_owners(clusters, rules)
    if not include_unmapped:
        mapped = mapped.where(~F.col("is_unmapped"))
    return mapped.orderBy(*cluster_order()).limit(top_n).drop("p0_count", "p1_count")
