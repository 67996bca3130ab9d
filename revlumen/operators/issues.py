"""Issue clusters, segments, trends and severity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.functions.numbers import locale_key, ratio, round_to
from revlumen.functions.text import is_blank
from revlumen.functions.timeutil import time_bucket
from revlumen.operators.filters import ReviewFilters, filter_reviews, review_time
from revlumen.schema import ISSUE_TYPES, optional, or_default, require

# Examples per cluster and the segment dimensions.
EXAMPLES_PER_ISSUE = 3
SEGMENT_DIMENSIONS = ("app_version", "os_version", "device", "locale", "platform", "rating_bucket")
CLUSTER = ("issue_type", "feature_area")
MEASURES = ("review_count", "p0_count", "p1_count", "p2_count", "fyi_count", "avg_rating")


def issue_key(issue_type: Column, feature_area: Column) -> Column:
    return F.concat_ws("::", issue_type, feature_area)


def with_cluster(df: DataFrame) -> DataFrame:
    """Blank or missing issue types and areas become ``Unknown``."""
    return df.withColumns({
        "issue_type": or_default(F.col("issue_type"), "Unknown"),
        "feature_area": or_default(F.col("feature_area"), "Unknown"),
    })


def is_critical(severity: Column) -> Column:
    return F.coalesce(severity.isin("P0", "P1"), F.lit(False))


def average_rating(score: Column) -> Column:
    return round_to(F.avg(score), 2)


def issue_clusters(df: DataFrame) -> DataFrame:
    """Counts per (issue type, area): one partial + final hash aggregate.

    A few integers per key and task cross the shuffle, whatever the size of
    the largest cluster.
    """
    severity, ts = optional(df, "severity"), review_time(df)
    score = optional(df, "score", "int")
    rows = with_cluster(df.select(*CLUSTER, severity.alias("severity"), score.alias("score"),
                                  ts.isNotNull().alias("dated")))
    return rows.groupBy(*CLUSTER).agg(
        F.count("*").alias("review_count"),
        F.count_if(F.col("severity") == "P0").alias("p0_count"),
        F.count_if(F.col("severity") == "P1").alias("p1_count"),
        F.count_if(F.col("severity") == "P2").alias("p2_count"),
        F.count_if(~F.coalesce(F.col("severity").isin("P0", "P1", "P2"), F.lit(False))).alias("fyi_count"),
        average_rating(F.col("score")).alias("avg_rating"),
        F.count_if("dated").alias("dated_count"),
    ).withColumn("issue_key", issue_key(*[F.col(c) for c in CLUSTER]))


def cluster_order() -> list[Column]:
    """Largest first, then most critical, then by key in locale order."""
    return [F.col("review_count").desc(), (F.col("p0_count") + F.col("p1_count")).desc(),
            locale_key(F.col("issue_key")).asc()]


def totals_of(aggregate: DataFrame, measures) -> Column:
    """Sums of all ``measures`` as one scalar struct.

    A total of one measure alone would be planned over a pruned copy of the
    aggregate and scan the input again. Summing every measure the caller
    keeps makes both plans alike, so they share one exchange.
    """
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("double" if m == "avg_rating" else "bigint").alias(m)
            for m in measures]
    return aggregate.agg(F.struct(*sums).alias("totals")).scalar()


def example_ids(df: DataFrame, per_issue: int = EXAMPLES_PER_ISSUE) -> DataFrame:
    """First ids per cluster in input order.

    The window's row limit is applied inside each map task, so at most
    ``per_issue`` rows per cluster and task are shuffled.
    """
    order = F.col("seq") if "seq" in df.columns else F.struct(review_time(df).alias("ts"), "review_id")
    rows = with_cluster(df.select(*CLUSTER, "review_id", order.alias("_order"))).where(
        F.coalesce(F.col("review_id"), F.lit("")) != "")
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*CLUSTER).orderBy("_order")))
    return (
        ranked.where(F.col("_rn") <= per_issue).groupBy(*CLUSTER)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "review_id"))).alias("_ids"))
        .select(*CLUSTER, F.col("_ids.review_id").alias("example_review_ids"))
    )


def top_issues(df: DataFrame, filters: ReviewFilters | None = None, limit: int = 25) -> DataFrame:
    """The largest clusters with share, severities, rating and example ids."""
    rows = filter_reviews(df, filters)
    clusters = issue_clusters(rows).drop("dated_count")
    total = totals_of(clusters, MEASURES)["review_count"]
    leading = clusters.orderBy(*cluster_order()).limit(max(1, limit))
    joined = leading.join(example_ids(rows), list(CLUSTER), "left")
    return joined.select(
        "issue_key", *CLUSTER, "review_count",
        round_to(F.col("review_count") / F.greatest(total, F.lit(1)), 4).alias("affected_share"),
        F.struct(F.col("p0_count").alias("P0"), F.col("p1_count").alias("P1"),
                 F.col("p2_count").alias("P2"), F.col("fyi_count").alias("FYI")).alias("severity_breakdown"),
        "p0_count", "p1_count", "p2_count", "fyi_count", "avg_rating",
        F.coalesce("example_review_ids", F.array().cast("array<string>")).alias("example_review_ids"),
        total.alias("total_reviews_considered"),
    ).orderBy(*cluster_order())


def rating_bucket(score: Column) -> Column:
    return (F.when(score.isNull(), "unknown").when(score <= 2, "1-2").when(score == 3, "3").otherwise("4-5"))


def segment_value(df: DataFrame, dimension: str) -> Column:
    """Value of a segment; blank or missing becomes ``unknown``."""
    require(dimension in SEGMENT_DIMENSIONS, f"dimension must be one of {SEGMENT_DIMENSIONS}")
    if dimension == "rating_bucket":
        return rating_bucket(optional(df, "score", "int"))
    value = optional(df, dimension)
    return F.when(is_blank(value), "unknown").otherwise(value)


def _segment_aggregate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("segment_dimension", "segment_value").agg(
        F.count("*").alias("issue_count"),
        F.count_if(is_critical(F.col("severity"))).alias("p0_p1_count"),
        average_rating(F.col("score")).alias("avg_rating"),
    )


def segment_order() -> list[Column]:
    return [F.col("issue_count").desc(), F.col("p0_p1_count").desc(),
            locale_key(F.col("segment_value")).asc()]


def segment_breakdown(df: DataFrame, dimension: str, limit: int = 10,
                      filters: ReviewFilters | None = None) -> DataFrame:
    """Reviews, critical reviews and rating per value of one dimension."""
    rows = filter_reviews(df, filters)
    segments = _segment_aggregate(rows.select(
        F.lit(dimension).alias("segment_dimension"),
        segment_value(rows, dimension).alias("segment_value"),
        optional(rows, "severity").alias("severity"), optional(rows, "score", "int").alias("score"),
    ))
    return segments.orderBy(*segment_order()).limit(max(1, limit))


def segment_breakdowns(df: DataFrame, limit: int = 10, filters: ReviewFilters | None = None) -> DataFrame:
    """All dimensions from one scan, the largest ``limit`` values of each."""
    rows = filter_reviews(df, filters)
    cells = F.array(*[
        F.struct(F.lit(d).alias("segment_dimension"), segment_value(rows, d).alias("segment_value"))
        for d in SEGMENT_DIMENSIONS
    ])
    long = rows.select(F.inline(cells), optional(rows, "severity").alias("severity"),
                       optional(rows, "score", "int").alias("score"))
    rank = F.row_number().over(W.partitionBy("segment_dimension").orderBy(*segment_order()))
    return (_segment_aggregate(long).withColumn("_rn", rank)
            .where(F.col("_rn") <= max(1, limit)).drop("_rn"))


def segment_report(df: DataFrame, dimension: str, limit: int = 10, filters: ReviewFilters | None = None) -> DataFrame:
    """``segment_breakdown`` with the number of reviews considered as its first row.

    ``section`` is ``total`` or ``segment``. The total counts every review that
    passes the filters, those of segments beyond ``limit`` too, and is there
    with 0 when none does. Both parts read one small aggregate.
    """
    rows = filter_reviews(df, filters)
    segments = _segment_aggregate(rows.select(
        F.lit(dimension).alias("segment_dimension"), segment_value(rows, dimension).alias("segment_value"),
        optional(rows, "severity").alias("severity"), optional(rows, "score", "int").alias("score")))
    total = segments.agg(F.coalesce(F.sum("issue_count"), F.lit(0)).alias("total_reviews_considered"))
    leading = segments.orderBy(*segment_order()).limit(max(1, limit))
    return total.select(F.lit("total").alias("section"), "total_reviews_considered").unionByName(
        leading.withColumn("section", F.lit("segment")), allowMissingColumns=True)


def trend_report(df: DataFrame, bucket: str = "week", top_issue_limit: int = 3,
                 filters: ReviewFilters | None = None) -> DataFrame:
    """``time_trends`` with the number of dated reviews considered as its first row; see ``segment_report``."""
    trends = time_trends(df, bucket, top_issue_limit, filters)
    total = trends.agg(F.coalesce(F.sum("total_reviews"), F.lit(0)).alias("total_reviews_considered"))
    return total.select(F.lit("total").alias("section"), "total_reviews_considered").unionByName(
        trends.withColumn("section", F.lit("trend")), allowMissingColumns=True)


def bucket_issue_counts(df: DataFrame, bucket: str) -> DataFrame:
    """Counts per (time bucket, cluster); rows without a valid date drop out."""
    rows = df.select(
        *CLUSTER, optional(df, "severity").alias("severity"), optional(df, "sentiment").alias("sentiment"),
        time_bucket(review_time(df), bucket).alias("time_bucket"),
    ).where(F.col("time_bucket").isNotNull())
    return with_cluster(rows).groupBy("time_bucket", *CLUSTER).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sentiment") == "Negative").alias("negative"),
        F.count_if(F.col("severity") == "P0").alias("p0"),
        F.count_if(F.col("severity") == "P1").alias("p1"),
        F.count_if(F.col("severity") == "P2").alias("p2"),
    ).withColumn("issue_key", issue_key(*[F.col(c) for c in CLUSTER]))


def trend_top_keys(counts: DataFrame, limit: int = 3) -> DataFrame:
    """Leading issue keys per bucket with their rank."""
    order = W.partitionBy("time_bucket").orderBy(F.col("n").desc(), locale_key(F.col("issue_key")).asc())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, limit))


def time_trends(df: DataFrame, bucket: str = "week", top_issue_limit: int = 3,
                filters: ReviewFilters | None = None) -> DataFrame:
    """Volume, negative share, severities and leading issues per bucket.

    Both branches read the same small (bucket, cluster) aggregate. The ranked
    branch carries every measure along, so the plans are alike and share the
    aggregate's exchange.
    """
    counts = bucket_issue_counts(filter_reviews(df, filters), bucket)
    totals = counts.groupBy("time_bucket").agg(
        F.sum("n").alias("total_reviews"), F.sum("negative").alias("_negative"),
        F.sum("p0").alias("p0_count"), F.sum("p1").alias("p1_count"), F.sum("p2").alias("p2_count"),
    )
    leading = (
        trend_top_keys(counts, top_issue_limit).groupBy("time_bucket")
        .agg(F.array_sort(F.collect_list(
            F.struct("rank", "issue_key", "n", "negative", "p0", "p1", "p2"))).alias("_keys"))
    )
    joined = totals.join(leading, "time_bucket")
    return joined.select(
        "time_bucket", "total_reviews",
        round_to(ratio(F.col("_negative"), F.col("total_reviews")), 4).alias("negative_share"),
        "p0_count", "p1_count", "p2_count",
        (F.col("total_reviews") - F.col("p0_count") - F.col("p1_count") - F.col("p2_count")).alias("fyi_count"),
        F.col("_keys.issue_key").alias("top_issue_keys"),
    ).orderBy("time_bucket")


def severity_counts(df: DataFrame) -> DataFrame:
    """One row of counts; anything but P0, P1 and P2 counts as FYI."""
    severity = F.col("severity")
    return df.agg(
        F.count_if(severity == "P0").alias("p0_count"),
        F.count_if(severity == "P1").alias("p1_count"),
        F.count_if(severity == "P2").alias("p2_count"),
        F.count_if(~F.coalesce(severity.isin("P0", "P1", "P2"), F.lit(False))).alias("fyi_count"),
    )


def feature_heatmap(df: DataFrame) -> DataFrame:
    """Counts per area and issue type in long form."""
    return df.groupBy("feature_area", "issue_type").agg(F.count("*").alias("review_count"))


def feature_heatmap_wide(df: DataFrame, issue_types=(*ISSUE_TYPES, "Unknown")) -> DataFrame:
    """One column per issue type; the list is fixed, so no extra scan."""
    return (feature_heatmap(df).groupBy("feature_area")
            .pivot("issue_type", list(issue_types)).agg(F.first("review_count"))
            .na.fill(0))


def report_cube(df: DataFrame, bucket: str = "day") -> DataFrame:
    """Every measure of the weekly report per (bucket, cluster).

    Totals, clusters and bucket counts all follow from this small table, so a
    report scans and classifies its reviews once. Undated rows keep a null
    bucket.
    """
    rows = with_cluster(df.select(
        *CLUSTER, optional(df, "severity").alias("severity"), optional(df, "sentiment").alias("sentiment"),
        optional(df, "score", "int").alias("score"),
        time_bucket(review_time(df), bucket).alias("time_bucket"),
    ))
    return rows.groupBy("time_bucket", *CLUSTER).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sentiment") == "Negative").alias("negative"),
        F.count_if(F.col("severity") == "P0").alias("p0"),
        F.count_if(F.col("severity") == "P1").alias("p1"),
        F.count_if(F.col("severity") == "P2").alias("p2"),
        F.sum("score").alias("score_sum"), F.count("score").alias("score_n"),
    ).withColumn("issue_key", issue_key(*[F.col(c) for c in CLUSTER]))


def clusters_from_cube(cube: DataFrame) -> DataFrame:
    """The columns of ``issue_clusters`` from a report cube."""
    return cube.groupBy("issue_key", *CLUSTER).agg(
        F.sum("n").alias("review_count"),
        F.sum("p0").alias("p0_count"), F.sum("p1").alias("p1_count"), F.sum("p2").alias("p2_count"),
        F.sum(F.col("n") - F.col("p0") - F.col("p1") - F.col("p2")).alias("fyi_count"),
        round_to(F.sum("score_sum") / F.nullif(F.sum("score_n"), F.lit(0)), 2).alias("avg_rating"),
        F.coalesce(F.sum(F.when(F.col("time_bucket").isNotNull(), F.col("n"))), F.lit(0)).alias("dated_count"),
    )


def report_totals(cube: DataFrame) -> DataFrame:
    """Total reviews with their negative and critical shares, as one row."""
    sums = cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("_negative"),
        F.coalesce(F.sum(F.col("p0") + F.col("p1")), F.lit(0)).alias("_critical"),
    )
    return sums.select(
        "total_reviews",
        round_to(ratio(F.col("_negative"), F.col("total_reviews")), 4).alias("negative_share"),
        round_to(ratio(F.col("_critical"), F.col("total_reviews")), 4).alias("critical_share"),
    )
