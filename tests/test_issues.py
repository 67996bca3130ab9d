from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import SIX, analytics_frame, rows
from revlumen.functions.timeutil import parse_instant, parse_ts, time_bucket, window_range, window_start
from revlumen.operators import change, issues, priority
from revlumen.operators.filters import ReviewFilters, filter_reviews, window_filters
from revlumen.plans import drilldown, weekly
from revlumen.operators.themes import theme_list, top_themes


def ids(df):
    return sorted(r["review_id"] for r in df.collect())


def test_filter_dates_and_severities(six):
    chosen = ReviewFilters(start_date="2026-02-08", end_date="2026-02-11T23:59:59Z", severities=["P1", "P2", "FYI"])
    assert ids(filter_reviews(six, chosen)) == ["r3", "r4", "r5", "r6"]


def test_filter_end_day_is_midnight_unless_asked(six):
    assert ids(filter_reviews(six, ReviewFilters(end_date="2026-02-02"))) == ["r1"]
    assert ids(filter_reviews(six, ReviewFilters(end_date="2026-02-02", end_inclusive_day=True))) == ["r1", "r2"]


def test_filter_bad_bound_still_needs_a_date(spark):
    df = analytics_frame(spark, [SIX[0], ("x", "Bug", "SOS", None, None, 1, None, "no date"),
                                 ("y", "Bug", "SOS", None, None, 1, None, None)])
    assert ids(filter_reviews(df, ReviewFilters(start_date="soon"))) == ["r1"]
    assert ids(filter_reviews(df, ReviewFilters(severities=["P1"]))) == ["r1"]
    assert ids(filter_reviews(df, None)) == ["r1", "x", "y"]
    assert ids(filter_reviews(df, ReviewFilters(severities=["", "P0"]))) == ["x", "y"]


def test_top_issues(six):
    got = issues.top_issues(six, limit=2).collect()
    first = got[0]
    assert len(got) == 2 and first["total_reviews_considered"] == 6
    assert first["issue_key"] == "Bug::Login/OTP" and first["review_count"] == 3
    assert first["severity_breakdown"].asDict() == {"P0": 1, "P1": 2, "P2": 0, "FYI": 0}
    assert first["avg_rating"] == 1.33 and first["affected_share"] == 0.5
    assert first["example_review_ids"] == ["r1", "r2", "r5"]


def test_top_issues_blanks_ties_and_examples(spark):
    df = analytics_frame(spark, [
        ("a", "UX", "SOS", "weird", None, None, None, None), ("b", "", None, None, None, 5, None, None),
        ("", "Unknown", "Unknown", None, None, 4, None, None), ("c", "UX", "Savings/Investing", None, None, None, None, None),
        ("d", "", "", None, None, None, None, None), ("e", None, "", None, None, None, None, None),
        ("f", None, "", None, None, None, None, None)])
    got = issues.top_issues(df).collect()
    assert [g["issue_key"] for g in got] == ["Unknown::Unknown", "UX::Savings/Investing", "UX::SOS"]
    assert got[0]["example_review_ids"] == ["b", "d", "e"] and got[0]["avg_rating"] == 4.5
    assert got[2]["fyi_count"] == 1 and got[2]["avg_rating"] is None


def test_top_issues_empty(spark):
    assert issues.top_issues(analytics_frame(spark, [])).collect() == []


def test_segments(six):
    first = issues.segment_breakdown(six, "app_version").first()
    assert (first["segment_value"], first["issue_count"], first["p0_p1_count"]) == ("1.0.0", 2, 2)
    buckets = {r["segment_value"]: r["issue_count"] for r in issues.segment_breakdown(six, "rating_bucket").collect()}
    assert buckets == {"1-2": 3, "3": 1, "4-5": 2}
    unknown = issues.segment_breakdown(six, "device").collect()
    assert [(r["segment_value"], r["issue_count"]) for r in unknown] == [("unknown", 6)]
    with pytest.raises(ValueError):
        issues.segment_breakdown(six, "colour")


def test_segment_counts_sum_to_total(six):
    total = issues.segment_breakdowns(six, limit=100).groupBy("segment_dimension").agg(F.sum("issue_count").alias("n"))
    assert {r["n"] for r in total.collect()} == {6} and total.count() == 6


def test_day_trend(six):
    got = issues.time_trends(six, "day", 2).collect()
    assert got[0]["time_bucket"] == "2026-02-01" and got[0]["negative_share"] == 1.0 and len(got) == 6


def test_week_trend(six):
    chosen = ReviewFilters(start_date="2026-02-08", sentiments=["Mixed", "Neutral", "Negative"])
    got = issues.time_trends(six, "week", filters=chosen).collect()
    assert [(g["time_bucket"], g["p1_count"], g["p2_count"]) for g in got] == [
        ("2026-02-02", 0, 1), ("2026-02-09", 1, 0)]
    assert sum(g["total_reviews"] for g in got) == 3


def test_trend_top_keys_ties_in_locale_order(spark):
    day = "2026-02-01T00:00:00Z"
    df = analytics_frame(spark, [(str(i), "Bug", area, None, None, 1, None, day)
                                 for i, area in enumerate(["SOS", "Savings/Investing", "Unknown", "SOS"])])
    got = issues.time_trends(df, "day", 3).first()["top_issue_keys"]
    assert got == ["Bug::SOS", "Bug::Savings/Investing", "Bug::Unknown"]


@pytest.mark.parametrize("window, start", [
    ("this_week", "2026-02-16"), ("last_7_days", "2026-02-16"), ("last_30_days", "2026-01-24"),
    ("last_90_days", "2025-11-25"), ("last_180_days", "2025-08-27"), ("last_12_months", "2025-02-23")])
def test_windows(spark, window, start):
    span = window_range(window, "2026-02-22T00:00:00Z")
    assert (span.start_date, span.end_date) == (start, "2026-02-22")
    column = spark.sql("select date'2026-02-22' as d").select(window_start(window, F.col("d")))
    assert rows(column) == [(start,)]


def test_explicit_range_beats_window():
    given = ReviewFilters(start_date="2026-02-01", end_date="2026-02-28")
    assert window_filters("last_180_days", "2026-02-22", given) == given
    assert window_filters(None, "2026-02-22", None) is None
    with pytest.raises(ValueError):
        window_filters("fortnight", "2026-02-22")
    with pytest.raises(ValueError):
        window_filters("this_week", "not a date")


def test_default_scope_is_this_week(six):
    got = drilldown.scoped_top_issues(six, "2026-02-11T23:00:00Z")
    assert rows(got, "window_applied", "start_date", "end_date", "total_reviews_considered")[0] == (
        "this_week", "2026-02-09", "2026-02-11", 2)
    dated = drilldown.scoped_top_issues(six, "2026-02-11", filters=ReviewFilters(start_date="2026-02-02"))
    assert rows(dated, "window_applied", "start_date", "end_date")[0] == (None, "2026-02-02", None)
    wide = drilldown.scoped_top_issues(six, "2026-02-12", window="last_30_days")
    assert rows(wide, "total_reviews_considered")[0] == (6,)


def test_other_date_spellings(spark):
    texts = ["2026/2/8", "2/8/2026", "Feb 8, 2026", "February 8, 2026", "Sun, 8 Feb 2026 00:00:00 GMT", "8th of May"]
    df = spark.createDataFrame([(t,) for t in texts], "d string").select(parse_ts(F.col("d")).cast("string"))
    assert [r[0] for r in rows(df)] == ["2026-02-08 00:00:00"] * 5 + [None]
    assert [parse_instant(t) for t in texts] == [datetime(2026, 2, 8, tzinfo=timezone.utc)] * 5 + [None]


def test_blank_segments(spark, six):
    df = six.withColumn("device", F.when(F.col("seq") < 2, "\t ").when(F.col("seq") < 3, " Pixel "))
    got = rows(issues.segment_breakdown(df, "device"), "segment_value", "issue_count")
    assert got == [("unknown", 5), (" Pixel ", 1)]


def test_lenient_dates_and_buckets(spark):
    df = spark.createDataFrame([("2026-02-08T23:30:00-02:00",), ("2026-02-08",), ("junk",), ("",), (None,)], "d string")
    got = rows(df.select(time_bucket(parse_ts(F.col("d")), "day"), time_bucket(parse_ts(F.col("d")), "week")))
    assert got == [("2026-02-09", "2026-02-09"), ("2026-02-08", "2026-02-02"), (None, None), (None, None), (None, None)]


def spike_rows(spark, counts):
    data, i = [], 0
    for (key, day), n in counts.items():
        for _ in range(n):
            data.append((f"r{i}", "Bug", key, "P1", "Negative", 1, None, f"2026-02-0{day}T10:00:00Z"))
            i += 1
    return analytics_frame(spark, data)


def test_spike(spark):
    df = spike_rows(spark, {("Login/OTP", 1): 1, ("Login/OTP", 2): 1, ("Login/OTP", 3): 3})
    assert rows(change.spikes(df)) == [("Bug::Login/OTP", "2026-02-03", 1.0, 3.0, 3.0, True)]


def test_spike_new_issue_first_and_no_gap_fill(spark):
    df = spike_rows(spark, {("A", 1): 2, ("A", 5): 8, ("New", 5): 1, ("B", 1): 4, ("B", 5): 4})
    got = rows(change.spikes(df), "issue_key", "baseline_rate", "spike_score")
    assert got == [("Bug::New", 0.0, None), ("Bug::A", 2.0, 4.0)]
    assert rows(change.spikes(df, min_baseline_count=2), "issue_key") == [("Bug::A",)]


def test_spike_needs_two_buckets(spark):
    assert rows(change.spikes(spike_rows(spark, {("A", 1): 5}))) == []
    assert rows(change.spikes(spike_rows(spark, {("A", 2): 1, ("A", 6): 5}), "week")) == []
    with pytest.raises(ValueError):
        change.spikes(spike_rows(spark, {("A", 1): 5}), spike_ratio_threshold=0.5)


def test_compare(six, spark):
    baseline, current = six.where("review_id in ('r1','r3')"), six.where("review_id in ('r2','r4','r5')")
    metrics = {r["metric"]: r for r in change.compare_metrics(baseline, current).collect()}
    assert metrics["total_reviews"]["delta"] == 1.0 and metrics["total_reviews"]["is_regression"]
    assert metrics["total_reviews"]["delta_pct"] == 0.5
    deltas = change.compare_issues(baseline, current)
    assert rows(change.top_regressions(deltas), "issue_key", "baseline", "current", "delta", "delta_pct") == [
        ("Bug::Login/OTP", 1, 2, 1, 1.0), ("Feature Request::Onboarding", 0, 1, 1, None)]
    assert rows(change.top_improvements(deltas), "issue_key", "delta") == [("Performance::Notifications", -1)]


def test_compare_with_empty_baseline(six):
    metrics = change.compare_metrics(six.limit(0), six).collect()
    assert [m["delta_pct"] for m in metrics] == [None, None, None]
    assert metrics[0]["baseline"] == 0.0


def test_priority(six):
    got = priority.priority_scores(six).collect()
    top = got[0]
    # 100 * (.4 * 3/6 + .3 * 1 + .2 * 0 + .1 * (5 - 1.33) / 4)
    assert (top["issue_key"], top["impact_score"]) == ("Bug::Login/OTP", 59.18)
    assert top["rating_drag"] == 0.9175 and top["trend_velocity"] == 0.0


def test_half_split_trend(spark):
    got = spark.range(0, 9).select(priority.half_split_trend(F.col("id")))
    assert [r[0] for r in rows(got)] == [0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0, 1 / 3, 0.0]


def test_ownership_first_rule_wins(spark, six):
    rules = priority.ownership_rules(spark, [
        ("Login/OTP", "UX", "Other", "zed"), ("Login/OTP", "", "Wide", "ann"), ("Login/OTP", "Bug", "Exact", "bob"),
        ("Card Controls", "Praise", "Cards", "cy"), ("Card Controls", None, "AllCards", "di")])
    got = rows(priority.ownership_map(six, rules), "issue_key", "squad", "is_unmapped")
    assert got[0] == ("Bug::Login/OTP", "Wide", False)
    assert ("Praise::Card Controls", "Cards", False) in got
    assert ("Performance::Notifications", None, True) in got
    mapped = priority.ownership_map(six, rules, include_unmapped=False)
    assert mapped.count() == 2


def test_cluster_caps_are_optional(six):
    assert priority.priority_scores(six, max_clusters=1).count() == 1
    assert priority.priority_scores(six, top_n=50).count() == 4


def test_weekly_report(spark, six):
    rules = priority.ownership_rules(spark, [("Login/OTP", None, "Identity", "alex")])
    report = weekly.weekly_report(six, rules)
    assert rows(report.summary) == [(6, 0.5, 0.5)]
    assert rows(report.top_issues, "issue_key", "example_review_ids")[0] == ("Bug::Login/OTP", ["r1", "r2", "r5"])
    assert rows(report.priority_rankings, "issue_key", "impact_score") == rows(
        priority.priority_scores(six, top_n=5), "issue_key", "impact_score")
    assert rows(report.ownership_assignments, "squad") == [("Identity",)]
    assert rows(report.spike_alerts) == rows(change.spikes(six, top_n=5))
    sections = {r["section"] for r in weekly.weekly_report_rows(report).collect()}
    assert sections >= {"summary", "top_issues", "priority_rankings", "ownership_assignments"}


def test_weekly_report_without_rules(six):
    report = weekly.weekly_report(six)
    assert report.ownership_assignments is None
    assert "ownership_assignments" not in {r["section"] for r in weekly.weekly_report_rows(report).collect()}


def test_clusters_from_cube_equal_direct_clusters(six):
    columns = ("issue_key", "review_count", "p0_count", "p1_count", "p2_count", "fyi_count", "avg_rating", "dated_count")
    direct = rows(issues.issue_clusters(six), *columns)
    assert sorted(direct) == sorted(rows(issues.clusters_from_cube(issues.report_cube(six)), *columns))


def test_drill_down(spark):
    df = analytics_frame(spark, [
        ("r1", "Unknown", "Login/OTP", "P1", None, 1, None, "2026-02-20T10:00:00Z"),
        ("r2", "Bug", "Unknown", "P1", None, 1, None, "2026-02-10T10:00:00Z"),
        ("r3", "Bug", "Login/OTP", "P1", None, 1, None, "2026-02-21T10:00:00Z")])
    args = dict(include_unknown_only=True, window="last_30_days", reference_date="2026-02-22T00:00:00Z")
    assert rows(drilldown.cluster_reviews(df, **args), "review_id") == [("r1",), ("r2",)]
    assert rows(drilldown.cluster_counts(df, **args)) == [(3, 2, 2, "2026-01-24", "2026-02-22")]
    assert rows(drilldown.cluster_reviews(df, issue_type=" bug ", feature_area="LOGIN/otp"), "review_id") == [("r3",)]
    with pytest.raises(ValueError):
        drilldown.cluster_reviews(df, max_results=501)


def test_severity_counts_and_heatmap(spark):
    df = analytics_frame(spark, [(str(i), "Bug", "SOS", s, None, 1, None, None)
                                 for i, s in enumerate(["P0", "P0", "P1", "P2", "FYI", None])])
    assert rows(issues.severity_counts(df)) == [(2, 1, 1, 2)]
    wide = issues.feature_heatmap_wide(df, ["Bug", "UX"])
    assert rows(wide, "feature_area", "Bug", "UX") == [("SOS", 6, 0)]


def test_themes(spark):
    df = spark.createDataFrame([("The app is slow. The app is slow!",), ("the APP crashed",), ("x",), ("",)], "text string")
    assert rows(top_themes(df, limit=2)) == [("the app", 2), ("app crashed", 1)]
    assert theme_list(df).first()["top_themes"] == ["the app", "app crashed", "app is"]
    empty = spark.createDataFrame([], "text string")
    assert theme_list(empty).first()["top_themes"] == ["No themes found", "Not enough data", "Unknown"]


def test_running_mean_rounded_per_step_agrees_on_small_sets(six):
    """The order-dependent fold some reports use equals the plain mean here."""
    folded = six.groupBy("issue_type").agg(F.aggregate(
        F.array_sort(F.collect_list(F.struct("seq", "score"))),
        F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.round((acc["mean"] * acc["n"] + x["score"]) / (acc["n"] + 1), 2).alias("mean"),
                                (acc["n"] + 1).alias("n")))["mean"].alias("mean"))
    plain = six.groupBy("issue_type").agg(issues.average_rating(F.col("score")).alias("mean"))
    assert sorted(rows(folded)) == sorted(rows(plain))


def test_reports_count_what_they_consider(six):
    got = rows(issues.segment_report(six, "app_version", limit=1), "section", "total_reviews_considered", "segment_value", "issue_count")
    assert got[0] == ("total", 6, None, None) and got[1:] == [("segment", None, "1.0.0", 2)]
    none = ReviewFilters(severities=["P0"], sentiments=["Positive"])
    assert rows(issues.segment_report(six, "app_version", filters=none), "section", "total_reviews_considered") == [("total", 0)]
    trends = rows(issues.trend_report(six, "week"), "section", "total_reviews_considered", "total_reviews")
    assert trends[0] == ("total", 6, None) and sum(t[2] for t in trends[1:]) == 6
    assert rows(issues.trend_report(six, "day", filters=none), "section", "total_reviews_considered") == [("total", 0)]
