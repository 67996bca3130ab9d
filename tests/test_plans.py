"""Shape of the plans: what is scanned, shuffled and pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from revlumen.catalog.queries import QUERIES
from revlumen.catalog.sql import ORACLE_SQL
from revlumen.operators.filters import ReviewFilters, filter_reviews
from revlumen.operators.issues import top_issues


def executed(df) -> str:
    """Final plan of the query, subqueries included, without initial plans."""
    df.collect()
    text = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.sub(r"\+- == Initial Plan ==.*?(?=\n\n\n|\n===== |\Z)", "", text, flags=re.S)


def count(plan: str, operator: str) -> int:
    return len(re.findall(rf"(?:^|\n)[\s:+\-*]*{operator}\b[^\n]*\(\d+\)", plan))


@pytest.mark.parametrize("name, scans", [
    ("time_trends_day", 1), ("spikes_day", 1), ("priority_scores", 1), ("ownership_map", 1), ("top_issues", 2),
    ("segment_all", 1), ("compare_issues", 2), ("import_diagnostics", 1), ("analyze_metadata", 2),
    ("cluster_counts", 1), ("export_markdown", 2), ("critical_alerts", 1)])
def test_scans(spark, name, scans):
    plan = executed(QUERIES[name](spark, SMALL))
    assert count(plan, "Scan parquet") == scans
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["classify", "redact_pii", "spam_filter", "routing", "analyze", "alert_rows",
                                  "export_tickets", "normalize", "validate", "store_payload", "filter_reviews"])
def test_row_operators_do_not_shuffle(spark, name):
    plan = executed(QUERIES[name](spark, SMALL))
    assert count(plan, "Exchange") == 0 and "Python" not in plan


@pytest.mark.parametrize("name", ["severity_counts", "feature_heatmap", "token_cost", "failure_class", "segment_device"])
def test_simple_aggregates_shuffle_once(spark, name):
    assert count(executed(QUERIES[name](spark, SMALL)), "Exchange") == 1


def test_examples_are_limited_before_the_shuffle(spark):
    assert count(executed(QUERIES["top_issues"](spark, SMALL)), "WindowGroupLimit") == 2


def test_date_filter_and_columns_reach_the_scan(spark, tmp_path):
    """Analytics over a stored classified table read few columns and prune by date."""
    from revlumen.plans.analyze import analyze
    from revlumen.sources import event_reviews as source
    path = str(tmp_path / "analyzed")
    analyze(source.reviews_from_events(source.read_events(spark, SMALL))).write.parquet(path)
    chosen = ReviewFilters(start_date="2024-01-08", end_date="2024-01-20", severities=["P0"])
    plan = executed(top_issues(filter_reviews(spark.read.parquet(path), chosen)))
    assert "GreaterThanOrEqual(review_ts,2024-01-08" in plan and "severity,P0" in plan
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert schemas and all("text:" not in s and "signals" not in s for s in schemas)


def test_day_folders_are_pruned(spark, tmp_path):
    from revlumen.plans.analyze import analyze, write_analyzed
    from revlumen.sources import event_reviews as source
    base = analyze(source.reviews_from_events(source.read_events(spark, SMALL)))
    write_analyzed(base, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    chosen = ReviewFilters(start_date="2024-01-08", end_date="2024-01-09T12:00:00Z")
    kept = filter_reviews(stored, chosen)
    plan = executed(kept)
    assert "(review_day" in re.search(r"PartitionFilters: \[([^\n]*)\]", plan).group(1)
    assert sorted(r["review_id"] for r in kept.collect()) == sorted(
        r["review_id"] for r in filter_reviews(base, chosen).collect())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_label_tables_do_not_multiply_rows(spark):
    """A label table with many copies of one id still yields one row per review."""
    from revlumen.functions.rules import classify
    from revlumen.operators.labels import merge_labels
    reviews = spark.range(50).select(F.col("id").cast("string").alias("review_id"),
                                     F.lit("the bug is here again").alias("content"), F.lit(1).alias("score"))
    labels = spark.range(3000).select(F.lit("7").alias("review_id"), F.lit('{"severity":"P2"}').alias("raw_response"))
    assert merge_labels(classify(reviews), labels).count() == 50
