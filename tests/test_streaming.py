from pyspark.sql import functions as F

from conftest import SMALL, rows
from revlumen.functions.rules import classify
from revlumen.operators.issues import time_trends
from revlumen.plans.alerts import alert_rows
from revlumen.plans.analyze import analyze
from revlumen.sources import event_reviews as source
from revlumen.streaming import reviews as streaming


def arrivals(spark, tmp_path, df, name):
    """Write ``df`` as three files in time order and read it back as a stream."""
    path = str(tmp_path / name)
    for part in range(3):
        df.where(F.floor(F.dayofmonth("review_ts") / 11) == part).coalesce(1).write.mode("append").parquet(path)
    return streaming.read_review_stream(spark, path, df.schema, files_per_trigger=1)


def reviews(spark):
    return source.reviews_from_events(source.read_events(spark, SMALL))


def test_alert_stream_equals_batch(spark, tmp_path):
    batch = reviews(spark)
    stream = arrivals(spark, tmp_path, batch, "alerts")
    got = streaming.drained(streaming.alert_stream(stream), "test-alerts")
    assert sorted(rows(got)) == sorted(rows(alert_rows(classify(batch))))


def test_trend_stream_equals_closed_batch_buckets(spark, tmp_path):
    batch = reviews(spark)
    for bucket, days in (("day", 1), ("week", 7)):
        stream = streaming.analyzed_stream(arrivals(spark, tmp_path, batch, bucket))
        got = streaming.drained(streaming.trend_stream(stream, bucket, "1 day"), f"test-{bucket}")
        last = analyze(batch).agg(F.max("review_ts")).first()[0]
        trends = time_trends(analyze(batch), bucket)
        closed = trends.where(F.date_add("time_bucket", days).cast("timestamp")
                              <= F.lit(last) - F.expr("interval 1 day"))
        columns = ("time_bucket", "total_reviews", "p0_count", "p1_count", "p2_count", "fyi_count")
        assert sorted(rows(got, *columns)) == sorted(rows(closed, *columns)) and got.count() > 0


def test_stream_dedupe(spark, tmp_path):
    batch = reviews(spark).withColumn("review_id", F.concat(F.lit("g"), F.floor(F.col("seq") / 3)))
    stream = arrivals(spark, tmp_path, batch, "dedupe").select("review_id", "review_ts")
    got = streaming.drained(streaming.first_per_id(stream, "60 days"), "test-dedupe")
    ids = [r["review_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) == batch.select("review_id").distinct().count()


def test_valid_stream(spark, tmp_path):
    raw = spark.createDataFrame(
        [("a", "text here", "5 stars", "2026-02-01"), ("b", "text here", "nine", "2026-02-01")],
        "review_id string, content string, score string, review_created_at string")
    raw.write.parquet(str(tmp_path / "raw"))
    stream = streaming.valid_stream(streaming.read_review_stream(spark, str(tmp_path / "raw"), raw.schema))
    got = streaming.drained(stream, "test-valid")
    assert rows(got, "review_id", "score") == [("a", 5)] and "review_ts" in got.columns


def test_upserted_trends_hold_open_buckets(spark, tmp_path):
    batch = reviews(spark)
    for bucket in ("day", "week"):
        path = str(tmp_path / f"all-{bucket}")
        stream = streaming.analyzed_stream(arrivals(spark, tmp_path, batch, f"all-in-{bucket}"))
        streaming.upsert_trends(stream, f"{path}/data", f"{path}/state", bucket)
        trends = time_trends(analyze(batch), bucket)
        columns = ("time_bucket", "total_reviews", "p0_count", "p1_count", "p2_count", "fyi_count")
        expected = sorted(rows(trends, *columns))
        assert sorted(rows(streaming.current_trends(spark, f"{path}/data"), *columns)) == expected
        streaming.compact_trends(spark, f"{path}/data", f"{path}/compact")
        assert sorted(rows(streaming.current_trends(spark, f"{path}/compact"), *columns)) == expected


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The last batch runs again when its commit is lost, and later arrivals add to what is there."""
    path, batch = str(tmp_path / "again"), reviews(spark)
    stream = streaming.analyzed_stream(arrivals(spark, tmp_path, batch, "again-in"))
    streaming.upsert_trends(stream, f"{path}/data", f"{path}/state", "day")
    before = sorted(rows(streaming.current_trends(spark, f"{path}/data")))
    commits = sorted((f for f in (tmp_path / "again" / "state" / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)
    again = streaming.analyzed_stream(streaming.read_review_stream(spark, str(tmp_path / "again-in"), batch.schema, files_per_trigger=1))
    streaming.upsert_trends(again, f"{path}/data", f"{path}/state", "day")
    assert sorted(rows(streaming.current_trends(spark, f"{path}/data"))) == before
