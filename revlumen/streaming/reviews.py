"""Streaming ingest, classification, alerts, dedupe and trends.

The stateless part reuses the batch columns unchanged. State is bounded by
the watermark: rows later than it are dropped, as is state older than it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlumen.functions.rules import classify
from revlumen.operators.labels import analyzed_rows
from revlumen.operators.validity import normalize, to_raw_reviews, valid_rows, validate
from revlumen.plans.alerts import alert_rows
from revlumen.schema import require
from revlumen.session import ensure_checkpoint_dir

# Window length and offset per bucket. The epoch is a Thursday, so weeks that
# start on Monday are shifted by four days.
WINDOWS = {"day": ("1 day", "1 day", "0 days"), "week": ("7 days", "7 days", "4 days")}


def read_review_stream(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet",
                       files_per_trigger: int | None = None, **options) -> DataFrame:
    """Files that arrive in ``path``, with a given schema."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def valid_stream(raw: DataFrame) -> DataFrame:
    """Normalised valid rows of a raw stream, with ``review_ts``."""
    return to_raw_reviews(valid_rows(validate(normalize(raw))))


def alert_stream(reviews: DataFrame, include_raw_text: bool = False) -> DataFrame:
    """P0 and P1 alerts as they arrive. Stateless."""
    return alert_rows(classify(reviews), include_raw_text)


def analyzed_stream(reviews: DataFrame) -> DataFrame:
    """Analysed reviews as they arrive. Stateless."""
    return analyzed_rows(classify(reviews))


def first_per_id(reviews: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row per review id among rows within ``delay`` of each other."""
    return reviews.withWatermark("review_ts", delay).dropDuplicatesWithinWatermark(["review_id"])


def trend_stream(analyzed: DataFrame, bucket: str = "day", delay: str = "1 day") -> DataFrame:
    """Counts per day or Monday week; a bucket appears once it is closed."""
    require(bucket in WINDOWS, f"bucket must be one of {sorted(WINDOWS)}")
    length, slide, offset = WINDOWS[bucket]
    critical = F.coalesce(F.col("severity").isin("P0", "P1", "P2"), F.lit(False))
    counts = analyzed.withWatermark("review_ts", delay).groupBy(
        F.window("review_ts", length, slide, offset)).agg(
        F.count("*").alias("total_reviews"),
        F.count_if(F.col("sentiment") == "Negative").alias("negative_count"),
        F.count_if(F.col("severity") == "P0").alias("p0_count"),
        F.count_if(F.col("severity") == "P1").alias("p1_count"),
        F.count_if(F.col("severity") == "P2").alias("p2_count"),
        F.count_if(~critical).alias("fyi_count"),
    )
    return counts.select(F.to_date("window.start").cast("string").alias("time_bucket"), *counts.columns[1:])


def upsert_trends(analyzed: DataFrame, path: str, checkpoint: str, bucket: str = "day", delay: str = "1 day") -> None:
    """Keep a table of trends that holds open buckets too; runs over everything that is available, then stops.

    Every micro-batch writes the new totals of the buckets it changed into a
    folder of its own, named by the batch. A batch that is repeated after a
    failure replaces its folder, so nothing counts twice; the state of the
    stream adds what arrives in later batches or later runs.
    """
    def save(totals: DataFrame, batch: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (trend_stream(analyzed, bucket, delay).writeStream.foreachBatch(save)
             .option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()


def current_trends(spark: SparkSession, path: str) -> DataFrame:
    """The latest totals of every bucket of an ``upsert_trends`` table."""
    rows = spark.read.parquet(path)
    counts = [c for c in rows.columns if c not in ("time_bucket", "batch")]
    latest = rows.groupBy("time_bucket").agg(F.max_by(F.struct(*counts), "batch").alias("_now"))
    return latest.select("time_bucket", "_now.*")


def compact_trends(spark: SparkSession, path: str, target: str) -> None:
    """Write the latest totals as one small table that replaces the folders of many batches.

    The highest batch number stays, so the target can be read with
    ``current_trends`` and a stream may go on writing beside it.
    """
    rows = spark.read.parquet(path)
    counts = [c for c in rows.columns if c != "time_bucket"]
    latest = rows.groupBy("time_bucket").agg(F.max_by(F.struct(*counts), "batch").alias("_now"))
    latest.select("time_bucket", "_now.*").coalesce(1).write.partitionBy("batch").parquet(target)


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over everything that is available, then stop."""
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Result of a drained stream as a batch frame.

    Output and stream state go to the shared checkpoint folder.
    """
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = spark.range(1).select(F.uuid()).first()[0]
    path = f"{base}/streams/{name}-{run}"
    drain_to_parquet(stream, f"{path}/data", f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
