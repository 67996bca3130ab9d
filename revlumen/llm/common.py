"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.session import ensure_checkpoint_dir, prepare


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but columnar and compressed. The files
    stay until the folder is emptied, as checkpoint files do.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces_of(spark: SparkSession, pieces: int | None = None) -> int:
    """How many partitions an explicit layout takes: the argument, else the session's shuffle partitions."""
    return pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` alone would also fold other letters, so it serves where both agree."""
    folded = F.lower(text)
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text == folded, text).otherwise(slow)


def row_hash(*columns: str) -> Column:
    """64-bit content hash that tells apart rows of one id with different contents; null differs from empty."""
    parts = []
    for name in columns:
        parts += [F.col(name).isNull(), F.col(name)]
    return F.xxhash64(*parts)


def with_positions(df: DataFrame, order: list[str], amount: Column, name: str = "ordered",
                   pieces: int | None = None) -> tuple[DataFrame, int]:
    """Rows with ``position``: the sum of ``amount`` over all rows that sort before, and the grand total.

    No task sees more than its slice: rows are range-partitioned by ``order``, each slice is summed in its
    order, and the sums of the slices (a row each, one per partition) give the offsets. The slices are written
    before their numbers are used, so a lost executor cannot change them. Rows that tie in all of ``order``
    share a slice; end ``order`` with a hash of the row when many rows may tie otherwise.
    """
    spark = df.sparkSession
    laid = df.withColumn("_amount", amount.cast("bigint")).repartitionByRange(
        pieces_of(spark, pieces), *[F.col(c).asc_nulls_first() for c in order])
    sliced = staged(laid.withColumn("_slice", F.spark_partition_id()), name)
    totals = sliced.groupBy("_slice").agg(F.sum("_amount").alias("_total"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("_slice").alias("_in"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inner = W.partitionBy("_slice").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(
        W.unboundedPreceding, -1)
    # One small row per slice: a partition count bounds this side.
    placed = sliced.withColumn("_inner", F.coalesce(F.sum("_amount").over(inner), F.lit(0))).join(
        F.broadcast(offsets), F.col("_slice") == F.col("_in")).withColumn("position", F.col("_offset") + F.col("_inner"))
    grand = totals.agg(F.coalesce(F.sum("_total"), F.lit(0))).first()[0]
    return placed.drop("_slice", "_in", "_offset", "_inner", "_amount"), int(grand)
