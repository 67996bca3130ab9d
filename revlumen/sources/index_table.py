"""An index table of reviews that is loaded again and again.

Each load writes a folder of its own, ``load=<name>``, cut into buckets by the
hash of the key. A load is part of the table once Spark has committed it (its
``_SUCCESS`` file is there), so what a crashed load left is not read, and the
same load run again replaces its own folder. Rows whose key an earlier load
holds, and further rows of a key inside one load, are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlumen.schema import require

BUCKETS = 16
_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def committed_loads(spark: SparkSession, path: str) -> list[str]:
    """Names of the loads that ended well and added rows."""
    files, folder = _file_system(spark, path)
    if not files.exists(folder):
        return []
    loads = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("load="):
            inside = [child.getPath().getName() for child in files.listStatus(status.getPath())]
            # A load that found nothing new has no buckets.
            if "_SUCCESS" in inside and any(child.startswith("bucket=") for child in inside):
                loads.append(name.removeprefix("load="))
    return sorted(loads)


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def read_index(spark: SparkSession, path: str, without: str | None = None) -> DataFrame | None:
    """The rows of all committed loads, or None if there are none yet."""
    loads = [name for name in committed_loads(spark, path) if name != without]
    if not loads:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/load={name}" for name in loads])


def load_new(new: DataFrame, path: str, load: str, key: str = "review_id", order: str | None = None,
             buckets: int = BUCKETS) -> None:
    """Add the rows whose key the table does not hold, as the load of this name.

    Of several rows with one key the first by ``order`` stays (any one row
    without it, always the same for equal input). Rows without a key are left
    out. A load may be repeated: it then replaces what it wrote before.
    The existing table is read for its keys only, and rows meet them bucket by
    bucket.
    """
    require(_NAME.fullmatch(load) is not None, "a load is named by letters, digits, dots, dashes and underscores")
    spark = new.sparkSession
    columns = new.columns
    place = F.col(order) if order else F.xxhash64(*[F.col(c) for c in columns])
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), place).alias("_row"))
    rows = first.select("_row.*").withColumn("bucket", bucket_of(F.col(key), buckets))
    existing = read_index(spark, path, without=load)
    if existing is not None:
        rows = rows.join(existing.select("bucket", key).distinct(), ["bucket", key], "left_anti")
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/load={load}")
