"""Running totals and bounded look-back over ordered rows, without hot tasks.

A window partitioned by a key sorts all rows of that key in one task. Here
rows are range-partitioned by (key, order) instead, so a hot key spreads over
many slices; each slice adds what the slices before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.session import checkpointed

BLOCK_ROWS = 8192


def ordered_slices(df: DataFrame, keys, order, slices: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and number the partitions.

    The slice number depends on sampled bounds, so the numbered rows are
    checkpointed: a lost executor cannot change them between two uses.
    ``order`` must be unique within a key.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(count, *[F.col(k) for k in keys], *order)
    return checkpointed(keyed.withColumn("_slice", F.spark_partition_id()))


def running_total(df: DataFrame, keys, order, value: Column, name: str, slices: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one."""
    sliced = ordered_slices(df.withColumn("_value", value), keys, order, slices)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_total"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_in"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = F.col("_slice") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inner = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = sliced.join(offsets, same, "left").withColumn(
        name, F.col("_offset") + F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return summed.select(*df.columns, name)


def with_lookback_blocks(df: DataFrame, position: str, reach: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut each key's rows into blocks that overlap by ``reach`` rows.

    Adds ``_block`` and ``_halo``. A window over (key, ``_block``) then sees
    the ``reach`` rows before every row with ``_halo`` false; blocks hold at
    most ``block_rows + reach`` rows.
    """
    own = F.floor(F.col(position) / block_rows)
    in_tail = F.col(position) % block_rows >= block_rows - reach
    targets = F.when(in_tail, F.array(F.struct(own.alias("_block"), F.lit(False).alias("_halo")),
                                      F.struct((own + 1).alias("_block"), F.lit(True).alias("_halo"))))
    targets = targets.otherwise(F.array(F.struct(own.alias("_block"), F.lit(False).alias("_halo"))))
    return df.select("*", F.inline(targets))
