"""Exact nearest neighbours over a table of vectors.

The vectors stay where they are: every task measures its own rows against a
block of queries and keeps the best k per query, so neither pairs nor vectors
are shuffled, only k candidates per query and task. Queries come in blocks of
bounded size, each with its own pass over the vectors, so any number of them
may be asked. Pivots let a task leave out cells of rows that are too far away.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revlumen.functions.vectors import Leaders, distances_to, id_values, matrix_of, unit
from revlumen.operators.running import running_total
from revlumen.schema import require
from revlumen.session import ensure_checkpoint_dir

METRICS = ("cosine", "l2")
# Entries of a block of queries, and of its k best per task.
QUERY_ENTRIES = 1 << 21
PIVOTS = 64
# Spark cuts "first k per key" before the shuffle up to this k.
WINDOW_CUT = 1000


def _blocks(asks: DataFrame, size: int) -> Iterator[list]:
    """The queries in lists of at most ``size``; the driver holds one at a time."""
    block = []
    for row in asks.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _candidates(rows: DataFrame, block: list, pivots: np.ndarray, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """The best k of every task for a block of queries."""
    matrix = np.array([row["vector"] for row in block], dtype=np.float64)
    payload = rows.sparkSession.sparkContext.broadcast(([row["query_id"] for row in block], matrix, pivots))
    arrow_schema = to_arrow_schema(schema)

    def score(batches):
        names, queries, pivots = payload.value
        leaders = Leaders(queries, k, metric, pivots)
        for batch in batches:
            values, kept = matrix_of(batch.column(1), queries.shape[1])
            leaders.add(id_values(batch.column(0).take(pa.array(kept))), values)
        query, ids, distance = leaders.rows()
        for start in range(0, len(query), 65536):
            part = slice(start, start + 65536)
            columns = ([names[q] for q in query[part]], ids[part].tolist(), distance[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return rows.mapInArrow(score, schema)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The first k per query by (distance, id), ranked from 0.

    Up to ``WINDOW_CUT`` in two steps, so that no task meets the candidates of
    all tasks at once; beyond it the rows are numbered along a range layout,
    so that a query's rows spread over many tasks.
    """
    if k > WINDOW_CUT:
        order = [F.col("distance"), F.col("id")]
        numbered = running_total(candidates, ["query_id"], order, F.lit(1).cast("bigint"), "relevance_rank")
        return numbered.where(F.col("relevance_rank") < k).withColumn("relevance_rank", F.col("relevance_rank").cast("int"))
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = candidates.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    merged = _leading(grouped, ["query_id", "_part"], k).drop("_rn", "_part")
    return _leading(merged, ["query_id"], k).withColumn("relevance_rank", F.col("_rn") - 1).drop("_rn")


def _leading(df: DataFrame, keys, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("distance", "id"))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_column: str = "id",
            vector_column: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding",
            query_entries: int = QUERY_ENTRIES) -> DataFrame:
    """The k nearest rows per query: ``query_id, id, distance, relevance_rank``.

    Exact; ties go to the smaller id. Rows without an id, and rows whose
    vector is no valid embedding of the query's length, are skipped.
    ``relevance_rank`` starts at 0.
    """
    require(k >= 1, "k must be at least 1")
    require(metric in METRICS, f"metric must be one of {METRICS}")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).where(F.col("id").isNotNull())
    asks = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    schema = T.StructType([T.StructField("query_id", asks.schema["query_id"].dataType),
                           T.StructField("id", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    size = F.coalesce(F.size("vector"), F.lit(-1))
    lengths = asks.agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).first()
    if not lengths["n"]:
        return _ranked(spark.createDataFrame([], schema), k)
    dimensions = lengths["low"]
    require(dimensions == lengths["high"] > 0, "query vectors must have one common length")
    whole = (F.size("vector") == dimensions) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = rows.where(whole).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vector").collect()
    pivots = np.array([row["vector"] for row in chosen], dtype=np.float64).reshape(-1, dimensions)
    per_block = max(1, query_entries // max(k, dimensions))
    if lengths["n"] <= per_block:
        return _ranked(_candidates(rows, asks.collect(), pivots, k, metric, schema), k)
    # A block's answer is complete, so it is written before the next block is read.
    path = f"{ensure_checkpoint_dir(spark)}/nearest-{uuid.uuid4().hex}"
    for block in _blocks(asks, per_block):
        _ranked(_candidates(rows, block, pivots, k, metric, schema), k).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def with_distance(rows: DataFrame, vector, metric: str = "cosine", vector_column: str = "embedding") -> DataFrame:
    """``rows`` without their vectors, plus ``distance`` to one vector; rows without a valid embedding are skipped."""
    require(metric in METRICS, f"metric must be one of {METRICS}")
    query = np.array([list(vector)], dtype=np.float64)
    asked = unit(query) if metric == "cosine" else query
    kept = [c for c in rows.columns if c != vector_column]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("distance", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def measure(batches):
        for batch in batches:
            values, valid = matrix_of(batch.column(0), asked.shape[1])
            values = unit(values) if metric == "cosine" else values
            own = [c.take(pa.array(valid)) for c in batch.columns[1:]]
            distance = pa.array(distances_to(values, np.broadcast_to(asked, values.shape), metric))
            yield pa.RecordBatch.from_arrays([*own, distance], schema=arrow_schema)

    return rows.select(vector_column, *kept).mapInArrow(measure, schema)
