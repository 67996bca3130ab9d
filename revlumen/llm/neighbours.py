"""Nearest neighbours by randomly rotated one-bit codes.

A vector is rotated at random into more dimensions and stored as the signs of its coordinates, its norm, and a
scalar that corrects the inner product of the signs with the rotated query: norm divided by the inner product of
signs and unit vector. The estimate is unbiased, and its error is bounded with high probability by a multiple of
the norm that the code itself gives. A row goes to the exact ranking only if its upper bound reaches the k-th
largest lower bound of its query, so the original vectors of few rows are looked at.

Queries come in blocks of bounded bytes; each block is shipped to all tasks, which pass over the index in place.
Only k rows per query and task are shuffled, and they are merged in two steps, so that no task meets the rows of
all tasks for a query.

Nearness is the inner product in double precision of the original vectors; ties go to the smaller id. Vectors
that are null, zero, hold a null or non-finite component, or differ in length from the commonest length take no
part; of any other size they do, as long as their inner products stay within the range of doubles. Repeated rows
are candidates each on their own, and a query skips rows of its own id. A row without an id is a candidate too: it
comes out with a null id, last among ties, and asks nothing. Queries with no candidates give no rows, an empty
table gives none, and columns other than the two named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import staged

NEAREST = 20
CODE_BITS = 256
SEED = 11
# Standard deviations of the estimate that the bounds allow for.
CERTAINTY = 3.0
QUERY_BLOCK_BYTES = 16 << 20
ROW_BLOCK, QUERY_STEP = 8192, 256


def rotation(dimensions: int, bits: int = CODE_BITS, seed: int = SEED) -> np.ndarray:
    """bits x dimensions with orthonormal columns, uniformly random."""
    gauss = np.random.default_rng(seed).standard_normal((max(bits, dimensions), dimensions))
    q, r = np.linalg.qr(gauss)
    return (q * np.sign(np.diag(r))).astype(np.float64)


def matrix_of(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Double matrix of the usable vectors and their places in the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    kept = np.flatnonzero(lengths == dimensions)
    flat = column.take(pa.array(kept)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(len(kept), dimensions)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return values[good], kept[good]


def encode(values: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, the correction that turns signs times query into an estimate, and the spread of the error.

    For a unit query the error is about normal with a deviation of ``spread``.
    """
    largest = np.abs(values).max(axis=1)
    norms = np.linalg.norm(values / largest[:, None], axis=1) * largest
    turned = (values / largest[:, None]) @ turn.T
    signs = turned >= 0
    bits = turn.shape[0]
    fit = np.abs(turned).sum(axis=1) / math.sqrt(bits) * largest / norms
    fit = np.clip(fit, 1e-6, 1.0)
    return np.packbits(signs, axis=1), norms / (fit * math.sqrt(bits)), norms * np.sqrt((1 - fit ** 2) / fit ** 2 / (bits - 1))


def build_index(vectors: DataFrame, dimensions: int, bits: int = CODE_BITS, seed: int = SEED) -> DataFrame:
    """``vec_id, embedding, code, correction, spread`` of every usable row of ``vec_id, embedding``."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def code(batches):
        turn = rotation(dimensions, bits, seed)
        for batch in batches:
            values, kept = matrix_of(batch.column("embedding"), dimensions)
            packed, correction, spread = encode(values, turn)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(kept)),
                pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), dimensions).cast(pa.list_(pa.float64())),
                pa.array([bytes(p) for p in packed], pa.binary()), pa.array(correction), pa.array(spread)],
                names=["vec_id", "embedding", "code", "correction", "spread"])

    return vectors.select("vec_id", "embedding").mapInArrow(
        code, f"vec_id {id_type}, embedding array<double>, code binary, correction double, spread double")


class _Best:
    """The k best exact scores per query so far, over row blocks."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        largest = np.abs(queries).max(axis=1)
        self.norms = np.linalg.norm(queries / largest[:, None], axis=1) * largest
        # Of unit queries, so that sizes of vectors stay out of the short floats.
        self.turned = (queries / self.norms[:, None] @ turn.T).astype(np.float32)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)
        self.unnamed = np.zeros((len(ids), k), bool)

    def add(self, ids, unnamed, values, codes, correction, spread) -> None:
        """``unnamed`` marks rows without an id, whatever ``ids`` holds there."""
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        for first in range(0, len(self.ids), QUERY_STEP):
            some = slice(first, first + QUERY_STEP)
            estimate = (self.turned[some] @ signs.T) * correction
            slack = CERTAINTY * spread + 1e-5 * np.abs(estimate)
            lower = estimate - slack
            # k + 1: the query's own row may be among them.
            if lower.shape[1] > self.k + 1:
                bar = -np.partition(-lower, self.k, axis=1)[:, self.k]
            else:
                bar = np.full(len(lower), -np.inf)
            last = self.scores[some, -1] / self.norms[some]
            bar = np.maximum(bar, last - 1e-5 * np.abs(last), out=bar, where=np.isfinite(last))
            wanted = estimate + slack >= bar[:, None]
            for q in np.flatnonzero(wanted.any(axis=1)):
                at = np.flatnonzero(wanted[q])
                at = at[unnamed[at] | (ids[at] != self.ids[first + q])]
                # Sums in one order for every pair, so that equal vectors get equal scores wherever they lie.
                self._merge(first + q, ids[at], unnamed[at], np.einsum("ij,j->i", values[at], self.queries[first + q]))

    def _merge(self, q: int, ids: np.ndarray, unnamed: np.ndarray, scores: np.ndarray) -> None:
        held = np.isfinite(self.scores[q])
        ids, scores = np.concatenate([self.found[q][held], ids]), np.concatenate([self.scores[q][held], scores])
        unnamed = np.concatenate([self.unnamed[q][held], unnamed])
        order = np.lexsort((ids, unnamed, -scores))[:self.k]
        self.scores[q], self.found[q], self.unnamed[q] = -np.inf, 0, False
        n = len(order)
        self.scores[q, :n], self.found[q, :n], self.unnamed[q, :n] = scores[order], ids[order], unnamed[order]


def _pass_over(index: DataFrame, block: list, dimensions: int, bits: int, seed: int, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(
        (np.array([r["vec_id"] for r in block], np.int64), np.array([r["embedding"] for r in block], np.float64)))

    def search(batches):
        best = _Best(*shared.value, rotation(dimensions, bits, seed), k)
        for batch in batches:
            for start in range(0, len(batch), ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                values = np.asarray(part.column("embedding").flatten()).reshape(len(part), dimensions)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(part), -1)
                ids = part.column("vec_id")
                best.add(np.asarray(ids.cast(pa.int64()).fill_null(0)), np.asarray(ids.is_null()), values, codes,
                         np.asarray(part.column("correction")), np.asarray(part.column("spread")))
        at, place = np.nonzero(np.isfinite(best.scores))
        task = np.full(len(at), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(best.ids[at]), pa.array(best.found[at, place], mask=best.unnamed[at, place]), pa.array(best.scores[at, place]),
                                          pa.array(task)], names=["query_id", "vec_id", "score", "task"])

    return index.mapInArrow(search, "query_id bigint, vec_id bigint, score double, task int")


def _leading(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, bits: int = CODE_BITS, seed: int = SEED) -> DataFrame:
    """The k nearest rows of ``vectors`` per row of ``queries`` (both ``vec_id, embedding``): ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    lengths = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(
        F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if lengths is None:
        return empty
    dimensions = lengths["n"]
    bits = max(bits, dimensions)
    index = staged(build_index(vectors, dimensions, bits, seed), "codes")
    asked = staged(build_index(queries, dimensions, bits, seed).select("vec_id", "embedding"), "asked")
    blocks = max(1, -(-asked.count() * dimensions * 8 // QUERY_BLOCK_BYTES))
    width = max(1, math.isqrt(index.rdd.getNumPartitions()))
    parts = []
    for block in range(blocks):
        # Bounded: about QUERY_BLOCK_BYTES of vectors, dealt out by a hash of the id.
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if rows:
            found = _pass_over(index, rows, dimensions, bits, seed, k).withColumn("_part", F.col("task") % width)
            merged = _leading(_leading(found, ["query_id", "_part"], k).drop("rank"), ["query_id"], k)
            parts.append(staged(merged.select("query_id", "rank", "vec_id", "score"), "nearest"))
    if not parts:
        return empty
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def embeddings_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
