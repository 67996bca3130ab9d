"""Shards cut from a Hilbert-curve order. DataFrame functions only.

Several metadata columns are quantised to a few bits each by their rank in the corpus, the bins are turned into
an index along the Hilbert curve, rows are sorted by that index, and the order is cut into runs of equal row
counts. Rows near on the curve are near in every dimension, so each shard covers a small range of each and a
filter on any of them skips most files.

Nulls are a value of their own that sorts first. Repeated rows take neighbouring slots. An empty table gives no
shards. Where rows tie on the curve, id, size and text checksum order them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlumen.llm.common import row_hash, staged, with_positions

BITS = 5
SHARDS = 8


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _rotate(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def _low_ones(i: int) -> int:
    return (~i & (i + 1)).bit_length() - 1


@lru_cache
def curve_table(n: int) -> tuple[list[int], list[int]]:
    """Per (state, corner) of the n-dimensional curve: its digit and the next state.

    A state is an entry corner and a direction. The corner, seen from the state, is a Gray code whose rank is the
    digit; the sub-cube's own entry and direction give the next state.
    """
    corners = 1 << n
    rank = {_gray(i): i for i in range(corners)}
    entry = [0 if i == 0 else _gray(2 * ((i - 1) // 2)) for i in range(corners)]
    turn = [0 if i == 0 else _low_ones(i - 1 if i % 2 == 0 else i) % n for i in range(corners)]
    digits, following = [], []
    for state in range(corners * n):
        start, direction = divmod(state, n)
        for corner in range(corners):
            digit = rank[_rotate(corner ^ start, -(direction + 1), n)]
            digits.append(digit)
            nxt = start ^ _rotate(entry[digit], direction + 1, n)
            following.append(nxt * n + (direction + turn[digit] + 1) % n)
    return digits, following


def hilbert_index(bins: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of integer coordinates with ``bits`` bits each; the result takes len(bins) * bits bits."""
    n = len(bins)
    digits, following = curve_table(n)
    corner_of = [sum(((F.shiftright(b.cast("bigint"), level).bitwiseAND(F.lit(1))) * (1 << i) for i, b in enumerate(bins)),
                     F.lit(0)) for level in reversed(range(bits))]
    digit_table = F.array(*[F.lit(d) for d in digits])
    state_table = F.array(*[F.lit(s) for s in following])

    def step(held: Column, corner: Column) -> Column:
        at = (held["state"] * (1 << n) + corner).cast("int")
        return F.struct(F.get(state_table, at).alias("state"),
                        (held["index"] * (1 << n) + F.get(digit_table, at)).cast("bigint").alias("index"))

    begin = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("index"))
    return F.aggregate(F.array(*[c.cast("bigint") for c in corner_of]), begin, step, lambda held: held["index"])


def with_bins(rows: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """Add ``_bin_<column>``: which of 2^bits equal parts of the corpus the value's first row falls into.

    Only counts per distinct value are sorted, so a value that holds a third of all rows costs one row here.
    """
    for name in columns:
        counts = rows.groupBy(F.col(name).alias("_value")).agg(F.count("*").alias("_rows"))
        placed, total = with_positions(counts, ["_value"], F.col("_rows"), f"ranks-{name}")
        bins = placed.select("_value", F.floor(F.col("position") * (1 << bits) / F.lit(max(total, 1))).cast("int").alias(f"_bin_{name}"))
        rows = rows.join(bins, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value")
    return rows


def shards(rows: DataFrame, dimensions: list[str], ties: list[str], count: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Add ``curve``, ``shard`` (0 to count - 1) and ``slot`` (from 0 in each shard).

    Shard sizes differ by one row at most. ``ties`` orders rows that share a place on the curve.
    """
    binned = with_bins(rows, dimensions, bits)
    curved = binned.withColumn("curve", hilbert_index([F.col(f"_bin_{d}") for d in dimensions], bits))
    curved = curved.drop(*[f"_bin_{d}" for d in dimensions])
    placed, total = with_positions(curved, ["curve", *ties], F.lit(1), "curve")
    # Row p belongs to shard floor(p * count / total); that shard begins at ceil(shard * total / count).
    shard = F.expr(f"(position * {count}) div {max(total, 1)}")
    begin = F.expr(f"(shard * {total} + {count - 1}) div {count}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - begin).drop("position")


def write_shards(documents: DataFrame, placed: DataFrame, key: list[str], path: str) -> None:
    """Write ``documents`` as one folder per shard, each file sorted along the curve.

    ``placed`` holds ``key, shard, curve``. A shard is split over files by row, and each file keeps the narrow
    ranges of its stretch of the curve.
    """
    named = placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "shard", "curve").distinct()
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = documents.join(named, same).drop(*[f"_k{i}" for i in range(len(key))])
    joined.repartitionByRange("shard", "curve", *key).sortWithinPartitions("shard", "curve").drop("curve").write.partitionBy(
        "shard").parquet(path)


def documents_query(documents: DataFrame) -> DataFrame:
    """All documents by source, language and size; no text is shuffled."""
    narrow = documents.select(
        "doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    narrow = staged(narrow.withColumn("_tie", row_hash("doc_id", "size", "text_crc32")), "sizes")
    placed = shards(narrow, ["source", "lang", "size"], ["doc_id", "_tie"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
