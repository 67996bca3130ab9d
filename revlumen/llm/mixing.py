"""A mix of sources fitted to word budgets by subset sums over document lengths.

Each source gets a target. Whole passes over the source come first; what remains of its budget is met by a set
of documents whose lengths sum to it as nearly as possible: documents are counted by exact length, an equal
share of every length is taken, and a bounded knapsack over lengths and counts fills the rest. How many
documents of each length are taken is thereby fixed, which ones is decided by a seeded order.

Only counts per source and length leave the rows: a row per distinct length, of which a source with n words has
at most the square root of 2n. Ranks within a length come from a distributed order, so a length that holds a
third of all rows is no hot group.

Null texts and texts without words have size 0 and are never taken. A null source is a source of its own, last
in order. Repeated rows are ranked one by one and may be taken a different number of times. Empty tables give
empty mixes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import row_hash, staged, with_positions

MOST_REPEATS = 3
SEED = 7
# The knapsack works below this many words; above it, lengths are taken from the largest down.
KNAPSACK_WORDS = 1 << 15


def words_in(text: Column) -> Column:
    """How many runs of characters other than blanks a text holds."""
    blanks = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    edges = (F.get(blanks, F.lit(0)) == "").cast("int") + ((F.size(blanks) > 1) & (F.element_at(blanks, -1) == "")).cast("int")
    return (F.size(blanks) - edges).cast("bigint")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that the sum comes near ``budget``.

    One document more or fewer never brings the sum nearer. ``lengths`` are distinct and positive.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    # Python integers: shares of large corpora overflow 64 bits.
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths)
    for i in order:
        if left <= KNAPSACK_WORDS:
            break
        more = min(int(counts[i] - taken[i]), (left - KNAPSACK_WORDS) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    if left <= KNAPSACK_WORDS * 2:
        taken = taken + _knapsack(lengths, counts - taken, left)
    else:
        # Every length that is left is above left - KNAPSACK_WORDS, so that no two of them fit: the longest that fits is best.
        fits = np.where((counts > taken) & (lengths <= left), lengths, 0)
        if fits.any():
            taken[np.argmax(fits)] += 1
    # One document more or fewer, as long as that comes nearer.
    left = budget - int((lengths * taken).sum())
    while left:
        held = counts > taken if left > 0 else taken > 0
        missed = np.where(held, np.abs(lengths - abs(left)), abs(left))
        best = int(np.argmin(missed))
        if missed[best] >= abs(left):
            break
        step = 1 if left > 0 else -1
        taken[best] += step
        left -= step * int(lengths[best])
    return taken


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The bounded knapsack: the reachable sums are bits of one integer, counts are split into powers of two."""
    chosen = np.zeros(len(lengths), np.int64)
    reachable, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for i in np.argsort(-lengths):
        length = int(lengths[i])
        left = min(int(counts[i]), budget // length)
        batch = 1
        while left > 0 and not reachable >> budget & 1:
            many = min(batch, left)
            steps.append((i, many, reachable))
            reachable |= (reachable << many * length) & mask
            left -= many
            batch *= 2
        if reachable >> budget & 1:
            break
    best = reachable.bit_length() - 1
    for i, many, before in reversed(steps):
        if not before >> best & 1:
            chosen[i] += many
            best -= many * int(lengths[i])
    return chosen


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size").reset_index(drop=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total = int((lengths * counts).sum())
    budget = int(round(float(pdf["target"].iloc[0])))
    passes = min(budget // total, MOST_REPEATS)
    extra = fit(lengths, counts, budget - passes * total) if passes < MOST_REPEATS else np.zeros(len(pdf), np.int64)
    return pd.DataFrame({"source_place": pdf["source_place"], "size": lengths, "passes": passes, "extra": extra,
                         "first": np.concatenate([[0], np.cumsum(counts)[:-1]])})


def targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``: shares of all sizes by weight, none above ``most`` times its source.

    What a full source cannot take is shared again by weight. The level rises until no further source is full;
    each step is a sum over the sources.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    full_before = -1
    while True:
        full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        held = sources.agg(F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("used"),
                           F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
                           F.count(F.when(full, 1)).alias("n")).first()
        if held["n"] == full_before or not held["weight"]:
            break
        full_before = held["n"]
        level = (total - held["used"]) / held["weight"]
    return sources.withColumn("target", F.least(
        (F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(float(level))))


def mix(documents: DataFrame, seed: int = SEED, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per document ``doc_id, text_hash, size, source_size, target, times``; sources weigh ``weights`` in turn."""
    sized = staged(documents.select("doc_id", "source", row_hash("text").alias("text_hash"),
                                    words_in(F.col("text")).alias("size")), "sizes")
    counts = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sums = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn(
        "none", F.col("source").isNull())
    placed, _ = with_positions(sums, ["none", "source"], F.lit(1), "sources")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights)).cast("int"))
    sources = staged(targets(placed.select("source", "source_size", F.col("position").alias("source_place"),
                                           weight.alias("weight"))), "targets")
    named = counts.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    plan = named.where("size > 0").select("source_place", "size", "n", "target").groupBy("source_place").applyInPandas(
        _plan_source, "source_place bigint, size bigint, passes bigint, extra bigint, first bigint")
    plan = staged(plan, "mix-plan")
    # One order serves all: rows of a source and length stand together, in seeded order.
    narrow = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "text_hash", "size", "source_place", "source_size", "target")
    # The hash follows size, so that a hot length spreads over many slices.
    seeded = narrow.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    ranked, _ = with_positions(seeded, ["source_place", "size", "_draw", "doc_id"], F.lit(1), "draws")
    group_start = staged(_group_starts(counts, sources), "group-starts")
    met = ranked.join(group_start, ["source_place", "size"]).join(plan, ["source_place", "size"], "left")
    times = F.coalesce(F.col("passes") + (F.col("position") - F.col("begin") < F.col("extra")).cast("bigint"), F.lit(0))
    return met.select("doc_id", "text_hash", "size", "source_size", "target", times.alias("times"))


def _group_starts(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_place, size, begin``: how many rows stand before the first of a source and length."""
    named = counts.join(sources.select(F.col("source").alias("_source"), "source_place"),
                        F.col("source").eqNullSafe(F.col("_source"))).select("source_place", "size", "n")
    placed, _ = with_positions(named, ["source_place", "size"], F.col("n"), "group-rows")
    return placed.select("source_place", "size", F.col("position").alias("begin"))


def documents_query(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Rows that share id and text are taken as often as their draws say in total.
    """
    drawn = mix(documents, seed).groupBy("doc_id", "text_hash").agg(F.sum("times").alias("_times"), F.count("*").alias("_rows"))
    drawn = drawn.where("_times > 0").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_times", "_rows")
    own = documents.withColumn("_own", row_hash("text"))
    met = own.join(drawn, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash")))
    # Equal rows need not be told apart: each gets an equal share of their draws, the first of them the rest.
    first = F.row_number().over(W.partitionBy("_doc", "_hash").orderBy("_own")) == 1
    share = F.floor(F.col("_times") / F.col("_rows")) + F.when(first, F.col("_times") % F.col("_rows")).otherwise(0)
    counted = met.withColumn("_share", share.cast("int")).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_share"))))
    return counted.select(*documents.columns)

