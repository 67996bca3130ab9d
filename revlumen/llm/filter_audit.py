"""Interaction audit of document filters: what each filter removes in every order of applying them.

Every document becomes a mask of the filters it fails; documents are counted per part and mask before anything
else happens, so an audit handles 2^filters cells per part, whatever the corpus. Each cell folds across the array
of all orders (a constant that travels with the plan): ``transform`` walks the orders, ``aggregate`` walks the
filters of an order with the running state, and out come 120 x 5 structs weighted by the cell's counts. The arrays
of a part's cells are merged by elementwise sums.

Duplicates are found on 256-bit hashes of texts: the least id of every hash is a combining aggregate, and rows look
it up by hash *and* id, so a text that a third of all documents share is spread over all tasks.

Nulls: a null text is the empty text; it has no words, so it fails ``A`` only (and ``E`` if a smaller id is empty
too). A null part is the part ''. A null id is never smaller than another and has no smaller one, and has no label.
Repeated rows count each; rows of one id and text do not fail ``E`` because of each other. A label given twice
holds if any of its rows says 1. Texts of any length are read whole. No documents: no parts, no rows. Only the
named columns are read, so extra columns do no harm.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _own_failures(text: Column) -> Column:
    """Bits of the conditions A to D, which look at one text only."""
    def with_words(words: Column) -> Column:
        return (F.when(F.size(words) < 100, 1).otherwise(0)
                + F.when(100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 2).otherwise(0))

    words = F.filter(F.split(text, WORD_SEPARATORS, -1), lambda w: w != "")
    # A list of one makes the words computed once.
    from_words = F.get(F.transform(F.array(words), with_words), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (from_words + F.when(100 * capitals > 10 * F.length(text), 4).otherwise(0)
            + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0))


def failure_masks(documents: DataFrame) -> DataFrame:
    """``doc_id, part, mask``: bit i of ``mask`` says that the document fails filter i."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                            _own_failures(text).alias("_own"), F.unhex(F.sha2(text, 256)).alias("_key"))
    first = rows.groupBy("_key").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    known = rows.join(first, ["_key", "doc_id"], "left")
    repeated = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return known.select("doc_id", "part", (F.col("_own") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and mask, and how many of them have each label."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    one = masks.join(marked, "doc_id", "left")
    return one.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("_good", F.lit(0))).cast("bigint").alias("good"),
        F.sum(F.coalesce("_toxic", F.lit(0))).cast("bigint").alias("toxic"))


def _orders(filters: int) -> Column:
    """All orders of the filters' bits."""
    return F.lit([[1 << f for f in order] for order in permutations(range(filters))])


def _fold(orders: Column) -> Column:
    """One cell's steps in every order, as one long array of structs."""
    n, good, toxic = F.col("n"), F.col("good"), F.col("toxic")
    mask = F.col("mask").cast("int")
    none = F.lit(0).cast("bigint")
    step = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"

    def walk(order: Column) -> Column:
        def visit(state: Column, bit: Column) -> Column:
            fails = mask.bitwiseAND(bit) != 0
            here, alive = fails & state["alive"], state["alive"] & ~fails
            done = F.struct(
                F.when(alive, n).otherwise(none).alias("kept"), F.when(here, n).otherwise(none).alias("removed"),
                F.when(fails & ~state["alive"], n).otherwise(none).alias("redundant"),
                F.when(mask == bit, n).otherwise(none).alias("unique_fails"),
                F.when(here, good).otherwise(none).alias("good_lost"),
                F.when(here, toxic).otherwise(none).alias("toxic_lost"))
            return F.struct(alive.alias("alive"), F.concat(state["steps"], F.array(done)).alias("steps"))

        start = F.struct(F.lit(True).alias("alive"), F.array().cast(step).alias("steps"))
        return F.aggregate(order, start, visit, lambda state: state["steps"])

    return F.flatten(F.transform(orders, walk))


def _summed(cells: Column) -> Column:
    """Elementwise sum of equally long arrays of structs."""
    def add(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))

    return F.aggregate(F.slice(cells, 2, F.size(cells)), F.get(cells, F.lit(0)), add)


def interactions(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every order and step of every part: ``part, filter_order, step``, the counts and ``shapley``.

    ``shapley`` is what the step's filter removes, summed over all orders. A part has at most 2^filters cells, so
    gathering them takes no more than that many arrays.
    """
    orders = list(permutations(names))
    steps = [(f"{''.join(o)}", at + 1, name) for o in orders for at, name in enumerate(o)]
    labels = F.arrays_zip(*[F.lit([s[i] for s in steps]).alias(c) for i, c in enumerate(("filter_order", "step", "letter"))])
    folded = cells.select("part", _fold(_orders(len(names))).alias("_steps"))
    merged = folded.groupBy("part").agg(_summed(F.collect_list("_steps")).alias("_steps"))
    named = merged.select("part", F.zip_with(labels, "_steps", lambda a, b: F.struct(
        a["filter_order"].alias("filter_order"), a["step"].alias("step"), a["letter"].alias("letter"),
        *[b[c].alias(c) for c in COUNTS])).alias("_steps"))

    def removed_by(name: str) -> Column:
        mine = F.filter("_steps", lambda s: s["letter"] == name)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda total, s: total + s["removed"])

    totals = F.map_from_arrays(F.lit(list(names)), F.array(*[removed_by(n) for n in names]))
    rows = named.select("part", totals.alias("_totals"), F.explode("_steps").alias("_step"))
    return rows.select("part", F.col("_step.filter_order").alias("filter_order"), F.col("_step.step").cast("int").alias("step"),
                       *[F.col(f"_step.{c}").alias(c) for c in COUNTS],
                       F.element_at("_totals", F.col("_step.letter")).alias("shapley"))


def documents_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(mask_cells(failure_masks(documents), labels))
