"""Ranked lexical search by per-term geometric blocking.

Index. Documents become vectors of term counts, in shards of a few thousand. Within a shard the posting list of
every term is cut into blocks of documents that resemble each other: a list is clustered on its own, around
documents of the list, by random projections of the vectors. Each block stores its members and a summary, the
coordinatewise maximum of its members' impacts, rounded up to one byte.

Search. An item's terms are ordered by the most they can add to a score. A document belongs to the first of the
item's lists that holds it, so at the list of term i a block is bounded by the summary's impacts of term i and the
terms after it. A list is skipped if its rest of the order stays below the item's threshold, a block if its exact
summary bound does; documents of all other blocks are scored in full. The threshold is the 50th best score among
the documents of the blocks with the highest bounds, so it never exceeds the true one: nothing is lost, and the
blocks affect cost only.

Items are taken in blocks of bounded size (``ITEMS``, ``TERMS``); the index of a block of items holds the lists of
its terms. What comes to the driver is bounded by that: the block's terms, their frequencies and the thresholds.
Document frequencies, lengths and the number of documents are counted over all documents.

Nulls: a null text has no terms and is not ranked; a null document id sorts last among equal scores. Rows that
repeat an id and a text are ranked each. An item without terms, or without matches, has no rows; rows that repeat
an item's id and text are one item; a null item id is kept. Texts of any length are read whole. Without items or
documents there are no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from revlumen.llm.common import row_hash, staged

TOP = 50
ITEMS, TERMS = 256, 8192
SHARD_DOCUMENTS, SHARD_CELLS = 4096, 1 << 24
BLOCK_DOCUMENTS = 256
SKETCH = 32
SEED_BLOCKS = 200
# Seeds come from the lists at the head of an item's order: from the part of it that can add so much of all it can
# add. Items that find too few documents there go on to the next share.
SEED_SHARES = (0.5, 0.125, 0.0)
# Impacts stay below a million; a summary holds them in steps that fit a byte.
STEP = 3922
SCORED_AT_ONCE, BOUNDED_AT_ONCE = 1 << 19, 2048
# Digits, folded letters and whatever is not ASCII stay, the rest is blank. Works on UTF-8: all bytes of other
# characters are 128 or more.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text and how often they occur."""
    return Counter((text or b"").translate(_FOLD).split())


@dataclass
class Items:
    """A bounded block of items: ids, terms by number, and each item's terms in the order of what they can add."""

    ids: list = field(default_factory=list)
    own_terms: list[list[bytes]] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)
    order: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    rests: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id, terms: list[bytes]) -> None:
        self.ids.append(item_id)
        self.own_terms.append(terms)
        for term in terms:
            self.number.setdefault(term, len(self.number))

    def weigh(self, frequencies: dict[int, int], most: dict[int, int], documents: int) -> None:
        for terms in self.own_terms:
            known = [t for t in map(self.number.__getitem__, terms) if t in frequencies]
            weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies[t] + 1))) for t in known}
            known.sort(key=lambda t: (-weight[t] * most[t], t))
            adds = np.array([weight[t] * most[t] for t in known], np.int64)
            self.order.append(np.array(known, np.int64))
            self.weights.append(np.array([weight[t] for t in known], np.int64))
            self.rests.append(np.cumsum(adds[::-1])[::-1])

    def table(self) -> np.ndarray:
        table = np.zeros((len(self.ids), len(self.number)), np.int64)
        for row, (order, weights) in enumerate(zip(self.order, self.weights)):
            table[row, order] = weights
        return table


def item_blocks(benchmark: DataFrame):
    """The items in blocks of at most ``ITEMS`` items and, but for a single larger item, ``TERMS`` terms."""
    rows = benchmark.select("item_id", "text", row_hash("text").alias("_row")).dropDuplicates(["item_id", "_row"]).orderBy(
        "item_id", "_row").select("item_id", F.col("text").cast("binary"))
    block = Items()
    for item_id, text in rows.toLocalIterator():
        terms = sorted(terms_of(bytes(text) if text is not None else None))
        if block.ids and (len(block.ids) == ITEMS or len(block.number.keys() | terms) > TERMS):
            yield block
            block = Items()
        block.add(item_id, terms)
    if block.ids:
        yield block


def term_vectors(documents: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``shard, place, doc_id, n, terms, times`` for each document with a term; ``n`` counts all its terms.

    ``terms`` are numbers of the terms asked for. A shard is a run of documents of one task; its number is fixed
    once the rows are written.
    """
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("doc_id", id_type),
                           T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("times", T.ArrayType(T.LongType()))])
    id_arrow = to_arrow_type(id_type)
    size = max(64, min(SHARD_DOCUMENTS, SHARD_CELLS // max(1, len(number))))
    shared = documents.sparkSession.sparkContext.broadcast(number)

    def count(batches):
        number, seen = shared.value, 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                found = terms_of(text)
                if found:
                    own = sorted((number[t], times) for t, times in found.items() if t in number)
                    rows.append((first + seen // size, seen % size, at, found.total(), [t for t, _ in own], [k for _, k in own]))
                    seen += bool(own)
            shard, place, at, n, terms, times = map(list, zip(*rows)) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), pa.array(place, pa.int32()),
                 batch.column("doc_id").take(pa.array(at, pa.int64())).cast(id_arrow), pa.array(n, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                names=["shard", "place", "doc_id", "n", "terms", "times"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a list column."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], joined.type)
    return np.diff(joined.offsets.to_numpy()), joined.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _impacts(n: np.ndarray, lengths: np.ndarray, times: np.ndarray, documents: int, terms: int) -> np.ndarray:
    # Products of lengths and totals may pass 64 bits, so these are whole numbers of any size.
    m = np.array([50 + (50 * int(k) * documents) // terms for k in n], np.int64)
    return (1_000_000_000 * times) // (1000 * times + 20 * np.repeat(m, lengths))


def term_blocks(vectors: DataFrame, width: int, documents: int, terms: int) -> DataFrame:
    """``shard, term, members, summary``: every posting list of a shard in blocks of similar documents."""

    def build(table: pa.Table) -> pa.Table:
        shard, place = table.column("shard")[0].as_py(), table.column("place").to_numpy()
        lengths, term = _flat(table.column("terms"))
        impacts = _impacts(table.column("n").to_numpy(), lengths, _flat(table.column("times"))[1], documents, terms)
        row = np.repeat(np.arange(len(lengths)), lengths)
        dense = np.zeros((len(lengths), width), np.uint8)
        dense[row, term] = -(-impacts // STEP)
        # The same projection in every task.
        spread = np.random.default_rng(13).standard_normal((width, SKETCH), np.float32)
        sketch = np.concatenate([dense[i:i + 256].astype(np.float32) @ spread for i in range(0, len(dense), 256)])
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        by_term = np.argsort(term, kind="stable")
        found, starts = np.unique(term[by_term], return_index=True)
        names, members, summaries = [], [], []
        for t, held in zip(found.tolist(), np.split(row[by_term], starts[1:])):
            parted = [held]
            if len(held) > BLOCK_DOCUMENTS:
                parts = -(-len(held) // BLOCK_DOCUMENTS)
                centres = sketch[held[np.linspace(0, len(held) - 1, parts).astype(np.int64)]]
                nearest = np.argmax(sketch[held] @ centres.T, axis=1)
                order = np.argsort(nearest, kind="stable")
                parted = np.split(held[order], np.unique(nearest[order], return_index=True)[1][1:])
            names += [t] * len(parted)
            members += [place[p] for p in parted]
            summaries += [dense[p].max(axis=0).tobytes() for p in parted]
        return pa.table({"shard": pa.array([shard] * len(names), pa.int64()), "term": pa.array(names, pa.int32()),
                         "members": pa.array(members, pa.list_(pa.int32())), "summary": pa.array(summaries, pa.binary())})

    return vectors.where(F.size("terms") > 0).groupBy("shard").applyInArrow(
        build, "shard bigint, term int, members array<int>, summary binary")


def within_reach(blocks: DataFrame, items: Items, floors: np.ndarray, share: float = 0.0) -> DataFrame:
    """``item, bound, shard, members``: blocks of an item's lists that may hold a document of its floor or more.

    With a ``share``, lists whose rest of the order can add less than this share of the whole order are left out.
    """
    width = len(items.number)
    asked: dict[int, list[tuple[int, int]]] = {}
    for item, order in enumerate(items.order):
        for at, term in enumerate(order.tolist()):
            if items.rests[item][at] >= max(floors[item], share * items.rests[item][0]):
                asked.setdefault(term, []).append((item, at))
    shared = blocks.sparkSession.sparkContext.broadcast((asked, items.order, items.weights, floors))

    def bound(batches):
        asked, orders, weights, floors = shared.value
        for part in (batch.slice(start, BOUNDED_AT_ONCE) for batch in batches for start in range(0, len(batch), BOUNDED_AT_ONCE)):
            term = part.column("term").to_numpy()
            summary = np.frombuffer(b"".join(part.column("summary").to_pylist()), np.uint8).reshape(-1, width)
            by_term = np.argsort(term, kind="stable")
            found, starts = np.unique(term[by_term], return_index=True)
            for t, rows in zip(found.tolist(), np.split(by_term, starts[1:])):
                own = summary[rows]
                item_parts, bound_parts, row_parts = [], [], []
                for item, at in asked.get(t, ()):
                    bounds = own[:, orders[item][at:]].astype(np.int64) @ weights[item][at:] * STEP
                    near = np.flatnonzero(bounds >= floors[item])
                    if len(near):
                        item_parts.append(np.full(len(near), item, np.int32))
                        bound_parts.append(bounds[near])
                        row_parts.append(rows[near])
                if row_parts:
                    row = pa.array(np.concatenate(row_parts), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(item_parts)), pa.array(np.concatenate(bound_parts)),
                         part.column("shard").take(row), part.column("members").take(row)],
                        names=["item", "bound", "shard", "members"])

    wanted = blocks.where(F.col("term").isin(list(asked))) if len(asked) < width // 4 else blocks
    return wanted.mapInArrow(bound, "item int, bound bigint, shard bigint, members array<int>")


def scored(vectors: DataFrame, reach: DataFrame, items: Items, floors: np.ndarray, documents: int, terms: int) -> DataFrame:
    """``item, doc_id, score`` of every document in reach that scores its item's floor or more."""
    members = reach.select("item", "shard", F.explode("members").alias("place"))
    # At most one block of items per document.
    wanted = members.groupBy("shard", "place").agg(F.collect_set("item").alias("items"))
    both = vectors.join(wanted, ["shard", "place"]).where(F.size("terms") > 0).select("doc_id", "n", "terms", "times", "items")
    id_type = vectors.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    shared = vectors.sparkSession.sparkContext.broadcast((items.table(), floors))

    def score(batches):
        table, floors = shared.value
        for batch in batches:
            lengths, term = _flat(batch.column("terms"))
            impacts = _impacts(batch.column("n").to_numpy(), lengths, _flat(batch.column("times"))[1], documents, terms)
            asked, item = _flat(batch.column("items"))
            starts = np.cumsum(lengths) - lengths
            row = np.repeat(np.arange(len(lengths)), asked)
            work = np.cumsum(lengths[row])
            edges = np.searchsorted(work, np.arange(0, work[-1], SCORED_AT_ONCE) if len(work) else [])
            for low, high in zip(edges, [*edges[1:], len(row)]):
                some, its = row[low:high], item[low:high]
                if not len(some):
                    continue
                sizes = lengths[some]
                begins = np.cumsum(sizes) - sizes
                at = np.repeat(starts[some] - begins, sizes) + np.arange(sizes.sum())
                total = np.add.reduceat(table[np.repeat(its, sizes), term[at]] * impacts[at], begins)
                high_enough = np.flatnonzero(total >= floors[its])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(its[high_enough].astype(np.int32)),
                     batch.column("doc_id").take(pa.array(some[high_enough])), pa.array(total[high_enough])],
                    names=["item", "doc_id", "score"])

    return both.mapInArrow(score, schema)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(documents: DataFrame, items: Items, top: int = TOP, seed_blocks: int = SEED_BLOCKS) -> DataFrame:
    """``item, rank, doc_id, score`` for a block of items."""
    vectors = staged(term_vectors(documents, items.number), "term-vectors")
    count, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = vectors.select("n", F.explode(F.arrays_zip("terms", "times")).alias("p"))
    # The exact impact of every posting, as in _impacts.
    impact = F.expr(f"(1000000000 * p.times) div (1000 * p.times + 20 * (50 + cast(cast(50 as decimal(38,0)) * n * {count} div {max(1, total)} as bigint)))")
    stats = each.groupBy(F.col("p.terms").alias("term")).agg(F.count("*").alias("df"), F.max(impact).alias("most")).collect()
    items.weigh({r["term"]: r["df"] for r in stats}, {r["term"]: r["most"] for r in stats}, count)
    blocks = staged(term_blocks(vectors, len(items.number), count, total), "term-blocks")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "shard", F.xxhash64("members")))
    # Items that have their threshold are left out of later seeds by a floor that nothing reaches.
    floors, settled = np.ones(len(items.ids), np.int64), np.iinfo(np.int64).max
    for share in SEED_SHARES:
        sought = np.where(floors > 1, settled, 1)
        seeds = within_reach(blocks, items, sought, share).withColumn("_place", place).where(F.col("_place") <= seed_blocks)
        best = _best(scored(vectors, seeds, items, sought, count, total), top)
        for item, lowest, n in best.groupBy("item").agg(F.min("score"), F.count("*")).collect():
            if n == top:
                floors[item] = lowest
        if (floors > 1).all():
            break
    return _best(scored(vectors, within_reach(blocks, items, floors), items, floors, count, total), top)


def ranked(documents: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: every item's ``top`` documents."""
    spark = documents.sparkSession
    id_field = T.StructField("item_id", benchmark.schema["item_id"].dataType)
    parts = []
    for block in item_blocks(benchmark):
        named = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.IntegerType()), id_field]))
        # At most ITEMS rows.
        parts.append(staged(search(documents, block, top), "ranked").join(F.broadcast(named), "item"))
    if not parts:
        none = T.StructType([id_field, T.StructField("rank", T.IntegerType()),
                             T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], none)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select("item_id", "rank", "doc_id", "score")


def documents_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked(documents, benchmark)
