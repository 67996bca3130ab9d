"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles. One permutation scatters the shingles over a ring, a second
one gives values around the ring, and coordinate k of the signature is the least value that the shingles meet
when the ring is shifted by k: two permutations serve all coordinates. Bands of coordinates name buckets, and
pairs that share a bucket are confirmed by the exact Jaccard similarity of the full sets.

With 32 bands of 6 coordinates a pair at similarity 0.85 shares no bucket with a chance of about 3 in 10^7.

Equal texts are one node; components of nodes are found without gathering a group anywhere. Null, empty and
blank texts have an empty set and link with nothing. Shorter texts than a shingle are one shingle, very long ones
are taken whole. Repeated rows get the same component. Null ids take part; a component of null ids only has a null
id. An empty table gives no rows. Other columns than id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import staged
from revlumen.llm.components import crowded_members, labels_of, link_members, turned

SHINGLE = 3
PERCENT = 85
BANDS, ROWS = 32, 6
RING = 1 << 20
SEED = 20240229
CACHED_WORDS = 400_000
# Parities of a set, in words of 64 bits.
PARITY_WORDS = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, kept until too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _scramble(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def shingle_hashes(text: str | None, hashes: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    # Bytes know only the six blanks of the contract, and fold A-Z only.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(size, len(words))
    # Starting from the length keeps a short whole text apart from a shingle.
    total = np.full(len(words) - span + 1, span, np.uint64)
    for at in range(span):
        total = _scramble(total * _MIX + own[at:len(words) - span + 1 + at])
    return np.unique(total)


class Signer:
    """The two permutations; made once per task."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, ring: int = RING, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.ring = bands, rows, ring
        self.places = rng.permutation(ring).astype(np.uint32)
        values = rng.permutation(ring).astype(np.uint32)
        around = np.concatenate([values, values[:bands * rows]])
        # Row i: the values that a shingle at place i meets at shifts 0, 1, 2, ...
        self.shifted = np.lib.stride_tricks.sliding_window_view(around, bands * rows)

    def signature(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        places = self.places[(shingles & np.uint64(self.ring - 1)).astype(np.int64)]
        least = None
        for start in range(0, len(places), block):
            part = self.shifted[places[start:start + block]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        grid = signature.reshape(self.bands, self.rows).astype(np.uint64)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for at in range(self.rows):
            keys = _scramble(keys * _MIX + grid[:, at])
        return keys.view(np.int64)


def _sign(batches, size: int):
    signer, hashes = Signer(), _Words()
    for batch in batches:
        counts, keys = [], []
        for text in batch.column("text").to_pylist():
            shingles = shingle_hashes(text, hashes, size)
            counts.append(len(shingles))
            keys.append(signer.band_keys(signer.signature(shingles)) if len(shingles) else np.empty(0, np.int64))
        ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(counts, pa.int64()), bands],
            names=["doc_id", "node", "n_shingles", "bands"])


def set_parities(shingles: np.ndarray) -> np.ndarray:
    """``PARITY_WORDS`` words: whether an odd number of shingles falls on a bit. Two sets differ by as many shingles as bits, at least."""
    bits = PARITY_WORDS * 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(left: Column, right: Column, percent: int) -> Column:
    """No link fails this test on sizes and parities of two sets: ``n, odd`` each."""
    together = left["n"] + right["n"]
    return (100 * F.least(left["n"], right["n"]) >= percent * F.greatest(left["n"], right["n"])) & (
        (100 + percent) * turned(left["odd"], right["odd"], PARITY_WORDS) <= (100 - percent) * together)


def _sets(batches, size: int):
    hashes = _Words()
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            sets = [shingle_hashes(t, hashes, size) for t in part.column("text").to_pylist()]
            ends = pa.array(np.cumsum([0] + [len(x) for x in sets]).astype(np.int32))
            odd = pa.array(np.concatenate([set_parities(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([
                part.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64))),
                pa.FixedSizeListArray.from_arrays(odd, PARITY_WORDS).cast(pa.list_(pa.int64()))], names=["node", "shingles", "odd"])


def prefixes(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members ``bucket, node, component, about, place`` of ``mixed`` (``node, component, about``) by shingles of their prefixes.

    Sets that are similar enough share one of their first shingles in any common order: of n shingles, at least
    ``percent`` per cent must be shared, so the n - that + 1 first cannot all be missed. Shingles of one component
    come first and are left out, as they pair with nothing, then the rare ones.
    """
    numbered = staged(mixed.withColumn("id", F.monotonically_increasing_id()), "numbered")
    parts = numbered.groupBy("component").agg(F.min("id").alias("part"))
    shingles = staged(numbered.join(parts, "component").join(sets, "node").select(
        "id", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    shared = shingles.groupBy("shingle").agg(
        F.count("*").alias("found"), F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low != _high").select(
        "shingle", "found")
    own = W.partitionBy("id")
    placed = shingles.join(shared, "shingle").withColumn(
        "place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("found", "shingle")))
    first = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return staged(first.join(numbered, "id").select(
        F.col("shingle").alias("bucket"), "node", "component", "about", "place"), "prefixes")


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of ``prefixes`` that hold every link between two components.

    Where two sets meet first, what follows in both must still make up the shared shingles that the similarity asks for.
    """
    other = members.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("node", "component", "about", "place")])
    left = 1 + F.least(F.col("about.n") - F.col("place"), F.col("_about.n") - F.col("_place"))
    return members.join(other, "bucket").where(
        (F.col("node") < F.col("_node")) & (F.col("component") != F.col("_component"))
        & (left * (100 + percent) >= percent * (F.col("about.n") + F.col("_about.n")))
        & may_link(F.col("about"), F.col("_about"), percent)).select(
        F.col("node").alias("a"), F.col("_node").alias("b")).distinct()


def _nodes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text")


def near_duplicates(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document ``doc_id, node, n_shingles, component_id, stays``.

    Links have at least ``percent`` per cent Jaccard similarity of their sets of ``size``-word shingles;
    ``component_id`` is the smallest id that links reach. ``node`` is the digest of the text; ``stays`` marks the
    rows of one id and text per component.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = staged(_nodes(documents).mapInArrow(
        lambda batches: _sign(batches, size), f"doc_id {id_type}, node binary, n_shingles bigint, bands array<bigint>"), "signatures")
    # Ids before no id.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    nodes = staged(rows.where("n_shingles > 0").groupBy("node").agg(
        F.min(place).alias("first"), F.first("bands").alias("bands")), "nodes")
    crowded = crowded_members(nodes.select(F.explode("bands").alias("bucket"), "node"))

    # Full sets of the texts that share a bucket, made once; a row of a repeated text each.
    holders = nodes.join(crowded.select("node").distinct(), "node", "left_semi").select(
        F.col("node").alias("_node"), F.col("first.doc_id").alias("_doc"))
    held = _nodes(documents).join(
        holders, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).dropDuplicates(["node", "doc_id"])
    sets = staged(held.select("node", "text").mapInArrow(
        lambda batches: _sets(batches, size), "node binary, shingles array<bigint>, odd array<bigint>"), "sets")
    members = staged(crowded.join(sets.select(
        "node", F.struct(F.size("shingles").alias("n"), "odd").alias("about")), "node"), "members-about")

    def verify(pairs):
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
        common = F.size(F.array_intersect("_a", "_b"))
        return both.where(common * (100 + percent) >= percent * (F.size("_a") + F.size("_b"))).select("a", "b")

    components = link_members(
        members, verify, lambda left, right: may_link(left, right, percent),
        narrow=lambda mixed: prefixes(mixed, sets, percent), narrow_pairs=lambda finer: prefix_pairs(finer, percent))
    linked = labels_of(components, nodes.select("node", F.col("first").alias("least")), "least")
    labels = staged(nodes.join(linked, "node", "left").select("node", F.coalesce("least", "first").alias("least")), "labels")
    # Empty texts are no nodes: each is its own component.
    empty = F.col("n_shingles") == 0
    return rows.join(labels, "node", "left").select(
        "doc_id", "node", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (empty | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node")))).alias("stays"))


def documents_query(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns; a repeated row or id stays once."""
    found = near_duplicates(documents, size, percent).where("stays").select(
        F.col("doc_id").alias("_doc"), F.col("node").alias("_kept")).distinct()
    marked = documents.withColumn("_node", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = marked.join(found, (F.col("_node") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_node"]).drop("_node")
