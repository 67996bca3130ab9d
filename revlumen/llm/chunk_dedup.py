"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text; its lowest 16 bits depend on the last 16 bytes only. A chunk ends
where they fall below a bar, unless another such place lies within the 12 bytes before. Whether a place is a cut
thus depends on the 28 bytes around it and on nothing else, so an insertion moves no cut further on. Chunks take
36 bytes on average.

A chunk whose digest occurs more than once is repeated, and a run of neighbouring repeated chunks that is long
enough is a repeated passage. The occurrence in the least document, there the first, stays; the others can be
taken out. The digest has 64 bits: chance alone makes no run of several chunks.

Null and empty texts have no chunks. A document is its id and a hash of its text, so rows that share both count
as one document. Null ids sort before all others. Extra columns are kept by ``without_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import row_hash, staged

SEED = 17
WINDOW = 16
LEAST_CHUNK, MOST_CHUNK = 12, 1024
BAR = (1 << 16) // 18
# Bytes of neighbouring repeated chunks that make a passage.
LEAST_RUN = 96
BLOCK_BYTES = 4 << 20
KEY = ["doc_id", "text_hash"]


class Chunker:
    """Cuts and digests of many texts at once."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.gear = rng.integers(0, 1 << 16, 256, dtype=np.uint16)
        self.letters = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))

    def _powers(self, base: np.uint64, count: int) -> np.ndarray:
        factors = np.full(count, base, np.uint64)
        factors[:1] = 1
        return np.multiply.accumulate(factors)

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Ends of all chunks of the texts that ``bounds`` delimits in ``data``."""
        rolled = self.gear[data]
        # Doubling: after step s, a value covers the last 2s bytes, each shifted by its distance.
        step = 1
        while step < WINDOW:
            rolled[step:] += rolled[:-step] << np.uint16(step)
            step *= 2
        inner = np.flatnonzero(rolled < BAR) + 1
        # A text knows nothing of the one before it, and no character is cut in two.
        begins = bounds[np.searchsorted(bounds, inner, side="right") - 1]
        inner = inner[(inner - begins >= WINDOW) & (inner < len(data))]
        inner = inner[(data[inner] & 0xC0) != 0x80]
        begins = bounds[np.searchsorted(bounds, inner, side="right") - 1]
        before = np.concatenate([[-LEAST_CHUNK], inner[:-1]])
        inner = inner[(inner - np.maximum(before, begins)) >= LEAST_CHUNK]
        ends = np.union1d(inner, bounds[1:])
        # Stretches without any cut end at every MOST_CHUNK bytes.
        starts = np.concatenate([[0], ends[:-1]])
        extra = [np.arange(s + MOST_CHUNK, e, MOST_CHUNK) for s, e in zip(starts, ends) if e - s > MOST_CHUNK] if (
            (ends - starts).max(initial=0) > MOST_CHUNK) else []
        if extra:
            forced = np.concatenate(extra)
            while (split := (data[forced] & 0xC0) == 0x80).any():
                forced = forced - split
            ends = np.union1d(ends, forced)
        return ends[ends > 0]

    def digests(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial digests of the chunks, by differences of one running sum."""
        values = self.letters[data] * self._powers(self.base, len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        starts = np.concatenate([[0], ends[:-1]])
        raw = (sums[ends] - sums[starts]) * self._powers(self.back, len(data) + 1)[starts]
        raw = (raw ^ (ends - starts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        raw ^= raw >> np.uint64(29)
        raw *= np.uint64(0xBF58476D1CE4E5B9)
        return (raw ^ (raw >> np.uint64(32))).view(np.int64)

    def chunks(self, texts: list[bytes]):
        """Per chunk: its text, where it starts and its size (code points), its bytes and its digest."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(data):
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        ends = self.cuts(data, np.unique(bounds))
        starts = np.concatenate([[0], ends[:-1]])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        owner = np.searchsorted(bounds, starts, side="right") - 1
        return owner, points[starts] - points[bounds[owner]], points[ends] - points[starts], ends - starts, self.digests(data, ends)


def _chunk_rows(batches):
    chunker = Chunker()
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column("text").to_pylist()]
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK_BYTES):
                size += len(texts[last])
                last += 1
            owner, start, points, octets, digest = chunker.chunks(texts[first:last])
            at = pa.array(owner + first)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(start.astype(np.int32)),
                pa.array(points.astype(np.int32)), pa.array(octets.astype(np.int32)), pa.array(digest)],
                names=[*KEY, "start", "size", "octets", "digest"])
            first = last


def chunk_table(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, size, octets, digest`` of every chunk; start and size in code points."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", row_hash("text").alias("text_hash"), "text").mapInArrow(
        _chunk_rows, f"doc_id {id_type}, text_hash bigint, start int, size int, octets int, digest bigint")


def repeated_chunks(chunks: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """Chunks of repeated passages: ``doc_id, text_hash, start, size, run, first_doc, late``.

    ``run`` numbers the passages of a document; ``late`` chunks have an earlier occurrence. Digests are counted
    before rows meet, so a passage that very many documents share is no hot group there; the join back can be split.
    The chunks found are gathered once by document, as a set that map tasks combine: rows that repeat a document
    add nothing, and a set holds no more than the chunks of one text.
    """
    place = F.struct("doc_id", "text_hash", "start")
    counted = chunks.groupBy("digest").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    met = chunks.join(counted.select("digest", "_first"), "digest").select(
        *KEY, "start", "size", "octets", F.col("_first.doc_id").alias("first_doc"),
        (~(F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("text_hash") == F.col("_first.text_hash"))
           & (F.col("start") == F.col("_first.start")))).alias("late"))
    met = met.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size", "octets", "first_doc", "late")).alias("_chunks")).select(
        *KEY, F.inline("_chunks"))
    in_text = W.partitionBy(*KEY).orderBy("start")
    breaks = F.coalesce(F.lag(F.col("start") + F.col("size")).over(in_text) != F.col("start"), F.lit(True)).cast("int")
    numbered = met.withColumn("_break", breaks).withColumn("run", F.sum("_break").over(in_text.rowsBetween(W.unboundedPreceding, 0)))
    length = F.sum("octets").over(W.partitionBy(*KEY, "run"))
    return numbered.withColumn("_length", length).where(F.col("_length") >= least_run).drop("_break", "_length", "octets")


def repeated_passages(documents: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """One row per repeated passage: ``doc_id, text_hash, start, end, removed, first_docs``.

    ``removed`` counts the code points with an earlier occurrence; ``first_docs`` are the documents that hold them.
    """
    rows = repeated_chunks(staged(chunk_table(documents), "chunks"), least_run)
    return rows.groupBy(*KEY, "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("size"))), F.lit(0)).alias("removed"),
        F.sort_array(F.collect_set("first_doc")).alias("first_docs")).drop("run")


def documents_query(documents: DataFrame) -> DataFrame:
    """Documents that hold repeated passages, with the passages as ``start:end`` in order; others have no row."""
    found = repeated_passages(documents.select("doc_id", "text"))
    spans = F.transform(F.sort_array(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.groupBy(*KEY).agg(
        F.count("*").alias("n_passages"), F.sum(F.col("end") - F.col("start")).alias("repeated_chars"),
        F.sum("removed").alias("removed_chars"), F.array_join(spans, ",").alias("passages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_docs")))).alias("first_doc_ids")).drop("text_hash")


def _kept_text(text: Column, late: Column) -> Column:
    """``text`` without the spans of ``late`` (sorted start, size)."""
    begins = F.concat(F.array(F.lit(0)), F.transform(late, lambda s: s["start"] + s["size"]))
    ends = F.concat(F.transform(late, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda s: F.substring(text, s["b"] + 1, s["e"] - s["b"])), "")


def without_repeats(documents: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """``documents`` with every passage taken out of ``text`` but its first occurrence."""
    rows = repeated_chunks(staged(chunk_table(documents), "chunks"), least_run).where("late")
    gone = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("_late")).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_late")
    own = documents.withColumn("_own", row_hash("text"))
    met = own.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash")), "left")
    text = F.when(F.col("_late").isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col("_late")))
    return met.withColumn("text", text).select(*documents.columns)
