"""Token ids in binary blocks with Elias-Fano document boundaries.

Documents are laid out by id over shards; each task encodes its documents in order and appends the ids to
blocks. A block is one row of a Parquet table: the concatenated ids as little-endian integers, the ids of its
documents, and where each document ends as an Elias-Fano code, which takes about 2 + log2(mean length) bits a
document and still answers "where does document i end" without decoding the others.

Null and empty texts hold the end id only. Repeated ids are neighbours, ordered by a hash of their text. Null
ids come first. An empty table gives an empty store. A document of any length stays in one block.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import pieces_of, row_hash
from revlumen.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 20
CACHED_PARTS = 1_000_000
LASTING_PARTS = 500_000
SELECT_STEP = 64
# No blank lies beyond this plane's start.
RARE_BLANKS = [c for c in map(chr, range(0x3100)) if c.isspace() and c not in " \n"] + ["\0"]
BLOCK_SCHEMA = ("shard int, block int, shard_start bigint, n_ids bigint, n_docs int, doc_ids array<{id}>, width int, "
                "ends binary, ids binary")


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(largest / count) bits each.

    The low bits are packed; the high bits are counted in unary. ``select`` looks up one value: the place of
    every 64th set bit is kept, so it scans a few words from there.
    """

    HEADER = struct.Struct("<QQB")

    def __init__(self, data: bytes):
        self.count, self.low_bytes, self.low_bits = self.HEADER.unpack_from(data)
        at = self.HEADER.size
        self._low = np.frombuffer(data, np.uint8, self.low_bytes, at)
        at += self.low_bytes
        self._marks = np.frombuffer(data, "<u4", -(-self.count // SELECT_STEP), at)
        self._high = np.frombuffer(data, np.uint8, -1, at + self._marks.nbytes)

    @classmethod
    def encode(cls, values) -> bytes:
        values = np.asarray(values, np.uint64)
        count = len(values)
        low_bits = max(0, int(values[-1] // np.uint64(count)).bit_length() - 1) if count else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
        bits[ones] = 1
        head = cls.HEADER.pack(count, len(low), low_bits)
        return head + low.tobytes() + ones[::SELECT_STEP].astype("<u4").tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def _low_of(self, first: int, count: int) -> np.ndarray:
        start, stop = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self._low[start // 8:-(-stop // 8)], bitorder="little")[start % 8:][:stop - start]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self._marks[i // SELECT_STEP]), i % SELECT_STEP
        byte = place // 8
        left += int(np.unpackbits(self._high[byte:byte + 1], bitorder="little")[:place % 8].sum())
        while True:
            ones = np.flatnonzero(np.unpackbits(self._high[byte:byte + 16], bitorder="little"))
            if left < len(ones):
                high = byte * 8 + int(ones[left]) - i
                return (high << self.low_bits) | int(self._low_of(i, 1)[0])
            left -= len(ones)
            byte += 16

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[:self.count]
        return ((ones - np.arange(self.count)) << self.low_bits) | self._low_of(0, self.count)


class Encoder:
    """A tokenizer that remembers the parts it has seen.

    A byte-level tokenizer that splits by its usual pattern begins a new part at every single blank between two
    other characters, so the ids of a text are the ids of these parts in a row. Other tokenizers, and texts that
    hold a special token's name, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.by_parts = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                         and not spec.get("normalizer"))
        self.named = [t["content"] for t in spec.get("added_tokens", [])]
        line_break = self.tokenizer.encode("\n", add_special_tokens=False)
        self.line_break, self._break = line_break.ids[-1:], self._packed(line_break)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.parts: dict[str, bytes] = {}

    _CUT = re.compile(r"(?<=\S)(?=\s\S)")
    _PIECES = re.compile(r"(\n?)( ?[^\W\d_]+)([.,!|#$%&*;:?]*)")

    def _cut(self, text: str) -> list[str]:
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        # As many words as parts: single blanks or line breaks only. Other texts are cut by the general rule.
        simple = len(parts) == len(text.split()) and not any(blank in text for blank in RARE_BLANKS)
        return parts if simple else self._CUT.split(text)

    def _learn(self, unseen: set[str]) -> None:
        """Encode parts, those of plain letters many at a time.

        A line break, letters and the marks after them are separate pieces: the part takes the ids of each.
        """
        pieces = {p: m.groups() for p in unseen if (m := self._PIECES.fullmatch(p))}
        stems = {s for m in pieces.values() for s in m if s}.difference(self.parts)
        self._encode_lines(list(stems - {"\n"}))
        self.parts["\n"] = self._break
        known = self.parts
        known[""] = b""
        known.update((p, known[a] + known[b] + known[c]) for p, (a, b, c) in pieces.items() if p not in known)
        for part in unseen.difference(pieces):
            known[part] = self._packed(self.tokenizer.encode(part, add_special_tokens=False))

    def _encode_lines(self, parts: list[str]) -> None:
        """A line break is a token of its own between parts without blanks inside, so one text holds many parts."""
        for start in range(0, len(parts), 4096):
            some = parts[start:start + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            breaks = np.flatnonzero(ids == self.line_break)
            if len(breaks) != len(some) - 1:
                raise ValueError("the tokenizer joins line breaks with other characters")
            raw, bounds = ids.tobytes(), (breaks * 4).tolist()
            self.parts.update((p, raw[b:e]) for p, b, e in zip(some, [0, *[b + 4 for b in bounds]], [*bounds, len(raw)]))

    @staticmethod
    def _packed(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        cut = [None if not t else self._cut(t) if self.by_parts and not any(n in t for n in self.named) else t for t in texts]
        if len(self.parts) > CACHED_PARTS:
            # Frequent parts were seen first.
            self.parts = dict(islice(self.parts.items(), LASTING_PARTS))
        known, out = self.parts, []
        found = [list(map(known.get, c)) if isinstance(c, list) else None for c in cut]
        gaps = [[i for i, ids in enumerate(f) if ids is None] if f is not None else [] for f in found]
        unseen = {c[i] for c, g in zip(cut, gaps) for i in g}
        if unseen:
            self._learn(unseen)
        for c, f, g in zip(cut, found, gaps):
            if c is None:
                out.append(b"")
            elif f is None:
                out.append(self._packed(self.tokenizer.encode(c, add_special_tokens=False)))
            else:
                for i in g:
                    f[i] = known[c[i]]
                out.append(b"".join(f))
        return out


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _write_blocks(batches, path: str, end_id: int, block_ids: int):
    encoder, shard = _encoder(path), TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    held, docs, ends, size, start, number = [], [], [], 0, 0, 0

    def block():
        width = encoder.width
        ids = np.frombuffer(b"".join(held), "<u4").astype(f"<u{width}").tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
            pa.array([size], pa.int64()), pa.array([len(docs)], pa.int32()), pa.array([docs], pa.list_(id_type)),
            pa.array([width], pa.int32()), pa.array([EliasFano.encode(ends)], pa.binary()), pa.array([ids], pa.binary())],
            names=["shard", "block", "shard_start", "n_ids", "n_docs", "doc_ids", "width", "ends", "ids"])

    id_type = None
    for batch in batches:
        id_type = batch.column("doc_id").type
        for first in range(0, len(batch), 512):
            part = batch.slice(first, 512)
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                held.append(ids + end)
                docs.append(doc)
                size += len(held[-1]) // 4
                ends.append(size)
                if size >= block_ids:
                    yield block()
                    held, docs, ends, start, size, number = [], [], [], start + size, 0, number + 1
    if docs:
        yield block()


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None,
                block_ids: int = BLOCK_IDS) -> None:
    """Encode ``doc_id, text`` and write blocks in ascending id order to ``path``.

    Shards follow ranges of the id, so shard, block and place in the block give the global order.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    laid = documents.select("doc_id", "text", row_hash("text").alias("_tie")).repartitionByRange(
        pieces_of(documents.sparkSession, shards), *order).sortWithinPartitions(*order).drop("_tie")
    blocks = laid.mapInArrow(lambda batches: _write_blocks(batches, tokenizer, end_id, block_ids), BLOCK_SCHEMA.format(id=id_type))
    blocks.write.option("compression", "zstd").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, how many ids all blocks before hold. One row per shard meets in the sum."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_offset"))
    return blocks.join(F.broadcast(offsets), "shard").withColumn("start", F.col("_offset") + F.col("shard_start")).drop("_offset")


def document_of(block, i: int) -> np.ndarray:
    """Ids of the i-th document of a block row; two lookups in the boundaries."""
    bounds = EliasFano(bytes(block["ends"]))
    begin = bounds.select(i - 1) if i else 0
    return np.frombuffer(block["ids"], f"<u{block['width']}")[begin:bounds.select(i)]


def _describe(batches):
    for batch in batches:
        docs, starts, counts, sums = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("doc_ids", "width", "ends", "ids", "start")]
        for ids_of, width, ends, ids, start in zip(*columns):
            raw = np.frombuffer(ids, f"<u{width}").astype("<u4")
            ends = EliasFano(ends).values()
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            docs += ids_of
            starts.append(start + begins)
            counts.append(ends - begins)
            sums += [zlib.crc32(raw[b:e]) for b, e in zip(begins.tolist(), ends.tolist())]
        join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, batch.schema.field("doc_ids").type.value_type), join(starts), join(counts), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def describe(blocks: DataFrame) -> DataFrame:
    """Per document, from the stored blocks: ``doc_id, start, n_tokens, ids_crc32`` (of 32-bit ids)."""
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("doc_ids", "width", "ends", "ids", "start").mapInArrow(
        _describe, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def documents_query(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the store to the shared folder and describe what was read back."""
    import uuid

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    spark = documents.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(documents, path, tokenizer)
    return describe(open_store(spark, path))
