"""Language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary. A language is a probability per piece; the likelihood of a word sums
over all its segmentations by a forward pass, and that of a text is the product over its words. Words are runs
of letters, lower-cased, with the vocabulary's mark for a word's start.

Piece counts come from a bounded sample of labelled rows per language (``TRAIN_ROWS``, chosen by a hash of the
id), so they fit the driver whatever the input: vocabulary size times languages. Prediction reads whole texts in
place, without a shuffle.

A text that is null or has no letter, and every text when no language was learned, is ``und`` with score 0.
Ties go to the first language in order. Repeated rows get equal results. Null ids count as the empty id.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
TRAIN_ROWS = 2000
SMOOTHING = 0.1
# Of a character that no piece covers, in every language.
STRAY_CHARACTER = 1e-8
# Longer words are scored on their own, with rescaling.
BLOCK_CHARACTERS = 40
CACHED_WORDS, LASTING_WORDS = 600_000, 200_000
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    # One row per piece, one column per language.
    probabilities: np.ndarray


def _count_pieces(batches, vocabulary: str):
    import sentencepiece

    splitter = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        langs, pieces, counts = [], [], []
        for lang, own in words.items():
            total: Counter = Counter()
            for ids, n in zip(splitter.encode(list(own), num_threads=1), own.values()):
                for i in ids:
                    total[i] += n
            langs += [lang] * len(total)
            pieces += total.keys()
            counts += total.values()
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.int32()), pa.array(counts, pa.int64())],
                                         names=["lang", "piece", "n"])


def train(labelled: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS, smoothing: float = SMOOTHING) -> Model:
    """Learn from ``doc_id, text, lang``; about ``rows`` rows of each language, all if there are fewer."""
    import sentencepiece

    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = usable.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.join(F.broadcast(per_lang), "lang").where(place < share).select("lang", "text")
    counts = sample.mapInArrow(lambda b: _count_pieces(b, vocabulary), "lang string, piece int, n bigint").groupBy(
        "lang", "piece").agg(F.sum("n").alias("n")).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    # Control and byte pieces stand for no characters.
    chosen = [i for i in range(processor.get_piece_size()) if not (
        processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
    place_of = {piece: row for row, piece in enumerate(chosen)}
    languages = sorted({r["lang"] for r in counts})
    column_of = {lang: i for i, lang in enumerate(languages)}
    table = np.full((len(chosen), len(languages)), smoothing)
    for r in counts:
        if r["piece"] in place_of:
            table[place_of[r["piece"]], column_of[r["lang"]]] += r["n"]
    return Model(languages, [processor.id_to_piece(i) for i in chosen], table / table.sum(axis=0) if len(languages) else table)


class Scorer:
    """Log-likelihoods of words; made once per task."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    # Keeps products of small probabilities away from zero; taken off again in the logarithm.
    GAIN = 16.0

    def __init__(self, model: Model):
        self.model = model
        self.longest = max(map(len, model.pieces))
        self.row_of = {p: i for i, p in enumerate(model.pieces)}
        hashes = np.array([self._hash_of(p) for p in model.pieces], np.uint64)
        order = np.argsort(hashes)
        self._hashes, self._rows = hashes[order], order.astype(np.int64)
        self._maybe = np.zeros(1 << 22, bool)
        self._maybe[hashes >> np.uint64(42)] = True
        self.powers = np.multiply.accumulate(np.array([1] + [self.BASE] * (BLOCK_CHARACTERS + 1), np.uint64))
        lengths = np.array([len(p) for p in model.pieces])
        self._gained = model.probabilities * (self.GAIN ** lengths)[:, None]
        self.row_at: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)))

    @staticmethod
    def _mixed(codes: np.ndarray) -> np.ndarray:
        mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))

    def _hash_of(self, piece: str) -> np.uint64:
        total = np.zeros(1, np.uint64)
        for code in self._mixed(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)):
            total = total * self.BASE + code
        return total[0]

    def _block(self, words: list[str]) -> np.ndarray:
        """Forward pass over many words at once, sorted by length: at each place only the words that reach it."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        width = int(lengths[0])
        flat = np.frombuffer("".join(words[i].ljust(width, "\0") for i in order).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self._mixed(flat.reshape(len(words), width).astype(np.uint64))
        prefix = np.zeros((width + 1, len(words)), np.uint64)
        for j in range(width):
            prefix[j + 1] = prefix[j] * self.BASE + codes[:, j]
        forward = np.zeros((width + 1, len(words), self._gained.shape[1]))
        forward[0] = 1.0
        for end in range(1, width + 1):
            alive = int(np.searchsorted(-lengths, -end, side="right"))
            for size in range(1, min(self.longest, end) + 1):
                keys = prefix[end, :alive] - prefix[end - size, :alive] * self.powers[size]
                hits = np.flatnonzero(self._maybe[keys >> np.uint64(42)])
                if len(hits):
                    at = np.searchsorted(self._hashes, keys[hits])
                    real = self._hashes[np.minimum(at, len(self._hashes) - 1)] == keys[hits]
                    hits, rows = hits[real], self._rows[at[real]]
                    forward[end, hits] += forward[end - size, hits] * self._gained[rows]
                if size == 1:
                    stray = np.ones(alive, bool)
                    stray[hits] = False
                    forward[end, :alive][stray] += forward[end - 1, :alive][stray] * (STRAY_CHARACTER * self.GAIN)
        out = np.empty((len(words), self._gained.shape[1]))
        out[order] = np.log(forward[lengths, np.arange(len(words))]) - (lengths * np.log(self.GAIN))[:, None]
        return out

    def _single(self, word: str) -> np.ndarray:
        """Forward pass over one word of any length."""
        window = [np.ones(self._gained.shape[1])]
        scale = np.zeros(self._gained.shape[1])
        for end in range(1, len(word) + 1):
            total = np.zeros(self._gained.shape[1])
            for size in range(1, min(self.longest, len(window)) + 1):
                row = self.row_of.get(word[end - size:end])
                if row is not None:
                    total += window[-size] * self.model.probabilities[row]
                elif size == 1:
                    total += window[-1] * STRAY_CHARACTER
            window.append(total)
            if len(window) > self.longest:
                del window[0]
            # All places of the window share one factor per language.
            top = np.max(window, axis=0)
            scale += np.log(top)
            window = [w / top for w in window]
        return np.log(window[-1]) + scale

    def _learn(self, words: list[str]) -> None:
        first = len(self.row_at) + 1
        if first + len(words) > len(self.scores):
            grown = np.zeros((max(2 * len(self.scores), first + len(words)), self.scores.shape[1]))
            grown[:len(self.scores)] = self.scores
            self.scores = grown
        marked = [_START + w for w in words]
        short = [i for i, w in enumerate(marked) if len(w) <= BLOCK_CHARACTERS]
        for start in range(0, len(short), 8192):
            some = short[start:start + 8192]
            self.scores[[first + i for i in some]] = self._block([marked[i] for i in some])
        for i, w in enumerate(marked):
            if len(w) > BLOCK_CHARACTERS:
                self.scores[first + i] = self._single(w)
            if not any(map(str.isalpha, words[i])):
                self.scores[first + i] = 0
        self.row_at.update(zip(words, range(first, first + len(words))))

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.row_at) > CACHED_WORDS:
            # Frequent words were seen first.
            self.row_at = dict(islice(self.row_at.items(), LASTING_WORDS))
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        places = [list(map(self.row_at.get, words)) for words in found]
        unseen = {w for words, rows in zip(found, places) if None in rows for w, r in zip(words, rows) if r is None}
        if unseen:
            self._learn(sorted(unseen))
        names, certain = [], []
        for words, rows in zip(found, places):
            if not self.model.languages or not any(any(map(str.isalpha, w)) for w in words):
                names.append(UNKNOWN)
                certain.append(0.0)
                continue
            if None in rows:
                rows = list(map(self.row_at.__getitem__, words))
            total = self.scores[rows].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(np.argmax(odds))
            names.append(self.model.languages[best])
            certain.append(float(odds[best] / odds.sum()))
        return names, certain


def predict(documents: DataFrame, model: Model, language: str = "lang_pred", certainty: str = "score") -> DataFrame:
    """``documents`` with the columns ``language`` and ``certainty``; only the text is looked at."""
    documents = documents.drop(language, certainty)
    schema = T.StructType([*documents.schema.fields, T.StructField(language, T.StringType()), T.StructField(certainty, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                names, certain = scorer.texts(part.column("text").to_pylist())
                added = [pa.array(names, pa.string()), pa.array(certain, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], schema=arrow)

    return documents.mapInArrow(score, schema)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def learned_from(documents: DataFrame, vocabulary: str | None = None) -> Model:
    """The model that the rows outside the held-out quarter give."""
    return train(documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), vocabulary or _vocabulary())


def documents_query(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    model = learned_from(documents, vocabulary)
    found = predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(documents: DataFrame, vocabulary: str | None = None, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised with a score of ``least`` or more, with all their columns."""
    found = predict(documents, learned_from(documents, vocabulary), "_language", "_certainty")
    return found.where((F.col("_language") != UNKNOWN) & (F.col("_certainty") >= least)).select(*documents.columns)
