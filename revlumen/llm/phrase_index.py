"""Benchmark decontamination by a positional inverted index. DataFrame functions only.

``build_index`` stores one posting (word, document, position) for every occurrence of a test word, and one row
per document with its length. A window of test words is searched from its rarest terms: the lists of its two
rarest words are shifted by their offsets and intersected; only alignments that survive meet the lists of the
other words. Exact phrase and proximity matches come from the same lists.

A document is known by its id and a hash of its text, so ids may repeat or be null; repeated rows get equal
results. Null and empty texts have no words. Items without words match nothing; a null item id counts as ''.
Clashing extra columns do no harm: only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import ascii_lower, row_hash, staged

WINDOW = 10
# What is left between words before A-Z are folded.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Stands for the end of a document in the index; no word contains it.
END = "\x00"
# Test words are shipped to every task up to this size; larger sets are joined by shuffling.
SHIPPED_BYTES = 64 << 20
KEY = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    """Words in order, A-Z not yet folded; may start and end with an empty string."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1)


def _shipped(df: DataFrame) -> DataFrame:
    """Broadcast a table of test terms if its measured size allows."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= SHIPPED_BYTES else df


def item_words(benchmark: DataFrame) -> DataFrame:
    """``item, item_row, size, at, word`` for each word of each item."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                            row_hash("text").alias("item_row"),
                            F.filter(words_of(F.col("text")), lambda w: w != "").alias("_words")).distinct()
    placed = rows.select("item", "item_row", F.size("_words").alias("size"), F.posexplode("_words").alias("at", "_word"))
    return placed.select("item", "item_row", "size", "at", ascii_lower(F.col("_word")).alias("word"))


def build_index(documents: DataFrame, words: DataFrame) -> DataFrame:
    """Postings ``word, doc_id, text_hash, position`` of all ``words``; the END row of a document holds its length."""
    split = documents.select("doc_id", row_hash("text").alias("text_hash"), words_of(F.col("text")).alias("_words"))
    blanks = (F.get("_words", F.lit(0)) == "").cast("int") + (
        (F.size("_words") > 1) & (F.element_at("_words", -1) == "")).cast("int")
    rows = split.withColumn("_blanks", blanks).select(
        *KEY, "_blanks", F.posexplode(F.concat("_words", F.array(F.lit(END)))).alias("_at", "_raw"))
    tokens = rows.where(F.col("_raw") != "").select(
        *KEY, ascii_lower(F.col("_raw")).alias("word"),
        F.when(F.col("_raw") == END, F.col("_at") - F.col("_blanks")).otherwise(F.col("_at")).alias("position"))
    wanted = words.select("word").distinct().union(words.sparkSession.createDataFrame([(END,)], "word string"))
    return tokens.join(_shipped(wanted), "word", "left_semi").select("word", *KEY, "position")


def rarest_pairs(postings: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, item_row, size, word1, at1, word2, at2``: the two rarest words of every window that can occur."""
    frequency = postings.groupBy("word").count()
    starts = items.where((F.col("at") == 0) | (F.col("at") <= F.col("size") - window)).select(
        "item", "item_row", F.col("at").alias("start"))
    # A window of a short item is the whole item.
    placed = items.select("*", F.explode(F.sequence(F.greatest(F.col("at") - (window - 1), F.lit(0)), F.col("at"))).alias("start"))
    inside = placed.join(starts, ["item", "item_row", "start"], "left_semi").join(frequency, "word", "left")
    ranked = inside.groupBy("item", "item_row", "size", "start").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at"))).alias("_terms"))
    first, second = F.get("_terms", F.lit(0)), F.coalesce(F.get("_terms", F.lit(1)), F.get("_terms", F.lit(0)))
    possible = ranked.where(first["n"] > 0)
    return possible.select("item", "item_row", "size", first["word"].alias("word1"), first["at"].alias("at1"),
                           second["word"].alias("word2"), second["at"].alias("at2")).distinct()


def _lists(postings: DataFrame, pairs: DataFrame, which: int) -> DataFrame:
    """The postings of one word of every pair, shifted to where the item would begin."""
    asked = _shipped(pairs.withColumnRenamed(f"word{which}", "word"))
    return postings.join(asked, "word").select(
        "item", "item_row", "at1", "at2", *KEY, (F.col("position") - F.col(f"at{which}")).alias(f"shift{which}"))


def alignments(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``item, item_row, doc_id, text_hash, shift`` where both rarest words stand at their offsets."""
    pair = ["item", "item_row", "at1", "at2"]
    left = _lists(postings, pairs, 1).withColumnRenamed("shift1", "shift").withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    right = _lists(postings, pairs, 2).withColumnRenamed("shift2", "shift").select(
        *pair, "text_hash", "shift", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"))
    left = left.withColumn("_none", F.col("doc_id").isNull())
    both = left.join(right, [*pair, "_id", "_none", "text_hash", "shift"], "left_semi")
    return both.select("item", "item_row", *KEY, "shift").distinct()


def proximity_matches(postings: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """Where the two rarest words of a window stand at most ``slop`` words nearer or farther than in the item.

    ``item, item_row, doc_id, text_hash, shift, stray``; ``stray`` 0 is an exact alignment of the two words.
    Shifts meet in bins of slop + 1, so a long list is never paired with all of another.
    """
    width = slop + 1
    left = _lists(postings, pairs, 1).withColumn("_bin", F.floor(F.col("shift1") / width))
    near = F.explode(F.array(*[F.floor(F.col("shift2") / width) + d for d in (-1, 0, 1)]))
    right = _lists(postings, pairs, 2).withColumn("_bin", near).withColumnRenamed("doc_id", "_doc")
    met = left.join(right, ["item", "item_row", "at1", "at2", "text_hash", "_bin"]).where(
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.abs(F.col("shift1") - F.col("shift2")) <= slop))
    return met.groupBy("item", "item_row", *KEY, F.col("shift1").alias("shift")).agg(
        F.min(F.abs(F.col("shift1") - F.col("shift2"))).alias("stray"))


def phrase_matches(postings: DataFrame, items: DataFrame, aligned: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches ``item, doc_id, text_hash, first, last``: runs of item words of a window's length or more.

    Every word of an aligned item is looked up at its own place in the list of its word. A run that is long
    enough consists of occurring windows only, so all of it is hit.
    """
    expected = aligned.join(items, ["item", "item_row"]).select(
        "item", "item_row", "size", "at", "word", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "shift",
        (F.col("shift") + F.col("at")).alias("_place"))
    # Lists of words and documents in question only.
    words = _shipped(expected.select("word").distinct())
    texts = expected.select(F.col("_hash").alias("text_hash")).distinct()
    lists = postings.join(words, "word", "left_semi").join(_shipped(texts), "text_hash", "left_semi")
    found = lists.join(expected.withColumnRenamed("word", "_word"),
                       F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
                       & (F.col("position") == F.col("_place")) & (F.col("word") == F.col("_word")))
    found = found.select("item", "item_row", "size", *KEY, "shift", "at").distinct()
    alignment = ["item", "item_row", "size", *KEY, "shift"]
    order = F.row_number().over(W.partitionBy(*alignment).orderBy("at"))
    runs = found.withColumn("_run", F.col("at") - order).groupBy(*alignment, "_run").agg(
        F.min("at").alias("_from"), F.max("at").alias("_to"))
    whole = runs.where(F.col("_to") - F.col("_from") + 1 >= F.least(F.lit(window), F.col("size")))
    return whole.select("item", *KEY, (F.col("shift") + F.col("_from")).alias("first"),
                        (F.col("shift") + F.col("_to")).alias("last"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id, text_hash, n_words, n_hit, items`` (ids sorted as strings)."""
    items = staged(item_words(benchmark), "test-words")
    postings = staged(build_index(documents, items), "postings")
    pairs = staged(rarest_pairs(postings, items, window), "rare-pairs")
    aligned = staged(alignments(postings, pairs), "alignments")
    matches = staged(phrase_matches(postings, items, aligned, window), "phrases")
    places = matches.select(*KEY, F.explode(F.sequence("first", "last")).alias("_place")).distinct()
    hit = places.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = matches.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    lengths = postings.where(F.col("word") == END).select(*KEY, F.col("position").cast("bigint").alias("n_words"))

    def add(left, right):
        renamed = right.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_hash", "_hash")
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
        return left.join(renamed, same, "left").drop("_doc", "_hash")

    return add(add(lengths, hit), named).select(
        *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def documents_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(documents, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark, with all their columns."""
    bad = contamination(documents, benchmark).where("n_hit > 0").select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    kept = documents.withColumn("_own", row_hash("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash"))
    return kept.join(bad, same, "left_anti").drop("_own")
