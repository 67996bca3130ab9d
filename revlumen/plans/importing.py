"""Import: normalise, validate, dedupe, count, append."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlumen.operators import validity as V
from revlumen.schema import with_seq


@dataclass(frozen=True)
class ImportResult:
    reviews: DataFrame
    rejected: DataFrame
    diagnostics: DataFrame


def import_reviews(raw: DataFrame, few_duplicates: bool = False) -> ImportResult:
    """Valid unique reviews, the rejected rows with reasons, and the counters.

    ``raw`` comes from ``sources.readers`` or ``spark.createDataFrame``; the
    first row of an id in input order (``seq``) stays. The frames are lazy.
    With ``few_duplicates`` the repeated ids are looked up at once, and whole
    rows are not shuffled to drop their copies.
    """
    checked = V.validate(V.normalize(with_seq(raw)))
    dedupe = V.keep_first_by_lookup if few_duplicates else V.keep_first
    reviews = V.to_raw_reviews(dedupe(V.valid_rows(checked)))
    return ImportResult(reviews, V.rejected_rows(checked), V.import_diagnostics(checked))


def index_rows(reviews: DataFrame, embeddings: DataFrame, dimensions: int) -> DataFrame:
    """Index rows for reviews whose supplied embedding is valid."""
    valid = embeddings.where(V.is_valid_embedding(F.col("embedding"), dimensions))
    return reviews.join(valid.select("review_id", "embedding"), "review_id").select(
        F.col("review_id").alias("id"), "embedding", F.col("user_name").alias("author"), "content", "score",
        F.col("review_created_at").alias("date"))
