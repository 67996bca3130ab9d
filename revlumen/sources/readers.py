"""File readers for raw reviews (CSV, JSON array, JSON lines, Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlumen.schema import require

# Known fields of a raw review and their aliases; others pass through.
JSON_FIELDS = (
    "review_id", "id", "content", "score", "platform", "user_name", "author", "thumbs_up_count",
    "review_created_at", "date", "app_version", "device", "os_version", "locale", "reply_content",
    "reply_created_at",
)


def with_input_order(df: DataFrame) -> DataFrame:
    """Add ``seq``: file name, block start and row position, in that order.

    Spark may schedule files in another order than their names, so the file
    comes first; within one block the row id grows with the row's position.
    Ids are unaffected by retries because a scan always splits alike.
    """
    return df.withColumn(
        "seq",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_csv_reviews(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header row; every column stays a string.

    Quotes double inside quoted fields and records may span lines. An
    unquoted empty cell is the empty string, as in the file. A file whose
    records may span lines is one task; ``multi_line=False`` lets large files
    without such records split.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"')
        .option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    )
    ordered = with_input_order(raw)
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns]
    return ordered.select(*cells, "seq")


def read_json_reviews(spark: SparkSession, path: str, extra_fields=(), lines: bool = False) -> DataFrame:
    """A JSON array of objects per file, or one object per line.

    Fields are read as VARIANT, so a number is still told from a string and a
    JSON null from an absent field when rows are validated. An array file is
    one task; write large inputs as lines (``lines=True``), which split.
    """
    fields = ", ".join(f"`{name}` variant" for name in (*JSON_FIELDS, *extra_fields))
    if not lines:
        _require_arrays(spark, path)
    reader = spark.read.schema(fields).option("multiLine", not lines)
    return with_input_order(reader.json(path))


def _require_arrays(spark: SparkSession, path: str) -> None:
    texts = spark.read.option("wholetext", True).text(path)
    bad = texts.where(~F.ltrim(F.col("value"), F.lit(" \t\r\n" + chr(0xFEFF))).startswith("["))
    require(bad.isEmpty(), "a JSON file must hold one array of reviews")


def read_parquet_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Parquet reviews; keeps a ``seq`` column of the file where there is one."""
    df = spark.read.parquet(path)
    return df if "seq" in df.columns else with_input_order(df)
