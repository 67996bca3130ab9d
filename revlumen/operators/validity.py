"""Alias fallback, number coercion, row validation and keep-first dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlumen.functions.timeutil import parse_ts
from revlumen.schema import (
    OPTIONAL_TEXT_FIELDS, PLATFORMS, SENTIMENTS, SEVERITIES, blank_to_null, require,
)
from revlumen.session import written

# Field <- alias, and the integer prefix of a numeric string.
ALIASES = {"review_id": "id", "review_created_at": "date", "user_name": "author"}
TEXT_FIELDS = ("review_id", "content", "platform", *OPTIONAL_TEXT_FIELDS, *ALIASES.values())
REQUIRED = {"review_id": "string", "content": "string", "score": "bigint"}
LEADING_INTEGER = r"^\s*([+-]?\d+)"
EMBEDDING_TOKENS_PER_REVIEW = 55
EMBEDDING_USD_PER_MILLION_TOKENS = 0.02


def leading_integer(value: Column) -> Column:
    """Integer prefix of a string ("4.7" -> 4, "5 stars" -> 5), else null."""
    return F.nullif(F.regexp_extract(value, LEADING_INTEGER, 1), F.lit("")).try_cast("bigint")


def _is_variant(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.VariantType)


def _variant_text(name: str) -> tuple[Column, Column]:
    """(value, is a proper string or absent) of a VARIANT column."""
    kind = F.schema_of_variant(F.col(name))
    return (F.when(kind == "STRING", F.try_variant_get(F.col(name), "$", "string")),
            F.col(name).isNull() | (kind == "STRING"))


def _variant_number(name: str) -> tuple[Column, Column]:
    """(integer value, is an integer, a string or absent) of a VARIANT column."""
    kind = F.schema_of_variant(F.col(name))
    number = F.try_variant_get(F.col(name), "$", "double")
    is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    text = F.try_variant_get(F.col(name), "$", "string")
    value = (F.when(kind == "STRING", leading_integer(text))
             .when(is_number & (number % 1 == 0), number.try_cast("bigint")))
    return value, F.col(name).isNull() | (kind == "STRING") | is_number


def normalize(df: DataFrame) -> DataFrame:
    """Fill aliases and coerce numbers; keep what is needed to judge the row.

    Adds ``_bad_types`` (names of fields holding a value of the wrong type)
    for ``validate``. Columns that the layout does not know pass through.
    """
    values: dict[str, Column] = {}
    present: dict[str, Column] = {}
    bad: list[Column] = []
    for name in df.columns:
        if name in ("score", "thumbs_up_count"):
            if _is_variant(df, name):
                values[name], proper = _variant_number(name)
                bad.append(F.when(~proper, F.lit(name)))
            elif isinstance(df.schema[name].dataType, T.StringType):
                values[name] = leading_integer(F.col(name))
            else:
                values[name] = F.when(F.col(name) % 1 == 0, F.col(name).try_cast("bigint"))
            present[name] = F.col(name).isNotNull()
        elif _is_variant(df, name) and name in TEXT_FIELDS:
            values[name], proper = _variant_text(name)
            bad.append(F.when(~proper, F.lit(name)))
        else:
            values[name] = F.col(name)

    for name, dtype in REQUIRED.items():
        values.setdefault(name, F.lit(None).cast(dtype))
    for field, alias in ALIASES.items():
        if alias in values:
            own = values.get(field, F.lit(None).cast("string"))
            values[field] = F.coalesce(blank_to_null(own), values[alias], own)

    # A required or counted field that was given but holds no integer is bad.
    bad.append(F.when(values["score"].isNull(), F.lit("score")))
    if "thumbs_up_count" in values:
        bad.append(F.when(present["thumbs_up_count"] & values["thumbs_up_count"].isNull(),
                          F.lit("thumbs_up_count")))
    fields = [value.alias(name) for name, value in values.items()]
    return df.select(*fields, F.array_distinct(F.array_compact(F.array(*bad))).alias("_bad_types"))


def invalid_reasons(df: DataFrame) -> Column:
    """Array of the names of the fields that break the row's contract."""
    checks = [
        F.when(F.col("review_id").isNull(), F.lit("review_id")),
        F.when(F.col("content").isNull(), F.lit("content")),
        F.when(~F.coalesce(F.col("score").between(1, 5), F.lit(False)), F.lit("score")),
    ]
    if "thumbs_up_count" in df.columns:
        checks.append(F.when(F.col("thumbs_up_count") < 0, F.lit("thumbs_up_count")))
    if "platform" in df.columns:
        checks.append(F.when(~F.col("platform").isin(*PLATFORMS), F.lit("platform")))
    reasons = F.array_compact(F.array(*checks))
    if "_bad_types" in df.columns:
        reasons = F.array_union(reasons, F.col("_bad_types"))
    return F.array_sort(F.array_distinct(reasons))


def validate(df: DataFrame) -> DataFrame:
    """Add ``invalid_reasons``; an empty array marks a valid row. No shuffle."""
    checked = df.withColumn("invalid_reasons", invalid_reasons(df))
    return checked.drop("_bad_types")


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("invalid_reasons") == 0).drop("invalid_reasons")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("invalid_reasons") > 0)


def keep_first(df: DataFrame, key: str = "review_id", order: str = "seq") -> DataFrame:
    """First row per key in input order.

    ``row_number() = 1`` is limited per map task before the shuffle, so a key
    that holds a third of all rows sends one row per task.
    """
    first = W.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def keep_first_by_lookup(df: DataFrame, key: str = "review_id", order: str = "seq") -> DataFrame:
    """``keep_first`` that decides on (key, order) pairs alone.

    The pairs to drop are found on two narrow columns and written once; the
    rows then leave out those pairs. Spark knows the size of the written list
    and ships it to the rows where it is small. A pair is unique, so no key is
    hot in that join. Reads the input twice. Keys must not be null.
    """
    pairs = df.select(key, order)
    repeated = pairs.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    dropped = written(pairs.join(repeated, key).where(F.col(order) != F.col("_first")).select(key, order), "repeated")
    return df.join(dropped, [key, order], "left_anti").select(*df.columns)


def to_raw_reviews(df: DataFrame) -> DataFrame:
    """Valid rows with typed columns and the parsed ``review_ts``."""
    typed = df.withColumn("score", F.col("score").cast("int"))
    if "review_ts" not in df.columns and "review_created_at" in df.columns:
        typed = typed.withColumn("review_ts", parse_ts(F.col("review_created_at")))
    return typed


def import_diagnostics(checked: DataFrame, key: str = "review_id") -> DataFrame:
    """One row of import counters over the validated (not yet deduped) frame.

    ``filtered_spam`` counts invalid and duplicate rows; the name is kept for
    users of existing reports. Rows are counted per key first, so distinct
    keys need no second shuffle of the rows and no hot key reaches one task.
    """
    flagged = checked.select(
        F.when(F.size("invalid_reasons") == 0, F.col(key)).alias("_key"),
        (F.size("invalid_reasons") > 0).alias("_bad"),
    )
    per_key = flagged.groupBy("_key", "_bad").agg(F.count("*").alias("n"))
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews_input"),
        F.coalesce(F.sum(F.when(F.col("_bad"), F.col("n"))), F.lit(0)).alias("invalid_rows_dropped"),
        F.coalesce(F.sum(F.when(~F.col("_bad"), F.col("n") - 1)), F.lit(0)).alias("duplicates_dropped"),
        F.count_if(~F.col("_bad")).alias("total_processed"),
    )
    spam = F.col("total_reviews_input") - F.col("total_processed")
    cost = (F.col("total_processed") * EMBEDDING_TOKENS_PER_REVIEW / 1000000
            * EMBEDDING_USD_PER_MILLION_TOKENS)
    return totals.select(
        "total_reviews_input", "invalid_rows_dropped", "duplicates_dropped",
        spam.alias("filtered_spam"),
        F.when(F.col("total_reviews_input") > 0, spam / F.col("total_reviews_input"))
        .otherwise(0.0).alias("spam_ratio"),
        "total_processed", cost.alias("cost_estimate_usd"),
    )


def analytics_invalid(df: DataFrame) -> Column:
    """True for a row that analytics must not accept."""
    bad = F.lit(False)
    for name in ("review_id", "issue_type", "feature_area"):
        bad = bad | F.col(name).isNull()
    for name, allowed in (("severity", SEVERITIES), ("sentiment", SENTIMENTS)):
        if name in df.columns:
            bad = bad | F.coalesce(~F.col(name).isin(*allowed), F.lit(False))
    if "score" in df.columns:
        bad = bad | F.coalesce(~F.col("score").between(1, 5), F.lit(False))
    return bad


def require_analytics_rows(df: DataFrame) -> DataFrame:
    """Fail the whole request on one bad row; returns ``df`` unchanged."""
    count = df.agg(F.count_if(analytics_invalid(df)).alias("n")).first()["n"]
    require(count == 0, f"{count} rows do not satisfy the analytics contract")
    return df


def not_yet_indexed(new: DataFrame, existing: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows of ``new`` whose key the index does not hold.

    The index side is reduced to its distinct keys first, so copies of one
    key there cannot pile up in one join task.
    """
    return new.join(existing.select(key).distinct(), key, "left_anti")


def append_new(new: DataFrame, index_path: str, key: str = "review_id") -> None:
    """Append the rows that a Parquet index table does not hold yet; the first load finds none.

    One row per key is added. Loads that may be repeated, or that may fail
    half-way, belong in an ``index_table``.
    """
    spark = new.sparkSession
    new = new.dropDuplicates([key])
    folder = spark._jvm.org.apache.hadoop.fs.Path(index_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new.write.parquet(index_path)
        return
    existing = spark.read.parquet(index_path)
    not_yet_indexed(new, existing, key).write.mode("append").parquet(index_path)


def is_valid_embedding(vector: Column, dimensions: int) -> Column:
    """Right length and every component finite."""
    finite = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


