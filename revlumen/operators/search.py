"""Review search: neighbours joined to metadata, filtered, sorted, limited."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlumen.functions.timeutil import parse_instant, parse_ts
from revlumen.operators.nearest import nearest, with_distance
from revlumen.schema import blank_to_null, optional, require

# Fixed value: default result size.
DEFAULT_LIMIT = 5


@dataclass(frozen=True)
class SearchOptions:
    limit: int = DEFAULT_LIMIT
    min_score: float | None = None
    max_score: float | None = None
    start_date: str | None = None
    end_date: str | None = None
    sort_by: str = "relevance"
    sort_direction: str = "desc"

    def __post_init__(self):
        require(1 <= self.limit <= 100, "limit must be 1..100")
        require(self.sort_by in ("relevance", "date"), "sort_by must be relevance or date")
        require(self.sort_direction in ("asc", "desc"), "sort_direction must be asc or desc")
        if self.min_score is not None and self.max_score is not None:
            require(self.min_score <= self.max_score, "min_score must not exceed max_score")
        bounds = [parse_instant(d) for d in (self.start_date, self.end_date) if d]
        require(all(b is not None for b in bounds), "dates must be valid")
        require(len(bounds) < 2 or bounds[0] <= bounds[1], "start_date must not follow end_date")


def metadata_columns(df: DataFrame, stand_ins: bool = True) -> list[Column]:
    """author, content, score and date of an index row; title and url stand in."""
    author, content = optional(df, "author"), optional(df, "content")
    if stand_ins:
        author = F.coalesce(blank_to_null(author), optional(df, "title"))
        content = F.coalesce(blank_to_null(content), optional(df, "url"))
    date = F.coalesce(blank_to_null(optional(df, "date")), optional(df, "review_created_at"))
    # A stored instant is compared as it is, so that bounds on it reach the scan.
    made = F.col("date_ts") if "date_ts" in df.columns else parse_ts(date)
    return [
        author.alias("author"), content.alias("content"),
        optional(df, "score", "int").alias("score"),
        date.alias("date"), made.alias("_made"),
    ]


def write_index(index: DataFrame, path: str, files: int | None = None) -> None:
    """Store an index by time: ``date_ts`` beside the date, rows sorted by it.

    Row groups then cover short spans of time, so a search between two dates
    reads few of them.
    """
    date = F.coalesce(blank_to_null(optional(index, "date")), optional(index, "review_created_at"))
    dated = index.withColumn("date_ts", parse_ts(date))
    # The id spreads rows of one instant.
    laid = dated.repartitionByRange(*([files] if files else []), "date_ts", F.xxhash64("id")).sortWithinPartitions("date_ts")
    laid.write.mode("overwrite").parquet(path)


def filter_hits(df: DataFrame, options: SearchOptions) -> DataFrame:
    """Score and date bounds; a row without the value fails the bound."""
    ts = F.col("_made")
    if options.min_score is not None:
        df = df.where(F.col("score") >= options.min_score)
    if options.max_score is not None:
        df = df.where(F.col("score") <= options.max_score)
    if options.start_date:
        df = df.where(ts >= F.lit(parse_instant(options.start_date)))
    if options.end_date:
        df = df.where(ts <= F.lit(parse_instant(options.end_date)))
    return df


def _date_order(options: SearchOptions) -> Column:
    """Undated rows count as the epoch."""
    ts = F.coalesce("_made", F.timestamp_seconds(F.lit(0)))
    return ts.desc() if options.sort_direction == "desc" else ts.asc()


def sort_hits(df: DataFrame, options: SearchOptions) -> DataFrame:
    """By relevance, or by date with undated rows at the epoch."""
    if options.sort_by == "relevance":
        return df.orderBy("relevance_rank", "id")
    return df.orderBy(_date_order(options), "relevance_rank", "id")


def _one_query(df: DataFrame, vector) -> DataFrame:
    schema = T.StructType([T.StructField("query_id", T.IntegerType()),
                           T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return df.sparkSession.createDataFrame([(0, [float(x) for x in vector])], schema)


def _dated_hits(rows: DataFrame, vector, options: SearchOptions, metric: str) -> DataFrame:
    """``id, relevance_rank`` of the first matches by date, ranked among all matches.

    One pass finds the hits, at most ``limit`` rows. A second one counts, for
    every hit, the matches that are nearer: each row falls between two hits in
    the order of (distance, id), so it adds one to one of ``limit`` + 1 counts.
    """
    measured = with_distance(rows.select("id", "_made", "embedding"), vector, metric)
    first = measured.orderBy(_date_order(options), "distance", "id").limit(options.limit).select("distance", "id").collect()
    hits = sorted((r["distance"], r["id"]) for r in first)
    schema = T.StructType([rows.schema["id"], T.StructField("relevance_rank", T.LongType())])
    if not hits:
        return rows.sparkSession.createDataFrame([], schema)
    edges = F.array(*[F.struct(F.lit(d).alias("distance"), F.lit(i).cast(rows.schema["id"].dataType).alias("id")) for d, i in hits])
    own = F.struct("distance", "id")
    nearer_than = measured.select(F.size(F.filter(edges, lambda e: own < e)).alias("n")).groupBy("n").count()
    counts = {r["n"]: r["count"] for r in nearer_than.collect()}
    # A row nearer than n hits is nearer than the last n of them.
    ranks = [(i, sum(c for n, c in counts.items() if n >= len(hits) - at)) for at, (_, i) in enumerate(hits)]
    return rows.sparkSession.createDataFrame(ranks, schema)


def search(index: DataFrame, query_vector, options: SearchOptions = SearchOptions(), metric: str = "cosine",
           candidate_limit: int | None = None) -> DataFrame:
    """Nearest index rows that pass the filters.

    Filters run before the ranking in every mode, so no match is lost to a
    row that does not match, and ranks count matching rows. A date sort orders
    all matches; with a ``candidate_limit``, the nearest so many.
    """
    rows = filter_hits(index.select("id", "embedding", *metadata_columns(index)), options)
    if options.sort_by == "date" and candidate_limit is None:
        # At most ``limit`` rows.
        hits = F.broadcast(_dated_hits(rows, query_vector, options, metric))
    else:
        hits = nearest(rows, _one_query(index, query_vector), candidate_limit or options.limit, metric).select("id", "relevance_rank")
    found = rows.drop("embedding").join(hits, "id").withColumn("relevance_rank", F.col("relevance_rank").cast("int"))
    return sort_hits(found, options).limit(options.limit).select("id", "author", "content", "score", "date", "relevance_rank")


def search_metadata(index: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Search without a query: every row ranks 0, then filters, sort, limit."""
    rows = index.select("id", F.lit(0).alias("relevance_rank"), *metadata_columns(index, stand_ins=False))
    return sort_hits(filter_hits(rows, options), options).limit(options.limit).drop("_made")


def attach_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Join hits to a separate metadata table.

    A hit without metadata keeps the ``title`` and ``url`` it came with.
    """
    known = metadata.select("id", *[F.col(c).alias(f"_{c}") for c in metadata.columns if c != "id"])
    joined = hits.join(known, "id", "left")

    def own(name: str) -> Column:
        return optional(joined, f"_{name}", "int" if name == "score" else "string")

    date = F.coalesce(blank_to_null(own("date")), own("review_created_at"))
    return joined.select(
        "id", "relevance_rank", F.coalesce(blank_to_null(own("author")), optional(hits, "title")).alias("author"),
        F.coalesce(blank_to_null(own("content")), optional(hits, "url")).alias("content"),
        own("score").alias("score"), date.alias("date"))


def search_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT_LIMIT, metric: str = "cosine") -> DataFrame:
    """Nearest rows for every query of a table."""
    return nearest(index, queries, k, metric)


def index_status(index: DataFrame) -> DataFrame:
    """Counts and ratios of rows with a score and with a date."""
    date = F.coalesce(blank_to_null(optional(index, "date")), blank_to_null(optional(index, "review_created_at")))
    sums = index.agg(
        F.count("*").alias("total_indexed"),
        F.count_if(optional(index, "score", "int").isNotNull()).alias("score_count"),
        F.count_if(date.isNotNull()).alias("date_count"),
    )
    total = F.col("total_indexed")
    return sums.select(
        "total_indexed", "score_count", "date_count",
        F.when(total > 0, F.col("score_count") / total).otherwise(0.0).alias("has_score"),
        F.when(total > 0, F.col("date_count") / total).otherwise(0.0).alias("has_date"),
        ((total > 0) & (F.col("score_count") > 0)).alias("is_ready"),
    )
