"""Registered queries: each operator over whole tables.

Results are flat (structs unfolded, arrays joined), so that any engine can
compare them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlumen.functions.rules import classify, needs_external_label
from revlumen.functions.text import is_low_signal, redact_pii
from revlumen.functions.timeutil import WINDOWS, time_bucket, window_start
from revlumen.operators import calls as calls_ops
from revlumen.operators import change, evaluation, exports, filters, issues, labels, priority, search, themes
from revlumen.operators import validity
from revlumen.plans import alerts, analyze, drilldown, weekly
from revlumen.plans.importing import import_reviews
from revlumen.session import ensure_checkpoint_dir, prepare
from revlumen.sources import event_reviews as source
from revlumen.sources import index_table, readers, store
from revlumen.streaming import reviews as streaming

REFERENCE_DATE = "2024-01-31"
SPLIT_DATE = "2024-01-16"
DIMENSIONS = 64
NOW = "2024-02-01 00:00:00"
BUDGET_USD = 0.5

# Ordered: the second Login/OTP rule must lose to the first where both match.
OWNERSHIP = (
    ("Login/OTP", "Account/Auth", "Identity", "alex"),
    ("Login/OTP", None, "Access", "blake"),
    ("SOS", None, "Safety", "casey"),
    ("Crash Detection", "", "Sensors", "drew"),
    ("Crash Detection", "Performance", "Late", "nobody"),
    ("Bank Linking", "Data/Sync", "Banking", "eli"),
    ("Unknown", "Praise", "Community", "finn"),
)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return source.read_events(prepare(spark), folder)


def _reviews(spark, folder) -> DataFrame:
    return source.reviews_from_events(_events(spark, folder))


def _analyzed(spark, folder) -> DataFrame:
    return analyze.analyze(_reviews(spark, folder))


def _fresh_folder(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _documents(spark, folder) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/documents.parquet")


def _index(spark, folder) -> DataFrame:
    """Embeddings with metadata derived from their own columns."""
    raw = prepare(spark).read.parquet(f"{folder}/embeddings.parquet")
    vec = F.col("vec_id")
    hours = F.timestamp_seconds(F.lit(1704067200) + vec * 3600)
    return raw.select(
        vec.alias("id"), "embedding", "label",
        F.when(vec % 9 != 0, F.concat(F.lit("user-"), "label")).alias("author"),
        F.lit("Review").alias("title"),
        F.concat(F.lit("vector "), vec).alias("content"),
        F.when(vec % 7 != 0, 1 + vec % 5).cast("int").alias("score"),
        F.when(vec % 11 != 0, F.date_format(hours, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
    )


def _query_vector(index: DataFrame) -> list[float]:
    return index.where("id = 0").select("embedding").first()["embedding"]


# -- rows and labels ---------------------------------------------------------

def redact_pii_query(spark, folder):
    docs = _documents(spark, folder)
    return docs.select("doc_id", redact_pii(F.col("text")).alias("redacted"))


def redact_conversations_query(spark, folder):
    turns = prepare(spark).read.parquet(f"{folder}/conversations.parquet")
    return turns.select("conv_id", "turn", redact_pii(F.col("text")).alias("redacted"))


def spam_filter_query(spark, folder):
    docs = _documents(spark, folder)
    return docs.select("doc_id", is_low_signal(redact_pii(F.col("text"))).alias("is_spam"))


def classify_query(spark, folder):
    return classify(_reviews(spark, folder)).select(
        "review_id", "issue_type", "feature_area", "severity", "sentiment", "confidence_score", "is_spam")


def classify_documents_query(spark, folder):
    """The cascade over long texts; the score follows from the id."""
    docs = _documents(spark, folder).select("doc_id", F.col("text").alias("content"),
                                            (1 + F.col("doc_id") % 5).cast("int").alias("score"))
    return classify(docs).select("doc_id", "issue_type", "feature_area", "severity", "sentiment",
                                 "confidence_score", "is_spam")


def routing_query(spark, folder):
    rows = classify(_reviews(spark, folder)).where("not is_spam")
    return rows.select("review_id", needs_external_label(
        F.col("confidence_score"), F.col("feature_area"), F.col("severity")).alias("needs_label"))


def buckets_query(spark, folder):
    return _events(spark, folder).select(
        "event_id", time_bucket(F.col("ts"), "day").alias("day_bucket"),
        time_bucket(F.col("ts"), "week").alias("week_bucket"))


def window_ranges_query(spark, folder):
    """Every named window for every day on which something happened."""
    days = _events(spark, folder).select(F.to_date("ts").alias("reference_date")).distinct()
    rows = F.array(*[F.struct(F.lit(w).alias("window"), window_start(w, F.col("reference_date")).alias("start_date"),
                              F.col("reference_date").cast("string").alias("end_date")) for w in WINDOWS])
    return days.select(F.inline(rows))


# -- import ------------------------------------------------------------------

def _checked(spark, folder) -> DataFrame:
    raw = source.unclean_rows_from_events(_events(spark, folder))
    return validity.validate(validity.normalize(raw))


def normalize_query(spark, folder):
    raw = source.unclean_rows_from_events(_events(spark, folder))
    return validity.normalize(raw).select(
        "seq", "review_id", "score", "thumbs_up_count", "review_created_at", "user_name")


def validate_query(spark, folder):
    return _checked(spark, folder).select("seq", F.array_join("invalid_reasons", ",").alias("invalid_reasons"))


def dedupe_query(spark, folder):
    return validity.keep_first(validity.valid_rows(_checked(spark, folder))).select("review_id", "seq", "score")


def dedupe_lookup_query(spark, folder):
    valid = validity.valid_rows(_checked(spark, folder))
    return validity.keep_first_by_lookup(valid).select("review_id", "seq", "score")


def import_diagnostics_query(spark, folder):
    return validity.import_diagnostics(_checked(spark, folder))


def import_reviews_query(spark, folder):
    """Import, load a part twice, then load everything: each review is there once."""
    reviews = import_reviews(source.unclean_rows_from_events(_events(spark, folder))).reviews
    rows = reviews.select("review_id", F.col("seq").cast("bigint").alias("seq"), "score")
    path = _fresh_folder(spark, "reviews")
    for _ in range(2):
        index_table.load_new(rows.where(F.crc32("review_id") % 2 == 0), path, "first")
    index_table.load_new(rows, path, "second")
    loaded = index_table.read_index(spark, path)
    loaded = rows.limit(0) if loaded is None else loaded
    return loaded.select("review_id", "seq", F.col("score").cast("bigint").alias("score"))


def _file_reviews(spark, folder) -> DataFrame:
    payload = source.store_payload_from_events(_events(spark, folder))
    return store.normalize_payload(payload, "play_store", F.lit(NOW).cast("timestamp"))


def csv_files_query(spark, folder):
    """Reviews written as CSV files, read back and imported."""
    path = _fresh_folder(spark, "csv")
    store.write_reviews_csv(_file_reviews(spark, folder), path)
    reviews = import_reviews(readers.read_csv_reviews(spark, path, multi_line=False)).reviews
    return reviews.select(*store.CSV_COLUMNS)


def json_files_query(spark, folder):
    """Reviews written as JSON lines, read back and imported."""
    path = _fresh_folder(spark, "json")
    _file_reviews(spark, folder).write.json(path)
    reviews = import_reviews(readers.read_json_reviews(spark, path, lines=True)).reviews
    return reviews.select(*store.CSV_COLUMNS)


def analytics_contract_query(spark, folder):
    """Which rows analytics must not accept, over rows with damaged labels."""
    seq = F.col("seq")
    rows = classify(_reviews(spark, folder)).withColumns({
        "severity": F.when(seq % 5 == 1, "P9").when(seq % 5 == 2, None).otherwise(F.col("severity")),
        "feature_area": F.when(seq % 7 != 3, F.col("feature_area")),
        "score": F.when(seq % 11 == 4, 6).otherwise(F.col("score"))})
    return rows.select("review_id", validity.analytics_invalid(rows).alias("invalid"))


def incremental_anti_query(spark, folder):
    """Documents without a vector of the same id."""
    new = _documents(spark, folder).select(F.col("doc_id").alias("review_id"), "n_chars")
    existing = prepare(spark).read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("review_id"))
    return validity.not_yet_indexed(new, existing)


def valid_embeddings_query(spark, folder):
    """Validity of each vector and of derived damaged copies of it."""
    raw = prepare(spark).read.parquet(f"{folder}/embeddings.parquet")
    vec = F.col("vec_id")
    damaged = (F.when(vec % 4 == 1, F.slice("embedding", 1, DIMENSIONS - 1))
               .when(vec % 4 == 2, F.transform("embedding", lambda v: v * F.lit(float("inf"))))
               .when(vec % 4 == 3, F.transform("embedding", lambda v: v / F.lit(2.0)))
               .otherwise(F.col("embedding")))
    return raw.select("vec_id", validity.is_valid_embedding(F.col("embedding"), DIMENSIONS).alias("is_valid"),
                      validity.is_valid_embedding(damaged, DIMENSIONS).alias("damaged_is_valid"))


def store_payload_query(spark, folder):
    payload = source.store_payload_from_events(_events(spark, folder))
    return store.normalize_payload(payload, "play_store", F.lit(NOW).cast("timestamp"))


def store_app_id_query(spark, folder):
    links = source.store_links_from_events(_events(spark, folder))
    return links.select("link_id", *store.app_link_columns(F.col("url")))


# -- analytics ---------------------------------------------------------------

def _flat_issues(df: DataFrame) -> DataFrame:
    return df.drop("severity_breakdown").withColumn("example_review_ids", F.array_join("example_review_ids", ","))


def top_issues_query(spark, folder):
    return _flat_issues(issues.top_issues(_analyzed(spark, folder)))


def top_issues_window_query(spark, folder):
    """The default scope of the tool: this week up to the reference date."""
    scoped = drilldown.scoped_top_issues(_analyzed(spark, folder), REFERENCE_DATE)
    return _flat_issues(scoped).drop("window_applied", "start_date", "end_date")


FILTERS = filters.ReviewFilters(
    start_date="2024-01-08", end_date="2024-01-20T12:00:00Z", severities=["P0", "P1", "P2"],
    sentiments=["Negative", "Neutral"], feature_areas=["Login/OTP", "SOS", "Unknown", "Card Controls"],
    issue_types=["Account/Auth", "Safety Concern", "Trust/Fraud", "Performance", "Support/Service"])


def filter_reviews_query(spark, folder):
    kept = filters.filter_reviews(_analyzed(spark, folder), FILTERS)
    return kept.select("review_id", "issue_type", "feature_area", "severity", "sentiment")


def segment_query(dimension):
    def run(spark, folder):
        return issues.segment_breakdown(_analyzed(spark, folder), dimension)
    return run


def segment_all_query(spark, folder):
    return issues.segment_breakdowns(_analyzed(spark, folder))


def segment_report_query(spark, folder):
    """Segments of critical reviews, and how many were considered."""
    return issues.segment_report(_analyzed(spark, folder), "app_version", 3, filters.ReviewFilters(severities=["P0", "P1"]))


def trend_report_query(spark, folder):
    report = issues.trend_report(_analyzed(spark, folder), "week")
    return report.withColumn("top_issue_keys", F.array_join("top_issue_keys", ","))


def time_trends_query(bucket):
    def run(spark, folder):
        trends = issues.time_trends(_analyzed(spark, folder), bucket)
        return trends.withColumn("top_issue_keys", F.array_join("top_issue_keys", ","))
    return run


def trend_top_keys_query(spark, folder):
    keys = issues.trend_top_keys(issues.bucket_issue_counts(_analyzed(spark, folder), "day"))
    return keys.select("time_bucket", "issue_key", "n", "rank")


def severity_counts_query(spark, folder):
    return issues.severity_counts(_analyzed(spark, folder))


def feature_heatmap_query(spark, folder):
    return issues.feature_heatmap(_analyzed(spark, folder))


def spikes_query(bucket, threshold=2.0):
    def run(spark, folder):
        return change.spikes(_analyzed(spark, folder), bucket, spike_ratio_threshold=threshold)
    return run


def spikes_complete_weeks_query(spark, folder):
    """Spikes of the last complete week."""
    complete = filters.ReviewFilters(end_date="2024-01-28", end_inclusive_day=True)
    return change.spikes(filters.filter_reviews(_analyzed(spark, folder), complete), "week", spike_ratio_threshold=1.0)


def _two_windows(spark, folder):
    rows = _analyzed(spark, folder)
    split = F.lit(SPLIT_DATE).cast("timestamp")
    return rows.where(F.col("review_ts") < split), rows.where(F.col("review_ts") >= split)


def compare_metrics_query(spark, folder):
    return change.compare_metrics(*_two_windows(spark, folder))


def compare_issues_query(spark, folder):
    return change.compare_issues(*_two_windows(spark, folder))


def compare_regressions_query(spark, folder):
    return change.top_regressions(change.compare_issues(*_two_windows(spark, folder)))


def compare_improvements_query(spark, folder):
    return change.top_improvements(change.compare_issues(*_two_windows(spark, folder)))


def priority_scores_query(spark, folder):
    return priority.priority_scores(_analyzed(spark, folder))


def ownership_map_query(spark, folder):
    return priority.ownership_map(_analyzed(spark, folder), priority.ownership_rules(spark, OWNERSHIP))


def _weekly(spark, folder) -> weekly.WeeklyReport:
    return weekly.weekly_report(_analyzed(spark, folder), priority.ownership_rules(spark, OWNERSHIP), examples=False)


def weekly_summary_query(spark, folder):
    return _weekly(spark, folder).summary


def weekly_report_query(spark, folder):
    return weekly.weekly_report_rows(_weekly(spark, folder)).drop("detail")


def top_themes_query(spark, folder):
    return themes.top_themes(_analyzed(spark, folder))


def document_themes_query(spark, folder):
    return themes.top_themes(_documents(spark, folder))


def cluster_reviews_query(spark, folder):
    rows = drilldown.cluster_reviews(
        _analyzed(spark, folder), feature_area=" login/otp ", window="last_30_days", reference_date=REFERENCE_DATE)
    return rows.select("review_id", "issue_type", "feature_area", "severity", "review_created_at")


def cluster_unknown_query(spark, folder):
    rows = drilldown.cluster_reviews(_analyzed(spark, folder), include_unknown_only=True, max_results=500)
    return rows.select("review_id", "issue_type", "feature_area", "severity", "review_created_at")


def cluster_counts_query(spark, folder):
    return drilldown.cluster_counts(
        _analyzed(spark, folder), feature_area="Login/OTP", window="last_30_days", reference_date=REFERENCE_DATE)


def recency_sample_query(spark, folder):
    rows = filters.newest_first(_reviews(spark, folder), analyze.DEFAULT_RECENT_REVIEWS)
    return rows.select("review_id", "review_created_at")


# -- analysis jobs -----------------------------------------------------------

def analyze_query(spark, folder):
    return _analyzed(spark, folder).select(
        "review_id", "text", "review_created_at", "score", "issue_type", "feature_area", "severity", "sentiment",
        "confidence_score", "classification_source", F.col("signals.device").alias("signal_device"),
        F.col("signals.os_version").alias("signal_os_version"),
        F.col("signals.app_version").alias("signal_app_version"))


def _merged(spark, folder) -> DataFrame:
    events = _events(spark, folder)
    return analyze.classify_reviews(source.reviews_from_events(events), source.external_labels_from_events(events))


def hybrid_merge_query(spark, folder):
    return _merged(spark, folder).where("not is_spam").select(
        "review_id", "issue_type", "feature_area", "severity", "classification_source", "needs_label")


def analyze_metadata_query(spark, folder):
    meta = analyze.analyze_metadata(_merged(spark, folder))
    return meta.withColumns({name: F.array_join(name, "|") for name in ("warnings", "degraded_reasons")})


def critical_alerts_query(spark, folder):
    return alerts.critical_alerts(_reviews(spark, folder))


def alert_rows_query(spark, folder):
    return alerts.alert_rows(classify(_reviews(spark, folder)))


def alert_metadata_query(spark, folder):
    meta = alerts.alert_metadata(_reviews(spark, folder))
    return meta.withColumn("warnings", F.array_join("warnings", "|"))


def enrich_query(spark, folder):
    reviews = _reviews(spark, folder)
    bare = analyze.analyze(reviews.drop("platform", "locale", "device"))
    return labels.enrich(bare, reviews, ["platform", "locale", "device"]).select(
        "review_id", "severity", "platform", "locale", "device")


def export_tickets_query(spark, folder):
    fields = exports.tickets(_analyzed(spark, folder))
    return fields.select("review_id", F.col("fields.project.key").alias("project"), "fields.summary",
                         "fields.description", F.col("fields.issuetype.name").alias("issuetype"),
                         "fields.customfield_severity")


def export_markdown_query(spark, folder):
    return exports.markdown_lines(_analyzed(spark, folder))


def golden_labels_query(spark, folder):
    """Label accuracy and safety recall against golden labels derived from the rows, some of them others."""
    rows = classify(_reviews(spark, folder))
    seq = F.col("seq")
    golden = rows.where(seq % 2 == 0).select(
        "review_id", F.when(seq % 10 == 0, "Bug").otherwise(F.col("issue_type")).alias("expected_issue_type"),
        F.when(seq % 8 == 0, "P2").otherwise(F.col("severity")).alias("expected_severity"),
        F.coalesce((F.col("issue_type") == "Safety Concern") & (F.col("severity") == "P0") | (seq % 50 == 0), F.lit(False)).alias("is_safety"))
    return evaluation.golden_evaluation(rows, golden)


def golden_eval_query(spark, folder):
    docs = _documents(spark, folder)
    predicted = docs.select("doc_id", F.when(is_low_signal(redact_pii(F.col("text"))), 0).otherwise(1).alias("kept"))
    golden = prepare(spark).read.parquet(f"{folder}/labels.parquet")
    return evaluation.binary_agreement(predicted, golden, "doc_id", "kept", "quality")


# -- call log ----------------------------------------------------------------

def _calls(spark, folder) -> DataFrame:
    return source.call_log_from_events(_events(spark, folder))


def failure_class_query(spark, folder):
    return calls_ops.failure_counts(_calls(spark, folder))


def token_cost_query(spark, folder):
    return calls_ops.token_cost(_calls(spark, folder))


def call_health_query(spark, folder):
    return calls_ops.call_health(_calls(spark, folder))


def budget_guard_query(spark, folder):
    calls = _calls(spark, folder)
    guarded = calls_ops.budget_guard(calls, BUDGET_USD, [F.col("ts").desc(), F.col("seq").asc()])
    return guarded.select("seq", F.round(F.col("cost_before_usd") * calls_ops.UNITS_PER_USD).cast("bigint")
                          .alias("cost_before_units"), "within_budget")


# -- search ------------------------------------------------------------------

def knn_search_query(spark, folder):
    index = _index(spark, folder)
    return search.search(index, _query_vector(index), search.SearchOptions(limit=20))


def search_filtered_query(spark, folder):
    index = _index(spark, folder)
    options = search.SearchOptions(limit=20, min_score=2, max_score=4, start_date="2024-01-02",
                                   end_date="2024-01-15T00:00:00Z")
    return search.search(index, _query_vector(index), options)


def search_by_date_query(spark, folder):
    index = _index(spark, folder)
    options = search.SearchOptions(limit=20, sort_by="date", sort_direction="asc")
    return search.search(index, _query_vector(index), options)


def search_by_date_nearest_query(spark, folder):
    """Date order of the hundred nearest, where a caller asks for that."""
    index = _index(spark, folder)
    options = search.SearchOptions(limit=20, sort_by="date", sort_direction="asc")
    return search.search(index, _query_vector(index), options, candidate_limit=100)


def search_by_date_filtered_query(spark, folder):
    """The newest matches of a stored index between two dates, with a minimal score."""
    path = _fresh_folder(spark, "index")
    raw = _index(spark, folder)
    search.write_index(raw, path)
    options = search.SearchOptions(limit=50, min_score=2, start_date="2024-01-03", end_date="2024-01-20T12:00:00Z", sort_by="date")
    return search.search(spark.read.parquet(path), _query_vector(raw), options, metric="l2")


def attach_metadata_query(spark, folder):
    """Every vector as a hit, joined to a metadata table that holds two of three of them."""
    index = _index(spark, folder)
    hits = index.select("id", (F.col("id") % 10).cast("int").alias("relevance_rank"), "title",
                        F.concat(F.lit("link-"), "id").alias("url"))
    known = index.where("id % 3 <> 0").select("id", "author", F.when(F.col("id") % 2 == 0, F.col("content")).alias("content"),
                                              "score", F.lit("").alias("date"), F.col("date").alias("review_created_at"))
    return search.attach_metadata(hits, known)


def search_metadata_query(spark, folder):
    options = search.SearchOptions(limit=50, min_score=3, sort_by="date")
    return search.search_metadata(_index(spark, folder), options)


def knn_batch_query(spark, folder):
    """Ten neighbours of the first vector of every label."""
    index = _index(spark, folder)
    asked = index.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "id").alias("embedding"))
    return search.search_batch(index, asked, 10).select("query_id", "id", "relevance_rank")


def knn_all_query(spark, folder):
    """Five neighbours of every vector of the table."""
    index = _index(spark, folder)
    asked = index.select(F.col("id").alias("query_id"), "embedding")
    return search.search_batch(index, asked, 5, "l2").select("query_id", "id", "relevance_rank")


def knn_many_query(spark, folder):
    """The 1500 rows nearest to one vector."""
    index = _index(spark, folder)
    asked = index.where("id = 0").select(F.col("id").alias("query_id"), "embedding")
    return search.search_batch(index, asked, 1500).select("query_id", "id", "relevance_rank")


def index_status_query(spark, folder):
    return search.index_status(_index(spark, folder))


# -- streams -----------------------------------------------------------------

def _review_stream(spark, folder) -> DataFrame:
    """The event table as a file stream, seen as reviews."""
    path = f"{folder}/events.parquet"
    schema = prepare(spark).read.parquet(path).schema
    events = streaming.read_review_stream(spark, f"{folder}/event[s].parquet", schema)
    return source.reviews_from_events(events.withColumn("ts", F.col("ts").cast("timestamp")))


def stream_alerts_query(spark, folder):
    return streaming.drained(streaming.alert_stream(_review_stream(spark, folder)), "alerts")


def stream_dedupe_query(spark, folder):
    """Every review arrives under an id shared by neighbours."""
    reviews = _review_stream(spark, folder)
    shared = reviews.withColumn("review_id", F.concat(F.lit("g"), F.floor(F.col("seq") / 4)))
    unique = streaming.first_per_id(shared.select("review_id", "review_ts"), "60 days")
    return streaming.drained(unique.select("review_id", "review_ts"), "dedupe").select("review_id")


def stream_all_trends_query(bucket):
    """Every bucket of the stream, open ones too."""
    def run(spark, folder):
        path = _fresh_folder(spark, f"all-trends-{bucket}")
        streaming.upsert_trends(streaming.analyzed_stream(_review_stream(spark, folder)), f"{path}/data", f"{path}/state", bucket)
        return streaming.current_trends(spark, f"{path}/data")
    return run


def stream_trends_query(bucket):
    def run(spark, folder):
        analyzed = streaming.analyzed_stream(_review_stream(spark, folder))
        return streaming.drained(streaming.trend_stream(analyzed, bucket, "1 day"), f"trends-{bucket}")
    return run


QUERIES = {
    "top_issues": top_issues_query,
    "top_issues_window": top_issues_window_query,
    "redact_pii": redact_pii_query,
    "redact_conversations": redact_conversations_query,
    "spam_filter": spam_filter_query,
    "classify": classify_query,
    "classify_documents": classify_documents_query,
    "routing": routing_query,
    "buckets": buckets_query,
    "window_ranges": window_ranges_query,
    "normalize": normalize_query,
    "validate": validate_query,
    "dedupe": dedupe_query,
    "dedupe_lookup": dedupe_lookup_query,
    "import_diagnostics": import_diagnostics_query,
    "incremental_anti": incremental_anti_query,
    "valid_embeddings": valid_embeddings_query,
    "store_payload": store_payload_query,
    "store_app_id": store_app_id_query,
    "filter_reviews": filter_reviews_query,
    **{f"segment_{d}": segment_query(d) for d in issues.SEGMENT_DIMENSIONS},
    "segment_all": segment_all_query,
    "time_trends_day": time_trends_query("day"),
    "time_trends_week": time_trends_query("week"),
    "trend_top_keys": trend_top_keys_query,
    "severity_counts": severity_counts_query,
    "feature_heatmap": feature_heatmap_query,
    "spikes_day": spikes_query("day", 1.0),
    "spikes_week": spikes_query("week", 1.0),
    "spikes_complete_weeks": spikes_complete_weeks_query,
    "compare_metrics": compare_metrics_query,
    "compare_issues": compare_issues_query,
    "compare_regressions": compare_regressions_query,
    "compare_improvements": compare_improvements_query,
    "priority_scores": priority_scores_query,
    "ownership_map": ownership_map_query,
    "weekly_summary": weekly_summary_query,
    "weekly_report": weekly_report_query,
    "top_themes": top_themes_query,
    "document_themes": document_themes_query,
    "cluster_reviews": cluster_reviews_query,
    "cluster_unknown": cluster_unknown_query,
    "cluster_counts": cluster_counts_query,
    "recency_sample": recency_sample_query,
    "analyze": analyze_query,
    "hybrid_merge": hybrid_merge_query,
    "analyze_metadata": analyze_metadata_query,
    "critical_alerts": critical_alerts_query,
    "alert_rows": alert_rows_query,
    "alert_metadata": alert_metadata_query,
    "enrich": enrich_query,
    "export_tickets": export_tickets_query,
    "export_markdown": export_markdown_query,
    "golden_eval": golden_eval_query,
    "failure_class": failure_class_query,
    "token_cost": token_cost_query,
    "call_health": call_health_query,
    "budget_guard": budget_guard_query,
    "knn_search": knn_search_query,
    "search_filtered": search_filtered_query,
    "search_by_date": search_by_date_query,
    "search_by_date_nearest": search_by_date_nearest_query,
    "search_by_date_filtered": search_by_date_filtered_query,
    "search_metadata": search_metadata_query,
    "knn_batch": knn_batch_query,
    "knn_all": knn_all_query,
    "knn_many": knn_many_query,
    "index_status": index_status_query,
    "stream_alerts": stream_alerts_query,
    "stream_dedupe": stream_dedupe_query,
    "stream_trends_day": stream_trends_query("day"),
    "stream_trends_week": stream_trends_query("week"),
    "stream_all_trends_day": stream_all_trends_query("day"),
    "stream_all_trends_week": stream_all_trends_query("week"),
    "import_reviews": import_reviews_query,
    "csv_files": csv_files_query,
    "json_files": json_files_query,
    "analytics_contract": analytics_contract_query,
    "segment_report": segment_report_query,
    "trend_report": trend_report_query,
    "golden_labels": golden_labels_query,
    "attach_metadata": attach_metadata_query,
}
