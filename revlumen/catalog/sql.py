"""SQL that checks the registered queries on the same tables.

Word lists come from the shared tables; the logic (severity above all) is
written out in SQL on its own, so the two sides can disagree.
"""

from __future__ import annotations

from revlumen.functions import keywords as K
from revlumen.functions import text as patterns
from revlumen.sources import event_reviews as source


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def string_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words) + ")"


def rounded(expression: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(24,10)), {digits}) AS DOUBLE)"


def redact(column: str) -> str:
    for pattern in (patterns.EMAIL_PATTERN, patterns.PHONE_PATTERN, patterns.COORDINATE_PATTERN):
        column = f"regexp_replace({column}, {quote(pattern)}, '[REDACTED]', 'g')"
    return column


def low_signal(column: str) -> str:
    return f"(length(regexp_replace({column}, '[^a-zA-Z]', '', 'g')) < 10)"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%fZ')"


REVIEWS = f"""
reviews AS (
  SELECT 'r' || event_id AS review_id,
         {string_list(source.TEMPLATES)}[((event_id * 7 + user_id) % 24 + 1)::INTEGER] AS content,
         (1 + (event_id * 3 + user_id) % 5)::INTEGER AS score,
         ts AS review_ts, {iso('ts')} AS review_created_at,
         '1.' || (user_id % 4) || '.0' AS app_version,
         CASE event_type WHEN 'view' THEN 'Android 14' WHEN 'click' THEN 'iOS 17' ELSE '' END AS os_version,
         'dev-' || (user_id % 6) AS device,
         {string_list(source.LOCALES)}[(user_id % 3 + 1)::INTEGER] AS locale,
         {string_list(source.PLATFORM_CYCLE)}[(event_id % 3 + 1)::INTEGER] AS platform,
         event_id AS seq
  FROM events
)"""


def cascade(table: str, output: str, carried: str) -> str:
    """CTEs that label ``table(content, score)`` as ``output``."""
    areas = " ".join(f"WHEN {any_of('low', words)} THEN {quote(a)}" for a, words in K.FEATURE_KEYWORDS)
    types = " ".join(f"WHEN {any_of('low', words)} THEN {quote(t)}" for t, _, words in K.ISSUE_KEYWORDS)
    scores = " ".join(f"WHEN {quote(t)} THEN {s}" for t, s, _ in K.ISSUE_KEYWORDS)
    return f"""
{output}_text AS (SELECT *, {redact('content')} AS text FROM {table}),
{output}_base AS (
  SELECT *, lower(text) AS low, {low_signal('text')} AS is_spam,
         CASE WHEN score >= 4 THEN 'Positive' WHEN score = 3 THEN 'Neutral' WHEN score <= 2 THEN 'Negative' END AS s0
  FROM {output}_text),
{output}_typed AS (
  SELECT *, CASE {areas} ELSE 'Unknown' END AS a0, CASE {types} ELSE 'Unknown' END AS t0 FROM {output}_base),
{output}_flags AS (
  SELECT *, CASE t0 {scores} ELSE 0.0 END::DOUBLE AS w0,
    ({any_of('low', K.CRITICAL_PHRASES)} OR (score <= 2 AND {any_of('low', K.FRAUD_WORDS)})) AS crit,
    (t0 = 'Safety Concern' OR {any_of('low', K.SAFETY_FAILURE_PHRASES)}
     OR (a0 IN ('Crash Detection', 'Family Location', 'SOS') AND s0 = 'Negative'
         AND {any_of('low', K.BROKEN_WORDS)} AND {any_of('low', K.SAFETY_MENTIONS)})) AS safe,
    ((t0 IN ('Bug', 'Account/Auth', 'Data/Sync', 'Payments/Transactions', 'Cancellation/Retention')
      AND score <= 3 AND s0 = 'Negative')
     OR (t0 IN ('Performance', 'Unknown') AND {any_of('low', K.SLOWDOWN_WORDS)} AND score <= 3)) AS major,
    (score = 4 OR s0 = 'Neutral') AS minor,
    (score >= 4 OR {any_of('low', K.PRAISE_WORDS)}) AS note
  FROM {output}_typed),
{output} AS (
  SELECT {carried}, content, text, score, is_spam,
    CASE WHEN is_spam THEN 'Spam / Bot / Irrelevant'
         WHEN crit THEN CASE WHEN t0 = 'Unknown' THEN 'Performance' ELSE t0 END
         WHEN safe THEN 'Safety Concern'
         WHEN major THEN CASE WHEN t0 = 'Unknown' THEN 'Performance' ELSE t0 END
         WHEN minor THEN t0
         WHEN note AND t0 = 'Unknown' THEN 'Praise' ELSE t0 END AS issue_type,
    CASE WHEN is_spam THEN 'Other' ELSE a0 END AS feature_area,
    CASE WHEN is_spam THEN 'FYI' WHEN crit OR safe THEN 'P0' WHEN major THEN 'P1' WHEN minor THEN 'P2'
         WHEN note THEN 'FYI' END AS severity,
    CASE WHEN is_spam THEN 'Neutral' WHEN crit OR safe OR major OR minor THEN s0
         WHEN note THEN 'Positive' ELSE s0 END AS sentiment,
    CASE WHEN is_spam THEN 1.0
         ELSE greatest(CASE WHEN a0 = 'Unknown' THEN 0.0 ELSE 0.8 END,
                       CASE WHEN crit THEN 0.9 WHEN safe THEN 0.95 WHEN major THEN 0.85 WHEN minor THEN 0.7
                            WHEN note THEN greatest(w0, 0.7) ELSE w0 END,
                       CASE s0 WHEN 'Neutral' THEN 0.6 WHEN 'Positive' THEN 0.8 WHEN 'Negative' THEN 0.8
                            ELSE 0.0 END) END::DOUBLE AS confidence_score
  FROM {output}_flags)"""


CARRIED = "review_id, review_ts, review_created_at, app_version, os_version, device, locale, platform, seq"
CLASSIFIED = REVIEWS + "," + cascade("reviews", "cls", CARRIED)
ANALYZED = CLASSIFIED + """,
ana AS (
  SELECT * REPLACE (coalesce(severity, 'FYI') AS severity, coalesce(sentiment, 'Neutral') AS sentiment),
         issue_type || '::' || feature_area AS issue_key
  FROM cls WHERE NOT is_spam)"""
CLUSTERS = """
clusters AS (
  SELECT issue_key, issue_type, feature_area, count(*) AS review_count,
         count(*) FILTER (severity = 'P0') AS p0_count, count(*) FILTER (severity = 'P1') AS p1_count,
         count(*) FILTER (severity = 'P2') AS p2_count, count(*) FILTER (severity = 'FYI') AS fyi_count,
         avg(score) AS raw_rating, count(review_ts) AS dated
  FROM rows_in GROUP BY ALL)"""
CLUSTER_ORDER = "review_count DESC, p0_count + p1_count DESC, issue_key COLLATE NOCASE"


def classified(select: str) -> str:
    return f"WITH {CLASSIFIED} {select}"


def analyzed(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([ANALYZED, *ctes])} {select}"


def clusters(select: str, *ctes: str, rows: str = "SELECT * FROM ana") -> str:
    return analyzed(select, f"rows_in AS ({rows})", CLUSTERS, *ctes)


def top_issues(rows: str = "SELECT * FROM ana") -> str:
    return clusters(
        f"""SELECT issue_key, issue_type, feature_area, review_count,
              {rounded('review_count / (SELECT greatest(count(*), 1) FROM rows_in)', 4)} AS affected_share,
              p0_count, p1_count, p2_count, fyi_count, {rounded('raw_rating', 2)} AS avg_rating,
              example_review_ids, (SELECT count(*) FROM rows_in) AS total_reviews_considered
            FROM clusters JOIN examples USING (issue_key) ORDER BY {CLUSTER_ORDER} LIMIT 25""",
        """examples AS (
             SELECT issue_key, string_agg(review_id, ',' ORDER BY seq) AS example_review_ids
             FROM (SELECT *, row_number() OVER (PARTITION BY issue_key ORDER BY seq) AS rn FROM rows_in)
             WHERE rn <= 3 GROUP BY issue_key)""",
        rows=rows)


def segment_cte(dimension: str) -> str:
    if dimension == "rating_bucket":
        value = "CASE WHEN score IS NULL THEN 'unknown' WHEN score <= 2 THEN '1-2' WHEN score = 3 THEN '3' ELSE '4-5' END"
    else:
        value = f"CASE WHEN trim({dimension}) <> '' THEN {dimension} ELSE 'unknown' END"
    return f"""SELECT '{dimension}' AS segment_dimension, {value} AS segment_value, count(*) AS issue_count,
                 count(*) FILTER (severity IN ('P0', 'P1')) AS p0_p1_count, {rounded('avg(score)', 2)} AS avg_rating
               FROM ana GROUP BY ALL
               ORDER BY issue_count DESC, p0_p1_count DESC, segment_value COLLATE NOCASE LIMIT 10"""


DIMENSIONS = ("app_version", "os_version", "device", "locale", "platform", "rating_bucket")
DAY = "strftime(review_ts, '%Y-%m-%d')"
WEEK = "strftime(date_trunc('week', review_ts), '%Y-%m-%d')"


def time_trends(bucket: str) -> str:
    return analyzed(
        f"""SELECT time_bucket, count(*) AS total_reviews,
              {rounded("count(*) FILTER (sentiment = 'Negative') / count(*)", 4)} AS negative_share,
              count(*) FILTER (severity = 'P0') AS p0_count, count(*) FILTER (severity = 'P1') AS p1_count,
              count(*) FILTER (severity = 'P2') AS p2_count, count(*) FILTER (severity = 'FYI') AS fyi_count,
              any_value(top_issue_keys) AS top_issue_keys
            FROM bucketed JOIN leading_keys USING (time_bucket) GROUP BY time_bucket ORDER BY time_bucket""",
        f"bucketed AS (SELECT *, {bucket} AS time_bucket FROM ana)",
        """leading_keys AS (
             SELECT time_bucket, string_agg(issue_key, ',' ORDER BY rn) AS top_issue_keys
             FROM (SELECT time_bucket, issue_key, row_number() OVER (
                     PARTITION BY time_bucket ORDER BY count(*) DESC, issue_key COLLATE NOCASE) AS rn
                   FROM bucketed GROUP BY time_bucket, issue_key)
             WHERE rn <= 3 GROUP BY time_bucket)""")


def spikes(bucket: str, threshold: float, top_n: int = 10, scope: str = "true") -> str:
    return analyzed(
        f"""SELECT issue_key, (SELECT max(time_bucket) FROM per) AS bucket,
              {rounded('mean', 4)} AS baseline_rate, cur::DOUBLE AS current_rate,
              CASE WHEN mean > 0 THEN {rounded('cur / mean', 4)} END AS spike_score, true AS is_spike
            FROM scored WHERE cur >= 1 AND (mean = 0 OR cur / mean >= {threshold})
            ORDER BY spike_score DESC NULLS FIRST, issue_key COLLATE NOCASE LIMIT {top_n}""",
        f"per AS (SELECT {bucket} AS time_bucket, issue_key, count(*) AS n FROM ana WHERE {scope} GROUP BY ALL)",
        """scored AS (
             SELECT issue_key,
                    coalesce(sum(n) FILTER (time_bucket = (SELECT max(time_bucket) FROM per)), 0)::BIGINT AS cur,
                    coalesce(sum(n) FILTER (time_bucket < (SELECT max(time_bucket) FROM per)), 0)
                      / (SELECT count(DISTINCT time_bucket) - 1 FROM per)::DOUBLE AS mean
             FROM per GROUP BY issue_key)""")


SPLIT = "TIMESTAMP '2024-01-16'"
COMPARED = f"""
compared AS (
  SELECT issue_key, count(*) FILTER (review_ts < {SPLIT}) AS baseline,
         count(*) FILTER (review_ts >= {SPLIT}) AS current FROM ana GROUP BY issue_key),
deltas AS (
  SELECT issue_key, baseline, current, current - baseline AS delta,
         CASE WHEN baseline > 0 THEN {rounded('(current - baseline) / baseline', 4)} END AS delta_pct,
         current > baseline AS is_regression FROM compared)"""

PRIORITY = f"""
drivers AS (
  SELECT *, review_count / (SELECT greatest(sum(review_count), 1) FROM clusters)::DOUBLE AS vol,
         (p0_count + p1_count) / review_count AS crit,
         CASE WHEN dated >= 4 THEN (dated % 2) / (dated // 2) ELSE 0 END::DOUBLE AS trend,
         greatest(0, (5 - {rounded('raw_rating', 2)}) / 4)::DOUBLE AS drag FROM clusters),
scored_clusters AS (
  SELECT *, {rounded('100 * (0.4::DOUBLE * vol + 0.3::DOUBLE * crit + 0.2::DOUBLE * greatest(0, trend) + 0.1::DOUBLE * drag)', 2)}
         AS impact_score FROM drivers)"""

OWNED = """
owned AS (
  SELECT *, CASE feature_area || '|' || issue_type
              WHEN 'Login/OTP|Account/Auth' THEN 'Identity/alex' WHEN 'Bank Linking|Data/Sync' THEN 'Banking/eli'
              WHEN 'Unknown|Praise' THEN 'Community/finn'
            ELSE CASE feature_area WHEN 'Login/OTP' THEN 'Access/blake' WHEN 'SOS' THEN 'Safety/casey'
                   WHEN 'Crash Detection' THEN 'Sensors/drew' END END AS team
  FROM clusters)"""

UNCLEAN = f"""
unclean AS (
  SELECT event_id AS seq,
         'r' || CASE WHEN event_id % 3 = 2 THEN event_id - 2 ELSE event_id END AS review_id,
         TRY_CAST(nullif(regexp_extract({string_list(source.RAW_SCORES)}[(event_id % 8 + 1)::INTEGER],
                  '^\\s*([+-]?\\d+)', 1), '') AS BIGINT) AS score,
         TRY_CAST(nullif(regexp_extract({string_list(source.RAW_THUMBS)}[(user_id % 5 + 1)::INTEGER],
                  '^\\s*([+-]?\\d+)', 1), '') AS BIGINT) AS thumbs_up_count,
         {iso('ts')} AS review_created_at,
         CASE WHEN user_id % 2 = 0 THEN 'user' || user_id ELSE 'author' || user_id END AS user_name,
         ['play_store', 'app_store', 'unknown', 'web'][(event_id % 4 + 1)::INTEGER] AS platform
  FROM events),
checked AS (
  SELECT *, concat_ws(',', CASE WHEN platform = 'web' THEN 'platform' END,
                      CASE WHEN score IS NULL OR score NOT BETWEEN 1 AND 5 THEN 'score' END,
                      CASE WHEN thumbs_up_count IS NULL OR thumbs_up_count < 0 THEN 'thumbs_up_count' END)
            AS invalid_reasons
  FROM unclean)"""

DEDUPED = f"""WITH {UNCLEAN} SELECT review_id, seq, score FROM checked WHERE invalid_reasons = ''
              QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq) = 1"""

MERGED = ANALYZED + f""",
answers AS (
  SELECT 'r' || event_id AS review_id, {string_list(source.ANSWERS)}[((event_id + user_id) % 6 + 1)::INTEGER] AS raw,
         CASE WHEN event_type = 'error' THEN
           ['timeout', 'rate_limited', 'rate_limited', 'provider_failure', 'provider_failure'][(event_id % 5 + 1)::INTEGER]
         END AS failure
  FROM events),
opened AS (
  SELECT review_id, failure, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS doc FROM answers),
fields AS (
  SELECT review_id, failure, nullif(json_extract_string(doc, '$.feature_area'), '') AS na,
         nullif(json_extract_string(doc, '$.issue_type'), '') AS nt,
         nullif(json_extract_string(doc, '$.severity'), '') AS ns
  FROM opened),
joined AS (
  SELECT cls.*, failure, na, nt, ns,
         (confidence_score < 0.6 OR feature_area = 'Unknown' OR coalesce(severity IN ('P0', 'P1'), false)) AS needs_label
  FROM cls JOIN fields USING (review_id) WHERE NOT is_spam),
used AS (
  SELECT *, needs_label AND failure IS NULL
            AND coalesce(coalesce(ns, severity) IN ('P0', 'P1', 'P2', 'FYI'), true) AS use_it
  FROM joined)"""

CALLS = f"""
calls AS (
  SELECT user_id AS call_key, ts, event_id AS seq, event_type <> 'error' AS ok,
         {string_list(source.MODELS)}[(event_id % 5 + 1)::INTEGER] AS model,
         CASE WHEN floor(value) = 0 THEN 50 ELSE floor(value)::BIGINT END AS tin,
         CASE WHEN user_id % 40 = 0 THEN 50 ELSE user_id % 40 END AS tout
  FROM events),
priced AS (
  SELECT *, (CASE model WHEN 'gpt-4o-mini' THEN tin * 15 + tout * 60 WHEN 'gpt-4o' THEN tin * 500 + tout * 1500
                        WHEN 'claude-3.5-sonnet' THEN tin * 300 + tout * 1500
                        ELSE tin * 25 + tout * 125 END)::BIGINT AS units FROM calls)"""

INDEX = """
idx AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label,
         CASE WHEN vec_id % 9 <> 0 THEN 'user-' || label ELSE 'Review' END AS author,
         'vector ' || vec_id AS content,
         CASE WHEN vec_id % 7 <> 0 THEN (1 + vec_id % 5)::INTEGER END AS score,
         CASE WHEN vec_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(vec_id::INTEGER) END AS made
  FROM embeddings),
scored AS (
  SELECT idx.*, strftime(made, '%Y-%m-%dT%H:%M:%SZ') AS date,
         round(1 - list_cosine_similarity(embedding, (SELECT embedding FROM idx WHERE id = 0)), 12) AS distance
  FROM idx)"""

PAIRS = """
pairs AS (
  SELECT unnest(list_distinct(list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) AS theme
  FROM (SELECT string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM texts))
SELECT theme, count(*) AS review_count FROM pairs GROUP BY theme ORDER BY review_count DESC, theme LIMIT 3"""

MARKDOWN = """
body AS (
  SELECT CASE severity WHEN 'P0' THEN 1 WHEN 'P1' THEN 2 ELSE 3 END AS section, seq,
         CASE WHEN severity IN ('P0', 'P1')
              THEN '- *[' || feature_area || ']* ' || issue_type || ' (ID: ' || review_id || ')'
              ELSE '- [' || severity || '] ' || feature_area || ' - ' || issue_type END AS line
  FROM ana),
heads AS (
  SELECT section, ['P0 Critical Issues', 'P1 High Priority', 'Other Reports'][section] AS title, count(*) AS n
  FROM body GROUP BY section)
SELECT section, 3 AS part, seq, line FROM body
UNION ALL SELECT section, 2, NULL, '*' || title || ' (' || n || ')*' FROM heads
UNION ALL SELECT section, 1, NULL, '' FROM heads
UNION ALL SELECT 0, 0, NULL, '*App Reviews Report*'"""


def stream_trends(bucket: str, length: str | None = None) -> str:
    closed = f"""HAVING CAST(time_bucket AS TIMESTAMP) + INTERVAL {length}
                   <= (SELECT max(review_ts) FROM ana) - INTERVAL 1 DAY""" if length else ""
    return analyzed(
        f"""SELECT {bucket} AS time_bucket, count(*) AS total_reviews,
              count(*) FILTER (sentiment = 'Negative') AS negative_count,
              count(*) FILTER (severity = 'P0') AS p0_count, count(*) FILTER (severity = 'P1') AS p1_count,
              count(*) FILTER (severity = 'P2') AS p2_count, count(*) FILTER (severity = 'FYI') AS fyi_count
            FROM ana GROUP BY 1 {closed}""")


STORE_ROWS = f"""
        SELECT 's' || event_id AS review_id, 'play_store' AS platform,
               CASE WHEN user_id % 3 = 1 THEN 'user' || user_id ELSE 'Anonymous' END AS user_name,
               {string_list(source.TEMPLATES)}[((event_id * 7 + user_id) % 24 + 1)::INTEGER] || ' second line' AS content,
               (1 + (event_id * 3 + user_id) % 5)::INTEGER AS score,
               CASE WHEN user_id % 4 <> 0 THEN '1.' || (user_id % 4) || '.0' ELSE 'Unknown' END AS app_version,
               'Unknown' AS device, 'Unknown' AS os_version,
               CASE WHEN event_id % 6 = 5 OR event_id % 7 = 6 THEN '2024-02-01T00:00:00.000Z'
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) % 1000000) // 1000)::VARCHAR, 3, '0')
                         || 'Z' END AS review_created_at
        FROM events"""

ORACLE_SQL = {
    "top_issues": top_issues(),
    "top_issues_window": top_issues(
        "SELECT * FROM ana WHERE review_ts >= TIMESTAMP '2024-01-29' AND review_ts <= TIMESTAMP '2024-01-31'"),
    "redact_pii": f"SELECT doc_id, {redact('text')} AS redacted FROM documents",
    "redact_conversations": f"SELECT conv_id, turn, {redact('text')} AS redacted FROM conversations",
    "spam_filter": f"SELECT doc_id, {low_signal(redact('text'))} AS is_spam FROM documents",
    "classify": classified("SELECT review_id, issue_type, feature_area, severity, sentiment, confidence_score, "
                           "is_spam FROM cls"),
    "classify_documents": (
        "WITH docs AS (SELECT doc_id, text AS content, (1 + doc_id % 5)::INTEGER AS score FROM documents),"
        + cascade("docs", "cls", "doc_id")
        + " SELECT doc_id, issue_type, feature_area, severity, sentiment, confidence_score, is_spam FROM cls"),
    "routing": classified("""SELECT review_id, (confidence_score < 0.6 OR feature_area = 'Unknown'
                               OR coalesce(severity IN ('P0', 'P1'), false)) AS needs_label
                             FROM cls WHERE NOT is_spam"""),
    "buckets": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_bucket,
                    strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_bucket FROM events""",
    "window_ranges": """
        WITH days AS (SELECT DISTINCT ts::DATE AS d FROM events),
        spans(w, back) AS (VALUES ('last_7_days', 6), ('last_30_days', 29), ('last_90_days', 89),
                                  ('last_180_days', 179), ('last_12_months', 364))
        SELECT w AS "window", strftime(d - back, '%Y-%m-%d') AS start_date, strftime(d, '%Y-%m-%d') AS end_date
        FROM days, spans
        UNION ALL SELECT 'this_week', strftime(date_trunc('week', d), '%Y-%m-%d'), strftime(d, '%Y-%m-%d') FROM days""",
    "normalize": f"""WITH {UNCLEAN} SELECT seq, review_id, score, thumbs_up_count, review_created_at, user_name
                     FROM unclean""",
    "validate": f"WITH {UNCLEAN} SELECT seq, invalid_reasons FROM checked",
    "dedupe": DEDUPED,
    "dedupe_lookup": DEDUPED,
    "import_diagnostics": f"""
        WITH {UNCLEAN},
        sums AS (SELECT count(*) AS n, count(*) FILTER (invalid_reasons <> '') AS bad,
                        count(DISTINCT review_id) FILTER (invalid_reasons = '') AS uniq FROM checked)
        SELECT n AS total_reviews_input, bad AS invalid_rows_dropped, n - bad - uniq AS duplicates_dropped,
               n - uniq AS filtered_spam, (n - uniq) / n AS spam_ratio, uniq AS total_processed,
               uniq * 55 / 1000000 * 0.02::DOUBLE AS cost_estimate_usd FROM sums""",
    "incremental_anti": """SELECT doc_id AS review_id, n_chars FROM documents
                           WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "valid_embeddings": """SELECT vec_id, len(embedding) = 64 AS is_valid,
                             vec_id % 4 IN (0, 3) AS damaged_is_valid FROM embeddings""",
    "store_payload": STORE_ROWS,
    "store_app_id": """
        SELECT event_id AS link_id,
               CASE WHEN event_id % 5 IN (0, 2) THEN 'play_store' WHEN event_id % 5 IN (1, 3) THEN 'app_store' END
                 AS platform,
               CASE event_id % 5 WHEN 0 THEN 'com.app' || user_id WHEN 1 THEN (1000000 + user_id)::VARCHAR END AS app_id,
               CASE event_id % 5 WHEN 2 THEN 'play_store link without an id'
                    WHEN 3 THEN 'app_store link without a numeric id' WHEN 4 THEN 'unsupported link' END AS link_error
        FROM events""",
    "filter_reviews": analyzed("""
        SELECT review_id, issue_type, feature_area, severity, sentiment FROM ana
        WHERE review_ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20 12:00:00'
          AND severity IN ('P0', 'P1', 'P2') AND sentiment IN ('Negative', 'Neutral')
          AND feature_area IN ('Login/OTP', 'SOS', 'Unknown', 'Card Controls')
          AND issue_type IN ('Account/Auth', 'Safety Concern', 'Trust/Fraud', 'Performance', 'Support/Service')"""),
    **{f"segment_{d}": analyzed(segment_cte(d)) for d in DIMENSIONS},
    "segment_all": analyzed(" UNION ALL ".join(f"(SELECT * FROM ({segment_cte(d)}))" for d in DIMENSIONS)),
    "time_trends_day": time_trends(DAY),
    "time_trends_week": time_trends(WEEK),
    "trend_top_keys": analyzed(f"""
        SELECT time_bucket, issue_key, n, rank::INTEGER AS rank FROM (
          SELECT {DAY} AS time_bucket, issue_key, count(*) AS n, row_number() OVER (
                 PARTITION BY {DAY} ORDER BY count(*) DESC, issue_key COLLATE NOCASE) AS rank
          FROM ana GROUP BY time_bucket, issue_key) WHERE rank <= 3"""),
    "severity_counts": analyzed("""
        SELECT count(*) FILTER (severity = 'P0') AS p0_count, count(*) FILTER (severity = 'P1') AS p1_count,
               count(*) FILTER (severity = 'P2') AS p2_count, count(*) FILTER (severity = 'FYI') AS fyi_count FROM ana"""),
    "feature_heatmap": analyzed("SELECT feature_area, issue_type, count(*) AS review_count FROM ana GROUP BY ALL"),
    "spikes_day": spikes(DAY, 1.0),
    "spikes_week": spikes(WEEK, 1.0),
    "spikes_complete_weeks": spikes(WEEK, 1.0, scope="review_ts < TIMESTAMP '2024-01-29'"),
    "compare_metrics": analyzed(
        f"""SELECT metric, baseline, current, {rounded('current - baseline', 4)} AS delta,
              CASE WHEN baseline <> 0 THEN {rounded('(current - baseline) / baseline', 4)} END AS delta_pct,
              current > baseline AS is_regression
            FROM (SELECT 'total_reviews' AS metric, bt::DOUBLE AS baseline, ct::DOUBLE AS current FROM sums
                  UNION ALL SELECT 'negative_share', bn / bt, cn / ct FROM sums
                  UNION ALL SELECT 'critical_share', bc / bt, cc / ct FROM sums)""",
        f"""sums AS (
              SELECT count(*) FILTER (old) AS bt, count(*) FILTER (NOT old) AS ct,
                     count(*) FILTER (old AND sentiment = 'Negative') AS bn,
                     count(*) FILTER (NOT old AND sentiment = 'Negative') AS cn,
                     count(*) FILTER (old AND severity IN ('P0', 'P1')) AS bc,
                     count(*) FILTER (NOT old AND severity IN ('P0', 'P1')) AS cc
              FROM (SELECT *, review_ts < {SPLIT} AS old FROM ana))"""),
    "compare_issues": analyzed("SELECT * FROM deltas", COMPARED),
    "compare_regressions": analyzed(
        "SELECT * FROM deltas WHERE delta > 0 ORDER BY delta DESC, issue_key COLLATE NOCASE LIMIT 5", COMPARED),
    "compare_improvements": analyzed(
        "SELECT * FROM deltas WHERE delta < 0 ORDER BY delta, issue_key COLLATE NOCASE LIMIT 5", COMPARED),
    "priority_scores": clusters(
        f"""SELECT issue_key, review_count, impact_score, {rounded('vol', 4)} AS volume_share,
              {rounded('crit', 4)} AS critical_share, {rounded('trend', 4)} AS trend_velocity,
              {rounded('drag', 4)} AS rating_drag
            FROM scored_clusters ORDER BY impact_score DESC, {CLUSTER_ORDER} LIMIT 10""", PRIORITY),
    "ownership_map": clusters(
        f"""SELECT issue_key, issue_type, feature_area, review_count, split_part(team, '/', 1) AS squad,
              split_part(team, '/', 2) AS owner, team IS NULL AS is_unmapped
            FROM owned ORDER BY {CLUSTER_ORDER} LIMIT 20""", OWNED),
    "weekly_summary": analyzed(
        f"""SELECT count(*) AS total_reviews,
              {rounded("count(*) FILTER (sentiment = 'Negative') / count(*)", 4)} AS negative_share,
              {rounded("count(*) FILTER (severity IN ('P0', 'P1')) / count(*)", 4)} AS critical_share FROM ana"""),
    "weekly_report": clusters(
        f"""SELECT 'summary' AS section, 1 AS rank, 'total_reviews' AS issue_key, count(*)::DOUBLE AS value FROM ana
            UNION ALL SELECT 'summary', 2, 'negative_share',
              {rounded("count(*) FILTER (sentiment = 'Negative') / count(*)", 4)} FROM ana
            UNION ALL SELECT 'summary', 3, 'critical_share',
              {rounded("count(*) FILTER (severity IN ('P0', 'P1')) / count(*)", 4)} FROM ana
            UNION ALL SELECT 'top_issues', r::INTEGER, issue_key, review_count::DOUBLE FROM (
              SELECT *, row_number() OVER (ORDER BY {CLUSTER_ORDER}) AS r FROM clusters) WHERE r <= 5
            UNION ALL SELECT 'spike_alerts', r::INTEGER, issue_key, cur::DOUBLE FROM (
              SELECT *, row_number() OVER (ORDER BY {rounded('cur / mean', 4)} DESC NULLS FIRST,
                                           issue_key COLLATE NOCASE) AS r
              FROM day_spikes WHERE cur >= 1 AND (mean = 0 OR cur / mean >= 2)) WHERE r <= 5
            UNION ALL SELECT 'priority_rankings', r::INTEGER, issue_key, impact_score FROM (
              SELECT *, row_number() OVER (ORDER BY impact_score DESC, {CLUSTER_ORDER}) AS r
              FROM scored_clusters) WHERE r <= 5
            UNION ALL SELECT 'ownership_assignments', r::INTEGER, issue_key, review_count::DOUBLE FROM (
              SELECT *, row_number() OVER (ORDER BY {CLUSTER_ORDER}) AS r FROM owned WHERE team IS NOT NULL)
              WHERE r <= 5""",
        PRIORITY, OWNED,
        f"per AS (SELECT {DAY} AS time_bucket, issue_key, count(*) AS n FROM ana GROUP BY ALL)",
        """day_spikes AS (
             SELECT issue_key,
                    coalesce(sum(n) FILTER (time_bucket = (SELECT max(time_bucket) FROM per)), 0)::BIGINT AS cur,
                    coalesce(sum(n) FILTER (time_bucket < (SELECT max(time_bucket) FROM per)), 0)
                      / (SELECT count(DISTINCT time_bucket) - 1 FROM per)::DOUBLE AS mean
             FROM per GROUP BY issue_key)"""),
    "top_themes": f"WITH {ANALYZED}, texts AS (SELECT text FROM ana), {PAIRS}",
    "document_themes": f"WITH texts AS (SELECT text FROM documents), {PAIRS}",
    "cluster_reviews": analyzed("""
        SELECT review_id, issue_type, feature_area, severity, review_created_at FROM ana
        WHERE feature_area = 'Login/OTP' AND review_ts >= TIMESTAMP '2024-01-02'
          AND review_ts <= TIMESTAMP '2024-01-31' ORDER BY review_ts DESC, seq LIMIT 100"""),
    "cluster_unknown": analyzed("""
        SELECT review_id, issue_type, feature_area, severity, review_created_at FROM ana
        WHERE feature_area = 'Unknown' OR issue_type = 'Unknown' ORDER BY review_ts DESC, seq LIMIT 500"""),
    "cluster_counts": analyzed("""
        SELECT count(*) AS total_reviews_considered, count(*) FILTER (feature_area = 'Login/OTP') AS total_cluster_matches,
               least(100, count(*) FILTER (feature_area = 'Login/OTP')) AS returned,
               '2024-01-02' AS start_date, '2024-01-31' AS end_date
        FROM ana WHERE review_ts >= TIMESTAMP '2024-01-02' AND review_ts <= TIMESTAMP '2024-01-31'"""),
    "recency_sample": f"""WITH {REVIEWS} SELECT review_id, review_created_at FROM reviews
                          ORDER BY review_ts DESC, seq LIMIT 300""",
    "analyze": analyzed("""
        SELECT review_id, text, review_created_at, score, issue_type, feature_area, severity, sentiment,
               confidence_score, 'rule_engine' AS classification_source, device AS signal_device,
               CASE WHEN os_version = '' THEN 'Unknown' ELSE os_version END AS signal_os_version,
               app_version AS signal_app_version FROM ana"""),
    "hybrid_merge": f"""
        WITH {MERGED}
        SELECT review_id,
               CASE WHEN use_it THEN coalesce(nt, CASE WHEN issue_type = 'Unknown' THEN 'Performance' ELSE issue_type END)
                    ELSE issue_type END AS issue_type,
               CASE WHEN use_it THEN coalesce(na, feature_area) ELSE feature_area END AS feature_area,
               CASE WHEN use_it THEN coalesce(ns, severity) ELSE severity END AS severity,
               CASE WHEN use_it THEN 'hybrid' ELSE 'rule_engine' END AS classification_source, needs_label
        FROM used""",
    "analyze_metadata": f"""
        WITH {MERGED},
        last_call AS (
          SELECT coalesce((SELECT failure IS NOT NULL FROM used WHERE needs_label AND (use_it OR failure IS NOT NULL)
                           ORDER BY review_ts, seq DESC LIMIT 1), false) AS failed),
        sums AS (
          SELECT (SELECT count(*) FROM cls) AS n, (SELECT count(*) FROM cls WHERE is_spam) AS spam,
                 count(*) FILTER (use_it) AS hybrid, count(*) AS done,
                 count(*) FILTER (needs_label AND failure = 'timeout') AS timeouts,
                 count(*) FILTER (needs_label AND failure = 'rate_limited') AS limited,
                 count(*) FILTER (needs_label AND failure IS NOT NULL) AS failures,
                 (SELECT failed FROM last_call) AS failed FROM used)
        SELECT n AS total_reviews_input, spam AS filtered_spam, hybrid AS hybrid_count, hybrid AS llm_routed_count,
               timeouts AS timeout_count, limited AS rate_limit_count, failures AS retry_count,
               0::BIGINT AS budget_guardrail_count, n AS total_reviews_available, false AS sampled,
               done AS total_processed, done - hybrid AS rule_only_count, spam / n AS spam_ratio,
               hybrid / done AS llm_routed_ratio, hybrid / done > 0.4 AS rule_coverage_drop,
               concat_ws('|', CASE WHEN failed THEN 'LLM Fallback Triggered' END,
                         CASE WHEN spam / n > 0.2 THEN 'Suspiciously high spam ratio detected.' END) AS warnings,
               concat_ws('|', CASE WHEN failed THEN 'llm_fallback_triggered' END,
                         CASE WHEN timeouts > 0 THEN 'llm_timeout' END,
                         CASE WHEN limited > 0 THEN 'rate_limited' END) AS degraded_reasons,
               failed OR timeouts > 0 OR limited > 0 AS degraded_mode
        FROM sums""",
    "critical_alerts": classified("""
        SELECT review_id, text, feature_area, severity, severity = 'P0' AS requires_immediate_attention
        FROM cls WHERE NOT is_spam AND severity IN ('P0', 'P1') ORDER BY severity, review_id COLLATE NOCASE LIMIT 50"""),
    "alert_rows": classified("""
        SELECT review_id, text, feature_area, severity, severity = 'P0' AS requires_immediate_attention
        FROM cls WHERE NOT is_spam AND severity IN ('P0', 'P1')"""),
    "alert_metadata": classified("""
        SELECT count(*) AS total_reviews_input, count(*) FILTER (is_spam) AS filtered_spam,
               count(*) FILTER (is_spam) / count(*) AS spam_ratio, count(*) FILTER (NOT is_spam) AS total_processed,
               count(*) FILTER (NOT is_spam AND severity IN ('P0', 'P1')) AS total_alerts,
               least(50, count(*) FILTER (NOT is_spam AND severity IN ('P0', 'P1'))) AS returned_alerts,
               CASE WHEN count(*) FILTER (is_spam) / count(*) > 0.2 THEN 'Suspiciously high spam ratio detected.'
                    ELSE '' END AS warnings FROM cls"""),
    "enrich": analyzed("SELECT review_id, severity, platform, locale, device FROM ana"),
    "export_tickets": analyzed("""
        SELECT review_id, 'APP' AS project,
               '[' || severity || '] ' || feature_area || ': ' || issue_type || ' Report' AS summary,
               '*Automated Review Ticket*' || chr(10) || 'Review ID: ' || review_id || chr(10)
                 || 'Severity: ' || severity || chr(10) || 'Feature Area: ' || feature_area || chr(10)
                 || 'Sentiment: ' || sentiment || chr(10) || 'Device: ' || device || chr(10)
                 || 'OS: ' || CASE WHEN os_version = '' THEN 'Unknown' ELSE os_version END || chr(10)
                 || 'App Version: ' || app_version || chr(10) AS description,
               CASE WHEN issue_type = 'Bug' THEN 'Bug' ELSE 'Task' END AS issuetype,
               severity AS customfield_severity FROM ana"""),
    "export_markdown": f"WITH {ANALYZED}, {MARKDOWN}",
    "golden_eval": f"""
        WITH joined AS (
          SELECT quality, CASE WHEN {low_signal(redact('text'))} THEN 0 ELSE 1 END AS kept
          FROM labels JOIN documents USING (doc_id))
        SELECT count(*) AS labelled, count(*) FILTER (kept = quality) AS agreeing,
               {rounded('count(*) FILTER (kept = quality) / count(*)', 4)} AS accuracy,
               CASE WHEN count(*) FILTER (quality = 0) = 0 THEN 0.0 ELSE
               {rounded('count(*) FILTER (kept = 0 AND quality = 0) / count(*) FILTER (quality = 0)', 4)} END
                 AS negative_recall,
               count(*) FILTER (kept = quality) / count(*) >= 0.9 AS passes
        FROM joined""",
    "failure_class": """
        SELECT ['timeout', 'rate_limited', 'rate_limited', 'provider_failure', 'provider_failure']
               [(event_id % 5 + 1)::INTEGER] AS failure_class, count(*) AS calls
        FROM events WHERE event_type = 'error' GROUP BY 1""",
    "token_cost": f"""
        WITH {CALLS} SELECT model, count(*) AS calls, sum(tin)::BIGINT AS input_tokens,
                            sum(tout)::BIGINT AS output_tokens, sum(units)::BIGINT / 100000000 AS cost_usd
        FROM priced WHERE ok GROUP BY model""",
    "call_health": f"""
        WITH {CALLS},
        numbered AS (
          SELECT *, row_number() OVER w AS pos, count(*) OVER (w ROWS 49 PRECEDING) AS seen,
                 count(*) FILTER (NOT ok) OVER (w ROWS 49 PRECEDING) AS fails,
                 max(CASE WHEN ok THEN seq_in END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_ok
          FROM (SELECT *, row_number() OVER (PARTITION BY call_key ORDER BY ts, seq) AS seq_in FROM calls)
          WINDOW w AS (PARTITION BY call_key ORDER BY ts, seq)),
        states AS (
          SELECT *, NOT ok AND pos - coalesce(last_ok, 0) >= 10 AS streak,
                 NOT ok AND seen = 50 AND fails / 50 >= 0.15 AS rate FROM numbered)
        SELECT call_key, count(*) AS calls, count(*) FILTER (NOT ok) AS failures,
               min(pos) FILTER (streak) AS first_streak_trip, min(pos) FILTER (rate) AS first_rate_trip,
               min(pos) FILTER (streak OR rate) AS first_trip, bool_or(streak OR rate) AS tripped
        FROM states GROUP BY call_key""",
    "budget_guard": f"""
        WITH {CALLS},
        summed AS (
          SELECT seq, coalesce(sum(CASE WHEN ok THEN units ELSE 0 END) OVER (ORDER BY ts DESC, seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cost_before_units FROM priced)
        SELECT seq, cost_before_units, cost_before_units < 50000000 AS within_budget FROM summed""",
    "knn_search": f"""
        WITH {INDEX}
        SELECT id, (row_number() OVER (ORDER BY distance, id) - 1)::INTEGER AS relevance_rank, author, content, score, date
        FROM scored ORDER BY distance, id LIMIT 20""",
    "search_filtered": f"""
        WITH {INDEX}
        SELECT id, (row_number() OVER (ORDER BY distance, id) - 1)::INTEGER AS relevance_rank, author, content, score, date
        FROM scored WHERE score BETWEEN 2 AND 4 AND made BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-15'
        ORDER BY distance, id LIMIT 20""",
    "search_by_date": f"""
        WITH {INDEX},
        ranked AS (SELECT *, (row_number() OVER (ORDER BY distance, id) - 1)::INTEGER AS relevance_rank FROM scored)
        SELECT id, relevance_rank, author, content, score, date FROM ranked
        ORDER BY coalesce(made, TIMESTAMP '1970-01-01'), relevance_rank LIMIT 20""",
    "search_by_date_nearest": f"""
        WITH {INDEX},
        ranked AS (SELECT *, (row_number() OVER (ORDER BY distance, id) - 1)::INTEGER AS relevance_rank FROM scored)
        SELECT id, relevance_rank, author, content, score, date FROM ranked WHERE relevance_rank < 100
        ORDER BY coalesce(made, TIMESTAMP '1970-01-01'), relevance_rank LIMIT 20""",
    "search_by_date_filtered": f"""
        WITH {INDEX},
        ranked AS (
          SELECT *, (row_number() OVER (ORDER BY list_distance(embedding, (SELECT embedding FROM idx WHERE id = 0)), id) - 1)::INTEGER AS relevance_rank
          FROM scored WHERE score >= 2 AND made BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20 12:00:00')
        SELECT id, relevance_rank, author, content, score, date FROM ranked ORDER BY made DESC, relevance_rank LIMIT 50""",
    "search_metadata": f"""
        WITH {INDEX}
        SELECT id, 0 AS relevance_rank, CASE WHEN id % 9 <> 0 THEN author END AS author, content, score, date
        FROM scored WHERE score >= 3
        ORDER BY coalesce(made, TIMESTAMP '1970-01-01') DESC, id LIMIT 50""",
    "knn_batch": f"""
        WITH {INDEX},
        asked AS (SELECT label AS query_id, arg_min(embedding, id) AS q FROM idx GROUP BY label),
        ranked AS (
          SELECT query_id, id, row_number() OVER (PARTITION BY query_id
                   ORDER BY round(1 - list_cosine_similarity(embedding, q), 12), id) - 1 AS r
          FROM idx, asked)
        SELECT query_id, id, r::INTEGER AS relevance_rank FROM ranked WHERE r < 10""",
    "knn_all": f"""
        WITH {INDEX},
        ranked AS (
          SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.embedding, b.embedding), b.id) - 1 AS r
          FROM idx a, idx b)
        SELECT query_id, id, r::INTEGER AS relevance_rank FROM ranked WHERE r < 5""",
    "knn_many": f"""
        WITH {INDEX}
        SELECT 0::BIGINT AS query_id, id, (row_number() OVER (ORDER BY distance, id) - 1)::INTEGER AS relevance_rank
        FROM scored ORDER BY distance, id LIMIT 1500""",
    "index_status": f"""
        WITH {INDEX}
        SELECT count(*) AS total_indexed, count(score) AS score_count, count(made) AS date_count,
               count(score) / count(*) AS has_score, count(made) / count(*) AS has_date,
               count(*) > 0 AND count(score) > 0 AS is_ready FROM idx""",
    "stream_alerts": classified("""
        SELECT review_id, text, feature_area, severity, severity = 'P0' AS requires_immediate_attention
        FROM cls WHERE NOT is_spam AND severity IN ('P0', 'P1')"""),
    "stream_dedupe": "SELECT DISTINCT 'g' || (event_id // 4) AS review_id FROM events",
    "stream_trends_day": stream_trends(DAY, "1 DAY"),
    "stream_trends_week": stream_trends(WEEK, "7 DAY"),
    "stream_all_trends_day": stream_trends(DAY),
    "stream_all_trends_week": stream_trends(WEEK),
    "import_reviews": DEDUPED,
    "csv_files": f"SELECT * FROM ({STORE_ROWS})",
    "json_files": f"SELECT * FROM ({STORE_ROWS})",
    "analytics_contract": classified("""
        SELECT review_id, coalesce(seq % 5 = 1, false) OR seq % 7 = 3 OR seq % 11 = 4 AS invalid FROM cls"""),
    "segment_report": analyzed("""
        SELECT 'total' AS section, count(*) AS total_reviews_considered, NULL AS segment_dimension, NULL AS segment_value,
               NULL AS issue_count, NULL AS p0_p1_count, NULL AS avg_rating FROM picked
        UNION ALL SELECT 'segment', NULL, * FROM (
          SELECT 'app_version', app_version, count(*) AS n, count(*), """ + rounded("avg(score)", 2) + """
          FROM picked GROUP BY app_version ORDER BY n DESC, app_version COLLATE NOCASE LIMIT 3)""",
        "picked AS (SELECT * FROM ana WHERE severity IN ('P0', 'P1'))"),
    "trend_report": f"""
        WITH trends AS ({time_trends(WEEK)})
        SELECT 'trend' AS section, NULL AS total_reviews_considered, * FROM trends
        UNION ALL BY NAME SELECT 'total' AS section, sum(total_reviews)::BIGINT AS total_reviews_considered FROM trends""",
    "golden_labels": classified(f"""
        , golden AS (
          SELECT issue_type, severity, CASE WHEN seq % 10 = 0 THEN 'Bug' ELSE issue_type END AS t,
                 CASE WHEN seq % 8 = 0 THEN 'P2' ELSE severity END AS s,
                 issue_type = 'Safety Concern' AND severity = 'P0' OR seq % 50 = 0 AS safe
          FROM cls WHERE seq % 2 = 0),
        parts AS (
          SELECT 'issue_type_accuracy' AS metric, count(*) FILTER (issue_type = t) AS matches, count(*) AS total, 0.9 AS gate FROM golden
          UNION ALL SELECT 'severity_accuracy', count(*) FILTER (severity = s), count(*), 0.9 FROM golden
          UNION ALL SELECT 'p0_safety_recall', count(*) FILTER (safe AND issue_type = 'Safety Concern' AND severity = 'P0'),
                           count(*) FILTER (safe), 1.0 FROM golden)
        SELECT metric, matches, total, {rounded('matches / total', 4)} AS value,
               {rounded('matches / total', 4)} >= gate AS passes FROM parts"""),
    "attach_metadata": f"""
        WITH {INDEX}
        SELECT id, (id % 10)::INTEGER AS relevance_rank,
               CASE WHEN id % 3 <> 0 AND id % 9 <> 0 THEN author ELSE 'Review' END AS author,
               CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN content ELSE 'link-' || id END AS content,
               CASE WHEN id % 3 <> 0 THEN score END AS score, CASE WHEN id % 3 <> 0 THEN date END AS date FROM scored""",
}
