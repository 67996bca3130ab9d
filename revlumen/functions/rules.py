"""The review classifier: an ordered keyword cascade in staged columns.

Each stage adds a few columns that later stages read several times. Catalyst
keeps such a stage as its own projection, so a keyword scan runs once per row.
The last stage passes through ``inline``: filters on the labels then stop above
it and do not drag copies of the keyword tests below, while filters on the
input columns (dates, ids) still reach the scan.

The keyword tests are written as SQL text: the tables hold over a hundred
words, and one expression per stage is far cheaper to build than a column
object per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlumen.functions import keywords as K
from revlumen.functions.text import any_word, is_low_signal, redact_pii, sql_string

LABEL_COLUMNS = (
    "issue_type", "feature_area", "severity", "sentiment", "confidence_score",
    "classification_source", "is_spam",
)

# Outcomes of the severity cascade, in order of precedence.
SPAM, CRITICAL, SAFETY, MAJOR, MINOR, NOTE, NONE = range(7)


def first_match(column: str, groups) -> str:
    """SQL for the label of the first ``(label, words)`` group with a hit."""
    cases = " ".join(f"WHEN {any_word(column, words)} THEN {sql_string(label)}" for label, words in groups)
    return f"CASE {cases} ELSE 'Unknown' END" if cases else "'Unknown'"


def _one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(sql_string(v) for v in values)})"


SENTIMENT = "CASE WHEN score >= 4 THEN 'Positive' WHEN score = 3 THEN 'Neutral' WHEN score <= 2 THEN 'Negative' END"


def _severity_step(tables: K.RuleTables) -> str:
    """SQL for the outcome of the severity cascade."""
    tests = (
        ("is_spam", SPAM),
        (any_word("_low", tables.critical), CRITICAL),
        (f"score <= 2 AND {any_word('_low', tables.fraud)}", CRITICAL),
        ("_issue = 'Safety Concern'", SAFETY),
        (any_word("_low", tables.safety_failure), SAFETY),
        (f"{_one_of('_area', K.SAFETY_AREAS)} AND _mood = 'Negative' AND {any_word('_low', tables.broken)} "
         f"AND {any_word('_low', tables.safety_mentions)}", SAFETY),
        (f"{_one_of('_issue', K.DEGRADED_ISSUES)} AND score <= 3 AND _mood = 'Negative'", MAJOR),
        (f"{_one_of('_issue', K.SLOWDOWN_ISSUES)} AND score <= 3 AND {any_word('_low', tables.slowdown)}", MAJOR),
        ("score = 4 OR _mood = 'Neutral'", MINOR),
        ("score >= 4", NOTE),
        (any_word("_low", tables.praise), NOTE),
    )
    cases = " ".join(f"WHEN {test} THEN {step}" for test, step in tests)
    return f"CASE {cases} ELSE {NONE} END"


def _labels(tables: K.RuleTables) -> str:
    """SQL struct of the final labels, from the staged columns only."""
    spam_type, spam_area, spam_severity, spam_mood, spam_score = K.SPAM_LABELS
    table_score = " ".join(f"WHEN {sql_string(name)} THEN {score}D" for name, score, _ in tables.issues)
    table_score = f"CASE _issue {table_score} ELSE 0D END"
    return f"""named_struct(
        'issue_type', CASE WHEN _step = {SPAM} THEN {sql_string(spam_type)}
            WHEN _step = {SAFETY} THEN 'Safety Concern'
            WHEN _issue = 'Unknown' AND _step IN ({CRITICAL}, {MAJOR}) THEN 'Performance'
            WHEN _issue = 'Unknown' AND _step = {NOTE} THEN 'Praise'
            ELSE _issue END,
        'feature_area', CASE WHEN _step = {SPAM} THEN {sql_string(spam_area)} ELSE _area END,
        'severity', CASE WHEN _step = {SPAM} THEN {sql_string(spam_severity)}
            WHEN _step IN ({CRITICAL}, {SAFETY}) THEN 'P0' WHEN _step = {MAJOR} THEN 'P1'
            WHEN _step = {MINOR} THEN 'P2' WHEN _step = {NOTE} THEN 'FYI' END,
        'sentiment', CASE WHEN _step = {SPAM} THEN {sql_string(spam_mood)}
            WHEN _step = {NOTE} THEN 'Positive' ELSE _mood END,
        'confidence_score', CASE WHEN _step = {SPAM} THEN {spam_score}D ELSE greatest(
            CASE WHEN _area = 'Unknown' THEN 0D ELSE {K.FEATURE_SCORE}D END,
            CASE _step WHEN {CRITICAL} THEN {K.CRITICAL_SCORE}D WHEN {SAFETY} THEN {K.SAFETY_SCORE}D
                WHEN {MAJOR} THEN {K.MAJOR_SCORE}D WHEN {MINOR} THEN {K.MINOR_SCORE}D
                WHEN {NOTE} THEN greatest({table_score}, {K.MINOR_SCORE}D) ELSE {table_score} END,
            CASE _mood WHEN 'Positive' THEN {K.POSITIVE_SCORE}D WHEN 'Neutral' THEN {K.NEUTRAL_SCORE}D
                WHEN 'Negative' THEN {K.NEGATIVE_SCORE}D ELSE 0D END) END,
        'classification_source', 'rule_engine',
        'is_spam', is_spam)"""


def classify(df: DataFrame, content: str = "content", tables: K.RuleTables = K.DEFAULT_TABLES) -> DataFrame:
    """Add ``text`` (redacted) and the label columns to a frame of reviews.

    Needs the columns ``content`` and ``score``. The rules read the redacted
    text. No shuffle; works on batch and streaming frames.
    """
    kept = [c for c in df.columns if c not in LABEL_COLUMNS and c != "text"]
    staged = (
        df.select(*kept, redact_pii(F.col(content)).alias("text"))
        .select("*", F.lower("text").alias("_low"), F.coalesce(is_low_signal(F.col("text")), F.lit(True)).alias("is_spam"),
                F.expr(SENTIMENT).alias("_mood"))
        .select("*", F.expr(first_match("_low", tables.features)).alias("_area"),
                F.expr(first_match("_low", [(n, w) for n, _, w in tables.issues])).alias("_issue"))
        .select("*", F.expr(_severity_step(tables)).alias("_step"))
    )
    return staged.select(*kept, "text", F.expr(f"inline(array({_labels(tables)}))"))


def needs_external_label(confidence: Column, feature_area: Column, severity: Column) -> Column:
    """Whether a rule result should be refined by an external label."""
    return F.coalesce(
        (confidence < 0.60) | (feature_area == "Unknown")
        | F.coalesce(severity.isin("P0", "P1"), F.lit(False)),
        F.lit(False),
    )
