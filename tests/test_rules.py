import pytest
from pyspark.sql import functions as F

from conftest import rows
from revlumen.functions.keywords import RuleTables
from revlumen.functions.rules import classify, needs_external_label
from revlumen.functions.text import is_low_signal, redact_pii
from revlumen.operators.evaluation import golden_evaluation, regression

# id, text, score, expected type, severity, safety, then what the rules give:
# type, severity, area, sentiment, confidence
GOLDEN = [
    ("g01", "can't login to my account", 1, "Bug", "P0", False, "Account/Auth", "P0", "Login/OTP", "Negative", 0.9),
    ("g02", "scam stole my money", 1, "Bug", "P0", False, "Trust/Fraud", "P0", "Unknown", "Negative", 0.9),
    ("g03", "crash detection didn't detect crash", 1, "Safety Concern", "P0", True,
     "Safety Concern", "P0", "Crash Detection", "Negative", 0.95),
    ("g04", "emergency alert failed sos", 1, "Safety Concern", "P0", True,
     "Safety Concern", "P0", "SOS", "Negative", 0.95),
    ("g05", "app won't open", 1, "Bug", "P0", False, "Performance", "P0", "Unknown", "Negative", 0.9),
    ("g06", "location not updating", 1, "Safety Concern", "P0", True,
     "Safety Concern", "P0", "Family Location", "Negative", 0.95),
    ("g07", "stopped sharing location", 1, "Safety Concern", "P0", True,
     "Safety Concern", "P0", "Unknown", "Negative", 0.95),
    ("g08", "wish there was a dark mode wow so nice long string", 4, "Feature Request", "FYI", False,
     "Feature Request", "P2", "Unknown", "Positive", 0.8),
    ("g09", "laggy and slow performance oh no", 2, "Performance", "P1", False,
     "Performance", "P1", "Unknown", "Negative", 0.85),
    ("g10", "charged me twice refund money long text string", 1, "Billing/Pricing", "P0", False,
     "Billing/Pricing", "P0", "Unknown", "Negative", 0.9),
    ("g11", "not getting notifications", 1, "Safety Concern", "P0", True,
     "Safety Concern", "P0", "Notifications", "Negative", 0.95),
    ("g12", "a c", 1, "Spam / Bot / Irrelevant", "FYI", False,
     "Spam / Bot / Irrelevant", "FYI", "Other", "Neutral", 1.0),
    ("g13", "123", 1, "Spam / Bot / Irrelevant", "FYI", False,
     "Spam / Bot / Irrelevant", "FYI", "Other", "Neutral", 1.0),
    ("g14", "good job loved it", 5, "Praise", "FYI", False, "Praise", "FYI", "Unknown", "Positive", 0.8),
    ("g15", "how to link plaid? long text string here", 3, "UX", "P2", False,
     "Unknown", "P2", "Bank Linking", "Neutral", 0.8),
    ("g16", "i love it very much", 5, "Praise", "FYI", False, "Praise", "FYI", "Unknown", "Positive", 0.8),
    ("g17", "freeze card is not freezing", 2, "Performance", "P1", False,
     "Performance", "P1", "Card Controls", "Negative", 0.85),
    ("g18", "allowance task confusing very confusing indeed", 3, "Bug", "P1", False,
     "UX", "P2", "Allowance/Chores", "Neutral", 0.8),
    ("g19", "money missing from account where did it go!!", 1, "Bug", "P0", False,
     "Payments/Transactions", "P0", "Unknown", "Negative", 0.9),
    ("g20", "sos button fails completely", 1, "Safety Concern", "P0", True,
     "Safety Concern", "P0", "SOS", "Negative", 0.95),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(
        [g[:6] for g in GOLDEN],
        "review_id string, content string, score int, expected_issue_type string, expected_severity string, "
        "is_safety boolean")


def labelled(spark, data):
    df = spark.createDataFrame(data, "content string, score int")
    return rows(classify(df), "issue_type", "feature_area", "severity", "sentiment", "confidence_score", "is_spam")


def test_golden_rows(golden):
    got = rows(classify(golden), "review_id", "issue_type", "severity", "feature_area", "sentiment",
               "confidence_score")
    assert sorted(got) == [(g[0], *g[6:]) for g in GOLDEN]


def test_golden_evaluation(golden):
    result = golden_evaluation(classify(golden), golden)
    assert rows(result) == [
        ("issue_type_accuracy", 14, 20, 0.7, False),
        ("severity_accuracy", 18, 20, 0.9, True),
        ("p0_safety_recall", 6, 6, 1.0, True),
    ]
    earlier = result.withColumn("value", F.col("value") + 0.03)
    assert all(r["is_regression"] for r in regression(result, earlier).collect())
    assert not any(r["is_regression"] for r in regression(result, result).collect())


def test_every_severity_branch(spark):
    got = labelled(spark, [
        ("Everything stops here plainly", 1),           # nothing applies
        ("The gps tracker is broken today", 1),          # safety area, negative, broken
        ("The gps tracker is broken today", 5),          # the same, rating too high
        ("There is an error in this thing", 2),          # degraded issue
        ("There is an error in this thing", 3),          # neutral sentiment -> P2
        ("The app can hang quite a lot", 3),             # slowdown needs no negative mood
        ("This is unauthorized use of it", 5),           # fraud words, rating too high
        ("Thanks anyway, nothing special", 2),           # praise word at a low rating
    ])
    assert [(g[0], g[2], g[3]) for g in got] == [
        ("Unknown", None, "Negative"),
        ("Safety Concern", "P0", "Negative"),
        ("Praise", "FYI", "Positive"),
        ("Bug", "P1", "Negative"),
        ("Bug", "P2", "Neutral"),
        ("Performance", "P1", "Neutral"),
        ("Trust/Fraud", "FYI", "Positive"),
        ("Praise", "FYI", "Positive"),
    ]


def test_matches_inside_words(spark):
    got = labelled(spark, [("Nothing to change over here", 1), ("Some feedback about the thing", 5)])
    assert got[0][0] == "Performance" and got[1][0] == "Billing/Pricing"


def test_missing_score_keeps_row(spark):
    got = labelled(spark, [("Something odd is going on", None), ("can't login any more", None)])
    assert got[0][:4] == ("Unknown", "Unknown", None, None)
    assert got[1][2] == "P0"


def test_tables_are_parameters(spark):
    df = spark.createDataFrame([("The widget's colour is wrong", 1)], "content string, score int")
    tables = RuleTables(features=(("Widgets", ("widget's",)),), issues=(("Bug", 0.7, ("colour",)),))
    assert rows(classify(df, tables=tables), "feature_area", "issue_type", "severity") == [("Widgets", "Bug", "P1")]


@pytest.mark.parametrize("text, expected", [
    ("Mail me at john.doe+x@example.co.uk now", "Mail me at [REDACTED] now"),
    ("Call +1-800-555-0199 or (800) 555-0199", "Call [REDACTED] or [REDACTED]"),
    ("Call 123.456.7890 today", "Call [REDACTED] today"),
    ("Seen at 37.7749, -122.4194 again", "Seen at [REDACTED] again"),
    ("It cost 5,000 in all", "It cost [REDACTED] in all"),
    ("Wide 37.1, 12.5 space", "Wide [REDACTED] space"),
    ("Nothing private here", "Nothing private here"),
    ("", ""),
    (None, None),
])
def test_redaction(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(redact_pii(F.col("t")).alias("r"))
    assert rows(df) == [(expected,)]
    again = spark.createDataFrame([(expected,)], "t string").select(redact_pii(F.col("t")).alias("r"))
    assert rows(again) == [(expected,)]


def test_low_signal_counts_whole_text(spark):
    far = "1" * 5000 + "abcdefghij"
    df = spark.createDataFrame([("abcdefghi 123 !!",), ("abcdefghij",), (far,), ("ééééééééééééé",), ("",)], "t string")
    assert [r[0] for r in rows(df.select(is_low_signal(F.col("t"))))] == [True, False, False, True, True]


def test_routing(spark):
    df = spark.createDataFrame(
        [(0.5, "SOS", "P2"), (0.9, "Unknown", "P2"), (0.9, "SOS", "P0"), (0.9, "SOS", "P1"), (0.9, "SOS", "FYI"),
         (0.9, "SOS", None)], "c double, a string, s string")
    got = df.select(needs_external_label(F.col("c"), F.col("a"), F.col("s")))
    assert [r[0] for r in rows(got)] == [True, True, True, True, False, False]


def test_label_filter_stays_above_the_cascade(spark):
    """A label filter must not drag keyword tests below the projections."""
    df = spark.createDataFrame([("x", 1)], "content string, score int")
    plan = classify(df).where("severity = 'P0'")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert len(filters) == 1 and "Contains" not in filters[0].split("Generate")[0]
    assert plan.lower().count("contains(_low") < 150
