import pytest
from pyspark.sql import functions as F

from conftest import SMALL, analytics_frame, rows
from revlumen.operators import calls, exports
from revlumen.operators.labels import enrich, merge_labels
from revlumen.operators.running import running_total
from revlumen.functions.rules import classify
from revlumen.plans import alerts, analyze
from revlumen.sources import event_reviews as source

REVIEWS = (
    ("1", "A perfectly fine day outside", 5, "2026-02-01T00:00:00Z"),
    ("2", "can't login, mail me at a.b@example.com", 1, "2026-02-03T00:00:00Z"),
    ("3", "The app is slow and laggy here", 2, "2026-02-02T00:00:00Z"),
    ("4", "!!! 123", 1, None),
)


@pytest.fixture
def reviews(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(REVIEWS)],
                               "review_id string, content string, score int, review_created_at string, seq bigint")
    return df.withColumn("review_ts", F.try_to_timestamp("review_created_at"))


def test_alerts(reviews):
    got = rows(alerts.critical_alerts(reviews), "review_id", "text", "severity", "requires_immediate_attention")
    assert got == [("2", "can't login, mail me at [REDACTED]", "P0", True),
                   ("3", "The app is slow and laggy here", "P1", False)]
    assert rows(alerts.critical_alerts(reviews, limit=1), "review_id") == [("2",)]
    raw = rows(alerts.critical_alerts(reviews, include_raw_text=True), "text")
    assert raw[0] == ("can't login, mail me at a.b@example.com",)
    meta = alerts.alert_metadata(reviews, total_input=6, limit=1).first()
    assert (meta["total_reviews_input"], meta["filtered_spam"], meta["total_processed"], meta["total_alerts"],
            meta["returned_alerts"], meta["warnings"]) == (6, 1, 5, 2, 1, [])
    with pytest.raises(ValueError):
        alerts.critical_alerts(reviews, limit=0)


def label_table(spark, data):
    return spark.createDataFrame(data, "review_id string, raw_response string, error_message string, model string, "
                                       "input_tokens bigint, output_tokens bigint")


def test_merge_labels(spark, reviews):
    table = label_table(spark, [
        ("1", '{"issue_type": "UX", "feature_area": "SOS"}', None, "gpt-4o", 0, 0),
        ("2", '{"severity": "CRITICAL", "issue_type": "Bug"}', None, "gpt-4o", 10, 10),
        ("3", None, "request timeout", "gpt-4o", 10, 10),
        ("4", '{"severity": "P0"}', None, "gpt-4o", 10, 10)])
    merged = {r["review_id"]: r for r in merge_labels(classify(reviews), table).collect()}
    assert (merged["1"]["issue_type"], merged["1"]["feature_area"], merged["1"]["severity"],
            merged["1"]["classification_source"]) == ("UX", "SOS", "FYI", "hybrid")
    assert (merged["2"]["issue_type"], merged["2"]["severity"], merged["2"]["classification_source"]) == (
        "Account/Auth", "P0", "rule_engine")
    assert (merged["3"]["classification_source"], merged["3"]["fallback_reason"]) == ("rule_engine", "timeout")
    assert merged["4"]["is_spam"] and not merged["4"]["needs_label"]


def test_truncated_json_is_an_empty_answer(spark):
    df = spark.createDataFrame([("a", "Something is quite odd", 2)], "review_id string, content string, score int")
    table = label_table(spark, [("a", '{"severity":"P0"', None, "m", 1, 1)])
    got = merge_labels(classify(df), table).first()
    assert (got["issue_type"], got["severity"], got["classification_source"]) == ("Performance", None, "hybrid")


def test_analyze_and_metadata(spark, reviews):
    out = {r["review_id"]: r for r in analyze.analyze(reviews).collect()}
    assert set(out) == {"1", "2", "3"}
    assert out["2"]["text"].endswith("[REDACTED]") and out["2"]["signals"]["device"] == "Unknown"
    assert analyze.analyze(reviews, include_raw_text=True).where("review_id = '2'").first()["text"].endswith(".com")
    classified = analyze.classify_reviews(reviews, recent_limit=3)
    meta = analyze.analyze_metadata(classified, available=4).first()
    assert (meta["total_reviews_input"], meta["total_reviews_available"], meta["sampled"], meta["filtered_spam"],
            meta["rule_only_count"]) == (3, 4, True, 0, 3)
    whole = analyze.analyze_metadata(analyze.classify_reviews(reviews)).first()
    assert whole["spam_ratio"] == 0.25 and whole["warnings"] == [analyze.WARNING_SPAM]
    assert not whole["degraded_mode"]


def test_analyzed_layout(spark):
    from revlumen.schema import ANALYZED_REVIEW, RAW_REVIEW
    base = source.reviews_from_events(source.read_events(spark, SMALL))
    raw = {f.name: f.dataType for f in RAW_REVIEW.fields}
    assert all(raw[f.name] == f.dataType for f in base.schema.fields)
    got = analyze.analyze(base).schema
    assert {f.name for f in got.fields} == set(ANALYZED_REVIEW.names)
    flat = {f.name: f.dataType.simpleString() for f in ANALYZED_REVIEW.fields}
    assert {f.name: f.dataType.simpleString() for f in got.fields} == flat


def test_summarize(spark):
    from revlumen.plans.weekly import summarize
    summary = summarize(analyze.analyze(source.reviews_from_events(source.read_events(spark, SMALL))))
    counts = summary.severity_counts.first()
    assert sum(counts) == sum(r["review_count"] for r in summary.heatmap.collect())
    assert len(summary.themes.first()["top_themes"]) == 3


def test_severity_parts_sum_to_cluster_counts(spark):
    from revlumen.operators.issues import issue_clusters
    rows_in = analyze.analyze(source.reviews_from_events(source.read_events(spark, SMALL)))
    clusters = issue_clusters(rows_in).collect()
    assert all(c["review_count"] == c["p0_count"] + c["p1_count"] + c["p2_count"] + c["fyi_count"] for c in clusters)
    assert sum(c["review_count"] for c in clusters) == rows_in.count()


def test_budget_charges_answers_once(spark, reviews):
    failed_first = [("3", None, "timeout", "gpt-4o", 1000, 1000)]
    answered = [(i, '{"severity": "P2"}', None, "gpt-4o", 1000, 1000) for i in ("1", "2")] * 2
    guarded = analyze.apply_budget(analyze.classify_reviews(reviews), label_table(spark, failed_first + answered), 0.03)
    routed = rows(guarded.where("needs_label"), "review_id", "within_budget")
    assert sorted(routed) == sorted(set(routed)) and dict(routed)["3"] and dict(routed)["2"] and dict(routed)["1"]


def test_budget_falls_back(spark, reviews):
    table = label_table(spark, [(r[0], '{"severity": "P2"}', None, "gpt-4o", 1000, 1000) for r in REVIEWS])
    classified = analyze.classify_reviews(reviews)
    # Each call costs 0.02 USD; the newest two fit.
    guarded = analyze.apply_budget(classified, table, 0.03)
    merged = merge_labels(guarded.drop("fallback_reason", "needs_label"), table)
    got = dict(rows(merged.where("not is_spam"), "review_id", "classification_source"))
    assert got == {"2": "hybrid", "3": "hybrid", "1": "rule_engine"}
    meta = analyze.analyze_metadata(merged, labels=table).first()
    assert meta["budget_guardrail_count"] == 1 and analyze.WARNING_BUDGET in meta["warnings"]
    assert meta["degraded_reasons"] == ["budget_guardrail"] and meta["llm_routed_count"] == 2
    assert meta["cost_estimate_usd"] == pytest.approx(0.04) and meta["rule_coverage_drop"]


def test_enrich(spark):
    left = analytics_frame(spark, [(i, "Bug", "SOS", "P0", None, 1, None, None) for i in ("a", "b")])
    raw = spark.createDataFrame([("a", "ios", 1), ("a", "android", 0)], "review_id string, platform string, seq bigint")
    assert sorted(rows(enrich(left, raw, ["platform"]), "review_id", "platform")) == [("a", "android"), ("b", None)]


def call_log(spark, outcomes, key="k"):
    return spark.createDataFrame([(key, i, i, ok) for i, ok in enumerate(outcomes)],
                                 "call_key string, ts bigint, seq bigint, ok boolean")


@pytest.mark.parametrize("outcomes, trip", [
    ([True] * 42 + [False] * 8, 50), ([True] * 43 + [False] * 7, None), ([False] * 10, 10),
    ([False] * 9 + [True, False], None), ([False] * 8 + [True] * 42, None), ([False] * 8 + [True] * 42 + [False], 51)])
def test_call_health(spark, outcomes, trip):
    got = calls.call_health(call_log(spark, outcomes)).first()
    assert (got["first_trip"], got["tripped"]) == (trip, trip is not None)
    assert (got["calls"], got["failures"]) == (len(outcomes), outcomes.count(False))


def brute_trips(outcomes):
    streak, trips = 0, []
    for i, ok in enumerate(outcomes):
        streak = 0 if ok else streak + 1
        window = outcomes[max(0, i - 49): i + 1]
        rate = len(window) == 50 and window.count(False) / 50 >= 0.15
        trips.append((i + 1, not ok and streak >= 10, not ok and rate))
    return trips


def test_call_states_across_slices_and_blocks(spark, monkeypatch):
    """One key with most of the rows, cut into many slices and small blocks."""
    import random
    random.seed(7)
    hot = [random.random() > 0.14 for _ in range(700)] + [False] * 25 + [True] * 60
    cold = [random.random() > 0.3 for _ in range(70)]
    log = call_log(spark, hot, "hot").union(call_log(spark, cold, "cold")).union(
        call_log(spark, [False] * 12, None))
    monkeypatch.setattr(calls, "with_lookback_blocks",
                        lambda df, position, reach: __import__("revlumen.operators.running", fromlist=["x"])
                        .with_lookback_blocks(df, position, reach, block_rows=64))
    states = calls.call_states(log)
    for key, outcomes in (("hot", hot), ("cold", cold)):
        got = sorted(rows(states.where(F.col("call_key") == key), "position", "trips_on_streak", "trips_on_rate"))
        assert got == brute_trips(outcomes)
    assert states.where("call_key is null and trips_on_streak").count() == 3


def test_running_total_equals_brute_force(spark):
    data = [(("hot" if i % 3 else f"k{i % 7}"), i % 11, i, i * i % 17) for i in range(500)]
    df = spark.createDataFrame(data, "k string, t int, seq bigint, v bigint")
    for slices in (1, 5, 16):
        got = running_total(df, ["k"], [F.col("t").desc(), F.col("seq")], F.col("v"), "before", slices)
        want = {}
        for k in {d[0] for d in data}:
            total = 0
            for d in sorted((d for d in data if d[0] == k), key=lambda d: (-d[1], d[2])):
                want[d[2]] = total
                total += d[3]
        assert dict(rows(got, "seq", "before")) == want


def test_costs(spark):
    df = spark.createDataFrame(
        [("gpt-4o-mini", 10 ** 6, 10 ** 6, True), (None, 10 ** 6, 10 ** 6, True), ("x-GPT-4o", 0, None, True),
         ("claude-3-haiku", 1, 1, False)],
        "model string, input_tokens bigint, output_tokens bigint, ok boolean")
    got = {r["model"]: r for r in calls.token_cost(df).collect()}
    assert got["gpt-4o-mini"]["cost_usd"] == 0.75 and got[None]["cost_usd"] == 1.5
    assert got["x-GPT-4o"]["input_tokens"] == 50 and got["x-GPT-4o"]["cost_usd"] == 0.001
    assert "claude-3-haiku" not in got


def test_failure_classes(spark):
    df = spark.createDataFrame([("Timeout!",), ("status 429",), ("rate cap",), ("boom",), (None,)], "m string")
    assert [r[0] for r in rows(df.select(calls.failure_class(F.col("m"))))] == [
        "timeout", "rate_limited", "rate_limited", "provider_failure", "provider_failure"]


def export_rows(spark):
    df = analytics_frame(spark, [("1", "Bug", "Login", "P0", "Negative", 1, None, None),
                                 ("2", "Praise", "UI", "FYI", "Positive", 5, None, None),
                                 ("3", "UX", "UI", "P1", "Negative", 2, None, None)])
    return df.withColumn("signals", F.struct(
        F.when(F.col("review_id") == "1", "Pixel").otherwise("").alias("device"),
        F.lit(None).cast("string").alias("os_version"), F.lit("1.0").alias("app_version")))


def test_tickets(spark, tmp_path):
    got = exports.tickets(exports.require_exportable(export_rows(spark))).select("fields.*").collect()
    assert got[0]["summary"] == "[P0] Login: Bug Report" and got[0]["project"]["key"] == "APP"
    assert [g["issuetype"]["name"] for g in got] == ["Bug", "Task", "Task"]
    assert got[0]["description"].splitlines()[-2:] == ["Device: Pixel", "App Version: 1.0"]
    assert "Device" not in got[1]["description"] and "OS" not in got[0]["description"]
    exports.write_tickets(export_rows(spark), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 3
    with pytest.raises(ValueError):
        exports.require_exportable(export_rows(spark).withColumn("issue_type", F.lit("")))


def test_markdown(spark, tmp_path):
    exports.write_markdown(export_rows(spark), str(tmp_path / "m"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "m")).coalesce(1).collect())
    lines = [r["line"] for r in exports.markdown_lines(export_rows(spark)).orderBy("section", "part", "seq").collect()]
    assert "\n".join(lines) == (
        "*App Reviews Report*\n\n*P0 Critical Issues (1)*\n- *[Login]* Bug (ID: 1)\n\n*P1 High Priority (1)*\n"
        "- *[UI]* UX (ID: 3)\n\n*Other Reports (1)*\n- [FYI] UI - Praise")
    assert sorted(text.splitlines()) == sorted(lines)
    assert exports.markdown_text(export_rows(spark)) == "\n".join(lines)
    with pytest.raises(ValueError):
        exports.markdown_text(export_rows(spark), max_rows=2)
    assert rows(exports.markdown_lines(export_rows(spark).limit(0)), "line") == [("*No reviews to report.*",)]


def test_file_to_reports(spark, tmp_path):
    """CSV in, every report out; input order comes from the files."""
    from revlumen.operators.issues import segment_breakdown, top_issues
    from revlumen.plans.importing import import_reviews
    from revlumen.sources.readers import read_csv_reviews
    head = "review_id,content,score,device,review_created_at\n"
    (tmp_path / "a.csv").write_text(head + "z,can't login today,1,Pixel,2026-02-01T10:00:00Z\n"
                                           "y,the login code is wrong,3,,2026-02-02\n")
    (tmp_path / "b.csv").write_text(head + "x,can't login again,1,Pixel,\ny,duplicate row here,1,,\nw,123,1,,\n")
    analyzed = analyze.analyze(import_reviews(read_csv_reviews(spark, str(tmp_path))).reviews)
    top = top_issues(analyzed).first()
    assert (top["issue_key"], top["review_count"], top["example_review_ids"]) == ("Account/Auth::Login/OTP", 2, ["z", "x"])
    assert exports.markdown_text(analyzed).splitlines()[2:5] == [
        "*P0 Critical Issues (2)*", "- *[Login/OTP]* Account/Auth (ID: z)", "- *[Login/OTP]* Account/Auth (ID: x)"]
    assert rows(segment_breakdown(analyzed, "device"), "segment_value", "issue_count") == [("Pixel", 2), ("unknown", 1)]
    assert analyze.analyze_metadata(analyze.classify_reviews(
        import_reviews(read_csv_reviews(spark, str(tmp_path))).reviews)).first()["filtered_spam"] == 1


def test_literal_rows_to_reports(spark):
    """Rows made by hand need neither ``seq`` nor a parsed date."""
    from revlumen.operators.issues import time_trends
    from revlumen.plans.importing import import_reviews
    raw = spark.createDataFrame(
        [("b", "there is a bug in it", "2", "2026-02-01"), ("a", "there is a bug here", "1", "2026-02-02T10:00:00Z"),
         ("b", "the later one is dropped", "1", None)],
        "review_id string, content string, score string, date string")
    reviews = import_reviews(raw).reviews
    assert sorted(rows(reviews, "review_id", "content"))[1] == ("b", "there is a bug in it")
    bare = spark.createDataFrame([("a", "there is a bug here", 1, "2026-02-02T10:00:00Z")],
                                 "review_id string, content string, score int, review_created_at string")
    for frame, days in ((reviews, 2), (bare, 1)):
        analyzed = analyze.analyze(frame)
        assert time_trends(analyzed, "day").count() == days
        assert "Bug" in exports.markdown_text(analyzed)
        assert analyze.analyze_metadata(analyze.classify_reviews(frame)).first()["total_processed"] == days


def test_counts_of_derived_reviews(spark):
    classified = classify(source.reviews_from_events(source.read_events(spark, "/root/testdata/sf0.01")))
    got = dict(rows(classified.groupBy(F.coalesce("severity", F.lit("none")).alias("s")).count()))
    assert got == {"P0": 2566, "P1": 1164, "P2": 2845, "FYI": 2245, "none": 1180}
    assert classified.where("is_spam").count() == 438
    assert classified.where("not is_spam").select("issue_type", "feature_area").distinct().count() == 27


def test_results_do_not_depend_on_partitions(spark):
    from revlumen.operators.issues import top_issues
    base = analyze.analyze(source.reviews_from_events(source.read_events(spark, SMALL)))
    one, many = (rows(top_issues(base.repartition(n))) for n in (1, 8))
    assert one == many


def test_exports_hold_the_contract(spark, tmp_path):
    good = export_rows(spark)
    bad = good.withColumn("severity", F.when(F.col("review_id") == good.first()["review_id"], "P7").otherwise(F.col("severity")))
    for number, write in enumerate((exports.write_tickets, exports.write_markdown)):
        with pytest.raises(ValueError):
            write(bad, str(tmp_path / f"bad-{number}"))
        assert not (tmp_path / f"bad-{number}").exists()
        write(good, str(tmp_path / f"good-{number}"))
    unlabelled = good.withColumn("feature_area", F.lit(None).cast("string"))
    assert all("Unknown" in r[0] for r in exports.tickets(unlabelled).select("fields.summary").collect())
    assert all(r["line"] is not None for r in exports.markdown_lines(unlabelled).collect())
