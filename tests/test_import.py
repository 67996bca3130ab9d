import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from revlumen.operators import validity as V
from revlumen.plans.importing import import_reviews, index_rows
from revlumen.sources import readers, store
from revlumen.functions.timeutil import parse_ts
from revlumen.sources import index_table

CSV = '''review_id,content,score,thumbs_up_count,platform
a,"He said ""no""
and left",5,3,play_store
b,,4.7,0,app_store
a,duplicate,1,0,unknown

c,blank score,,0,play_store
d,blank thumbs,3,,play_store
e,bad platform,3,1,web
f,too high,9,1,unknown
'''


def test_csv_import(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(CSV)
    result = import_reviews(readers.read_csv_reviews(spark, str(path)))
    assert sorted(rows(result.reviews, "review_id", "content", "score")) == [
        ("a", 'He said "no"\nand left', 5), ("b", "", 4)]
    assert sorted(rows(result.rejected.select("review_id", F.array_join("invalid_reasons", ",")))) == [
        ("c", "score"), ("d", "thumbs_up_count"), ("e", "platform"), ("f", "score")]
    counts = result.diagnostics.first()
    assert (counts["total_reviews_input"], counts["invalid_rows_dropped"], counts["duplicates_dropped"],
            counts["filtered_spam"], counts["total_processed"]) == (7, 4, 1, 5, 2)
    assert counts["spam_ratio"] == pytest.approx(5 / 7) and counts["cost_estimate_usd"] == pytest.approx(2.2e-6)


def test_first_row_follows_file_order(spark, tmp_path):
    """Keep-first goes by file name and row, not by how Spark packs files."""
    (tmp_path / "1.csv").write_text("review_id,content,score\nx,first,1\n")
    (tmp_path / "2.csv").write_text("review_id,content,score\nx,second,1\n" + "y,filler text,2\n" * 500)
    result = import_reviews(readers.read_csv_reviews(spark, str(tmp_path)))
    assert dict(rows(result.reviews, "review_id", "content"))["x"] == "first"


def test_missing_columns_make_rows_invalid(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,content\nx,text\n")
    checked = import_reviews(readers.read_csv_reviews(spark, str(tmp_path / "a.csv"))).rejected
    assert rows(checked, "review_id", "invalid_reasons") == [("x", ["score"])]


def test_csv_round_trip(spark, tmp_path):
    raw = spark.createDataFrame(
        [("1", "play_store", 'An "odd" user', 'two\nlines, and a "quote"', 4, "1.0", "d", "", "2026-02-01T00:00:00Z")],
        ", ".join(f"{c} {'int' if c == 'score' else 'string'}" for c in store.CSV_COLUMNS))
    store.write_reviews_csv(raw, str(tmp_path / "out"))
    back = import_reviews(readers.read_csv_reviews(spark, str(tmp_path / "out"))).reviews
    assert rows(back, *store.CSV_COLUMNS) == rows(raw)


def test_json_import(spark, tmp_path):
    path = tmp_path / "reviews.json"
    path.write_text(json.dumps([
        {"review_id": "a", "content": "ok", "score": 4, "extra": 1},
        {"id": "b", "content": "ok", "score": "2 stars", "date": "2026-02-01", "author": "Ann"},
        {"review_id": 7, "content": "number id", "score": 3},
        {"review_id": "d", "content": None, "score": 3},
        {"review_id": "e", "content": "fraction", "score": 3.5},
        {"review_id": "f", "content": "null option", "score": 3, "device": None},
        {"review_id": "g", "content": "whole float", "score": 3.0, "thumbs_up_count": 2},
        {"review_id": "h", "content": "bool", "score": True},
        {"review_id": "i", "content": "huge", "score": 1e30},
        {"content": "no id", "score": 1},
    ]))
    result = import_reviews(readers.read_json_reviews(spark, str(path), extra_fields=["extra"]))
    assert sorted(rows(result.reviews, "review_id", "score", "review_created_at", "user_name", "thumbs_up_count")) == [
        ("a", 4, None, None, None), ("b", 2, "2026-02-01", "Ann", None), ("g", 3, None, None, 2)]
    reasons = {r["content"]: r["invalid_reasons"] for r in result.rejected.collect()}
    assert reasons["number id"] == ["review_id"] and reasons["fraction"] == ["score"]
    assert reasons["huge"] == ["score"]
    assert reasons["null option"] == ["device"] and reasons["bool"] == ["score"]
    assert reasons[None] == ["content"] and reasons["no id"] == ["review_id"]


def test_json_must_be_an_array(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"review_id": "a", "content": "x", "score": 1}')
    with pytest.raises(ValueError):
        readers.read_json_reviews(spark, str(tmp_path / "one.json"))
    lines = readers.read_json_reviews(spark, str(tmp_path / "one.json"), lines=True)
    assert rows(import_reviews(lines).reviews, "review_id") == [("a",)]


def test_parquet_import_prunes_and_pushes(spark, tmp_path):
    df = spark.createDataFrame([("a", "text", 3, 0), ("b", "text", 9, 1)], "review_id string, content string, score int, seq bigint")
    df.write.parquet(str(tmp_path / "p"))
    result = import_reviews(readers.read_parquet_reviews(spark, str(tmp_path / "p")))
    assert rows(result.reviews, "review_id") == [("a",)]


@pytest.mark.parametrize("value, expected", [
    ("4.7", 4), ("5 stars", 5), (" -3x", -3), ("+2", 2), ("", None), ("abc", None), ("3", 3)])
def test_leading_integer(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert rows(df.select(V.leading_integer(F.col("v")))) == [(expected,)]


def test_dedupe_equals_distinct_ids_on_any_partitioning(spark):
    df = spark.range(0, 900).select(F.concat(F.lit("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
                                    .alias("review_id"), F.col("id").alias("seq"))
    one, many = (sorted(rows(V.keep_first(df.repartition(n)))) for n in (1, 8))
    assert one == many and len(one) == df.select("review_id").distinct().count()
    assert sorted(rows(V.keep_first_by_lookup(df))) == one


def test_lookup_dedupe_does_not_shuffle_rows(spark, tmp_path):
    """Also with the struct order that the file readers give."""
    (tmp_path / "1.csv").write_text("review_id,content,score\nx,first,1\n" + "".join(
        f"k{i},some text,2\n" for i in range(50)))
    (tmp_path / "2.csv").write_text("review_id,content,score\nx,second,1\nk7,later,1\n")
    raw = readers.read_csv_reviews(spark, str(tmp_path))
    result = import_reviews(raw, few_duplicates=True).reviews
    assert sorted(rows(result, "review_id", "content")) == sorted(rows(import_reviews(raw).reviews, "review_id", "content"))
    result.collect()
    assert "hashpartitioning" not in result._jdf.queryExecution().executedPlan().toString()


def test_dedupe_limits_rows_before_the_shuffle(spark):
    plan = V.keep_first(spark.range(9).selectExpr("id % 3 as review_id", "id as seq"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_analytics_rows_fail_as_a_whole(spark):
    columns = "review_id string, issue_type string, feature_area string, severity string, score int"
    good = spark.createDataFrame([("a", "x", "y", None, None), ("b", "x", "y", "P0", 5)], columns)
    assert V.require_analytics_rows(good) is good
    for bad in (("a", "x", "y", "P9", 1), ("a", "x", "y", "P0", 6), (None, "x", "y", None, 1)):
        with pytest.raises(ValueError):
            V.require_analytics_rows(good.union(spark.createDataFrame([bad], columns)))


def test_incremental_append(spark, tmp_path):
    path = str(tmp_path / "index")
    spark.createDataFrame([("a", 1)], "review_id string, v int").write.parquet(path)
    V.append_new(spark.createDataFrame([("a", 2), ("b", 3)], "review_id string, v int"), path)
    assert sorted(rows(spark.read.parquet(path), "review_id", "v")) == [("a", 1), ("b", 3)]


def test_embedding_validity(spark):
    data = [([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,)]
    df = spark.createDataFrame(data, "e array<float>")
    assert [r[0] for r in rows(df.select(V.is_valid_embedding(F.col("e"), 2)))] == [True] + [False] * 5
    reviews = spark.createDataFrame([("a", "t", 1, "u", "d")],
                                    "review_id string, content string, score int, user_name string, review_created_at string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "review_id string, embedding array<float>")
    assert rows(index_rows(reviews, vectors, 2), "id", "author", "date") == [("a", "u", "d")]


def test_store_payload(spark):
    now = F.lit("2026-03-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame(
        [("1", "Ann", "a\nb", 5, "2.0", None, "2026-02-01T00:00:00Z"), ("2", None, None, 4, "", "junk", "2026-02-01"),
         ("3", "", "t", 1, None, None, None)],
        "id string, userName string, text string, score int, version string, date string, updated string")
    got = rows(store.normalize_payload(df, "app_store", now), "review_id", "user_name", "content", "app_version",
               "review_created_at")
    assert got == [("1", "Ann", "a b", "2.0", "2026-02-01T00:00:00.000Z"),
                   ("2", "Anonymous", "", "Unknown", "2026-03-01T00:00:00.000Z"),
                   ("3", "Anonymous", "t", "Unknown", "2026-03-01T00:00:00.000Z")]


def test_payload_dates_of_other_types(spark):
    now = F.lit("2026-03-01 00:00:00").cast("timestamp")
    df = spark.sql("select '1' id, '' userName, 't' text, 1 score, '' version, 1769904000000L date, "
                   "timestamp'2026-05-01' updated union all "
                   "select '2', '', 't', 1, '', null, timestamp'2026-05-01'")
    got = rows(store.normalize_payload(df, "app_store", now).orderBy("review_id"), "review_created_at")
    assert got == [("2026-02-01T00:00:00.000Z",), ("2026-05-01T00:00:00.000Z",)]


def test_store_links(spark):
    df = spark.createDataFrame([
        ("https://play.google.com/store/apps/details?id=com.example.app&hl=en",),
        ("https://apps.apple.com/us/app/example/id1234567890?mt=8",), ("https://play.google.com/store?hl=en",),
        ("https://apps.apple.com/us/app/example",), ("https://example.com/?id=x",)], "url string")
    got = rows(df.select(*store.app_link_columns(F.col("url"))))
    assert got[0] == ("play_store", "com.example.app", None)
    assert got[1] == ("app_store", "1234567890", None)
    assert [g[1] for g in got[2:]] == [None] * 3 and all(g[2] for g in got[2:])


def test_index_table_loads_can_be_repeated(spark, tmp_path):
    path, schema = str(tmp_path / "index"), "review_id string, v int, place int"
    assert index_table.read_index(spark, path) is None
    first = spark.createDataFrame([("a", 1, 2), ("a", 9, 1), ("b", 2, 0), (None, 3, 0)], schema)
    for _ in range(2):
        index_table.load_new(first, path, "day-1", order="place")
    held = index_table.read_index(spark, path)
    assert sorted(rows(held, "review_id", "v")) == [("a", 9), ("b", 2)]
    more = spark.createDataFrame([("b", 5, 0), ("c", 6, 0), ("c", 7, 1)], schema)
    for _ in range(2):
        index_table.load_new(more, path, "day-2", order="place")
    # Nothing new: the load is there, and empty.
    index_table.load_new(first, path, "day-3", order="place")
    assert sorted(rows(index_table.read_index(spark, path), "review_id", "v", "load")) == [
        ("a", 9, "day-1"), ("b", 2, "day-1"), ("c", 6, "day-2")]
    with pytest.raises(ValueError):
        index_table.load_new(more, path, "../day")


def test_index_table_ignores_what_a_crashed_load_left(spark, tmp_path):
    path, schema = str(tmp_path / "index"), "review_id string, v int"
    index_table.load_new(spark.createDataFrame([("a", 1)], schema), path, "one")
    index_table.load_new(spark.createDataFrame([("b", 2)], schema), path, "two")
    (tmp_path / "index" / "load=two" / "_SUCCESS").unlink()
    assert rows(index_table.read_index(spark, path), "review_id") == [("a",)]
    index_table.load_new(spark.createDataFrame([("a", 5), ("b", 3)], schema), path, "two")
    assert sorted(rows(index_table.read_index(spark, path), "review_id", "v")) == [("a", 1), ("b", 3)]


def test_append_adds_one_row_per_id(spark, tmp_path):
    path = str(tmp_path / "twice")
    twice = spark.createDataFrame([("a", 1), ("a", 1)], "review_id string, v int")
    V.append_new(twice, path)
    V.append_new(twice, path)
    assert rows(spark.read.parquet(path)) == [("a", 1)]


def test_lookup_dedupe_shuffles_no_texts(spark, capsys):
    df = spark.range(3000).selectExpr("concat('r', id % 2900) AS review_id", "repeat('text', 50) AS content", "id AS seq")
    kept = V.keep_first_by_lookup(df)
    assert sorted(rows(kept, "review_id", "seq")) == sorted(rows(V.keep_first(df), "review_id", "seq"))
    kept.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("value, there", [
    ("12:30", False), ("T12:30:00", False), ("12:30:45.1234", False), ("2026", True), (" 2026-02-01", True),
    ("2026-02-01T10:00:00Z", True), ("Feb 1, 2026", True), ("soon", False), ("", False)])
def test_a_date_names_its_year(spark, value, there):
    got = spark.createDataFrame([(value,)], "d string").select(parse_ts(F.col("d"))).first()[0]
    assert (got is not None) == there
