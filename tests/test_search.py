import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from revlumen.operators import nearest as N
from revlumen.functions import vectors as V
from revlumen.operators import search as S

SCHEMA = "id bigint, embedding array<float>"


def brute(vectors, queries, k, metric):
    result = []
    for q, query in queries:
        scored = []
        for i, v in vectors:
            if v is None or len(v) != len(query) or not np.isfinite(np.array(v, dtype=float)).all():
                continue
            a, b = np.array(v, dtype=np.float32).astype(float), np.array(query, dtype=np.float32).astype(float)
            if metric == "l2":
                d = np.sqrt(((a - b) ** 2).sum())
            else:
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                d = 1 - (a @ b / norm if norm > 0 else 0.0)
            scored.append((round(float(d), 10), i))
        result += [(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(result)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-9, 9, 8)]) for i in range(300)]
    copies = [(300 + i, [1.0] * 8) for i in range(150)]
    odd = [(900, [1.0] * 7), (901, [float("nan")] + [1.0] * 7), (902, [0.0] * 8), (903, None)]
    return vectors + copies + odd, [(q, vectors[q * 5][1]) for q in range(20)] + [(20, [1.0] * 8)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("entries", [N.QUERY_ENTRIES, 40])
@pytest.mark.parametrize("k", [7, 100, 1100])
def test_nearest_is_exact(spark, data, metric, entries, k, monkeypatch):
    """One block of queries and many, fewer and more neighbours than pivots, window and range ranking."""
    if entries == 40:
        monkeypatch.setattr(N, "WINDOW_CUT", 50)
    vectors, queries = data
    got = N.nearest(spark.createDataFrame(vectors, SCHEMA).repartition(5),
                    spark.createDataFrame(queries, "query_id int, embedding array<float>"), k, metric, query_entries=entries)
    assert sorted(rows(got, "query_id", "id", "relevance_rank")) == brute(vectors, queries, k, metric)


def test_cells_are_left_out_without_loss():
    """Clustered rows in many batches: few pairs are measured, none is missed."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 50
    vectors = (centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 16))).astype(np.float64)
    for metric in N.METRICS:
        leaders = V.Leaders(vectors[:300], 5, metric, vectors[::97][:64])
        for start in range(0, 6000, 500):
            leaders.add(np.arange(start, start + 500), vectors[start:start + 500])
        query, ids, _ = leaders.rows()
        own = V.unit(vectors) if metric == "cosine" else vectors
        for q in range(300):
            distance = V.distances_to(own, np.broadcast_to(own[q], own.shape), metric)
            assert ids[query == q].tolist() == np.lexsort((np.arange(6000), distance))[:5].tolist()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_pairs_out_of_reach_cost_one_product(metric, monkeypatch):
    """No distance is made for a pair of row and query that its product rules out, and no neighbour is lost."""
    rng = np.random.default_rng(31)
    rows = np.concatenate([rng.normal(size=(3000, 16)), np.zeros((1, 16)), np.full((2, 16), 1e-9)])
    made, reach = [], V.Leaders._reach
    monkeypatch.setattr(V.Leaders, "_reach", staticmethod(lambda a, b: made.append(len(a) * len(b)) or reach(a, b)))
    leaders = V.Leaders(rows, 5, metric, rows[:20])
    leaders.add(np.arange(len(rows)), rows)
    query, ids, distance = leaders.rows()
    assert sum(made) <= 2 * 20 * len(rows)
    plain = V.unit(rows) if metric == "cosine" else rows
    for q in [*range(0, 3000, 150), 3000, 3001]:
        exact = V.distances_to(plain, np.broadcast_to(plain[q], plain.shape), metric)
        assert ids[query == q].tolist() == sorted(range(len(rows)), key=lambda i: (exact[i], i))[:5]


def test_tiny_and_huge_distances_decide(spark):
    """Differences far below the sixth digit, and vectors whose squares leave the range of doubles."""
    near = [(i, [1.0, (9 - i) * 1e-5]) for i in range(9)]
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    got = N.nearest(spark.createDataFrame(near, "id bigint, embedding array<double>"), ask, 9)
    assert rows(got.orderBy("relevance_rank"), "id") == [(i,) for i in reversed(range(9))]
    for size in (1e-39, 1e200):
        scaled = [(i, [size, size * i]) for i in range(1, 9)]
        ask = spark.createDataFrame([(0, [size, 0.0])], "query_id int, embedding array<double>")
        got = N.nearest(spark.createDataFrame(scaled, "id bigint, embedding array<double>"), ask, 8)
        assert rows(got.orderBy("relevance_rank"), "id") == [(i,) for i in range(1, 9)]


def test_vectors_are_not_shuffled(spark, data, capsys):
    ask = spark.createDataFrame(data[1], "query_id int, embedding array<float>")
    N.nearest(spark.createDataFrame(data[0], SCHEMA), ask, 3).explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and not any("vector" in line for line in plan.splitlines() if "Exchange" in line)


def test_nearest_without_queries(spark, data):
    none = spark.createDataFrame([], "query_id int, embedding array<float>")
    assert rows(N.nearest(spark.createDataFrame(data[0], SCHEMA), none, 3)) == []


def test_string_ids_and_small_k(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])],
                               "id string, embedding array<float>")
    ask = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert rows(N.nearest(df, ask, 1), "id") == [("a",)]


@pytest.fixture
def index(spark):
    return spark.createDataFrame([
        (1, [1.0, 0.0], "Ann", "first", 1, "2026-02-01T00:00:00Z"),
        (2, [0.9, 0.1], None, "second", 4, "2026-02-03T00:00:00Z"),
        (3, [0.0, 1.0], "Cy", "third", 5, "2026-02-02T00:00:00Z"),
        (4, [0.8, 0.2], "Di", "", None, None),
    ], "id bigint, embedding array<float>, author string, content string, score int, date string").withColumns(
        {"title": F.lit("Review"), "url": F.lit("link")})


def test_search(index):
    got = rows(S.search(index, [1.0, 0.0], S.SearchOptions(limit=3)), "id", "relevance_rank", "author", "content")
    assert got == [(1, 0, "Ann", "first"), (2, 1, "Review", "second"), (4, 2, "Di", "link")]


def test_search_filters_first(index):
    got = S.search(index, [1.0, 0.0], S.SearchOptions(limit=1, min_score=4))
    assert rows(got, "id", "relevance_rank") == [(2, 0)]
    bounded = S.search(index, [1.0, 0.0], S.SearchOptions(limit=1, min_score=4), candidate_limit=1)
    assert rows(bounded, "id") == [(2,)]
    by_date = S.search(index, [1.0, 0.0], S.SearchOptions(start_date="2026-02-02", sort_by="date"), candidate_limit=3)
    assert {r[0] for r in rows(by_date, "id")} >= {2, 3}
    dated = S.search(index, [1.0, 0.0], S.SearchOptions(start_date="2026-02-02", end_date="2026-02-02T12:00:00Z"))
    assert rows(dated, "id") == [(3,)]


def test_search_by_date(index):
    newest = S.search(index, [1.0, 0.0], S.SearchOptions(sort_by="date"))
    assert rows(newest, "id") == [(2,), (3,), (1,), (4,)]
    oldest = S.search(index, [1.0, 0.0], S.SearchOptions(sort_by="date", sort_direction="asc"), candidate_limit=2)
    assert rows(oldest, "id", "relevance_rank") == [(1, 0), (2, 1)]


def test_search_by_date_orders_all_matches(spark):
    """The newest of many more matches than any bound, each ranked among all of them."""
    n = 6000
    index = spark.range(n, numPartitions=7).select(
        "id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.lit(1).alias("score"),
        F.date_format(F.timestamp_seconds(F.col("id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    got = S.search(index, [1.0, 0.0], S.SearchOptions(sort_by="date", limit=100))
    assert rows(got, "id", "relevance_rank") == [(i, i) for i in reversed(range(n - 100, n))]
    kept = S.search(index, [1.0, 0.0], S.SearchOptions(sort_by="date", limit=3, start_date="1970-02-01", min_score=1))
    assert rows(kept, "id", "relevance_rank") == [(i, i - 31 * 24) for i in (n - 1, n - 2, n - 3)]
    none = S.search(index, [1.0, 0.0], S.SearchOptions(sort_by="date", min_score=2))
    assert rows(none) == [] and none.columns == got.columns


def test_stored_index_pushes_dates_to_the_scan(spark, index, tmp_path, capsys):
    path = str(tmp_path / "index")
    S.write_index(index, path, files=2)
    stored = spark.read.parquet(path)
    options = S.SearchOptions(start_date="2026-02-02", end_date="2026-02-02T12:00:00Z", sort_by="date")
    assert rows(S.search(stored, [1.0, 0.0], options)) == rows(S.search(index, [1.0, 0.0], options)) != []
    S.search_metadata(stored, options).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(date_ts," in plan and "LessThanOrEqual(date_ts," in plan


def test_metadata_only(index):
    got = rows(S.search_metadata(index, S.SearchOptions(sort_by="date", limit=2)), "id", "relevance_rank")
    assert got == [(2, 0), (3, 0)]


def test_index_status(index):
    got = S.index_status(index).first()
    assert (got["total_indexed"], got["score_count"], got["has_date"], got["is_ready"]) == (4, 3, 0.75, True)
    empty = S.index_status(index.limit(0)).first()
    assert (empty["has_score"], empty["is_ready"]) == (0.0, False)


@pytest.mark.parametrize("options", [
    dict(limit=0), dict(limit=101), dict(min_score=4, max_score=2), dict(start_date="soon"), dict(sort_by="size"),
    dict(start_date="2026-02-02", end_date="2026-02-01")])
def test_bad_options(options):
    with pytest.raises(ValueError):
        S.SearchOptions(**options)


def test_metadata_join_falls_back_to_title_and_url(spark):
    hits = spark.createDataFrame([(1, 0, "T", "U"), (2, 1, "T", "U")],
                                 "id int, relevance_rank int, title string, url string")
    meta = spark.createDataFrame(
        [(1, "Ann", "", 3, "", "2026-02-01")],
        "id int, author string, content string, score int, date string, review_created_at string")
    got = sorted(rows(S.attach_metadata(hits, meta)))
    assert got == [(1, 0, "Ann", "U", 3, "2026-02-01"), (2, 1, "T", "U", None, None)]


def test_workers_do_not_need_the_package(tmp_path):
    """The kernel travels by value: it loads where the package is not on the path."""
    import subprocess
    import sys
    from pyspark import cloudpickle
    from revlumen.functions import vectors
    blob = tmp_path / "kernel.pkl"
    blob.write_bytes(cloudpickle.dumps((vectors.Leaders, vectors.matrix_of)))
    code = f"import pickle, sys; pickle.load(open({str(blob)!r}, 'rb')); assert 'revlumen' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=60)


def test_query_vectors_of_different_lengths(spark, data):
    ask = spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 7)], "query_id int, embedding array<float>")
    with pytest.raises(ValueError):
        N.nearest(spark.createDataFrame(data[0], SCHEMA), ask, 3)
