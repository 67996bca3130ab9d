import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from revlumen.session import prepare

    session = (
        SparkSession.builder.master("local[8]").appName("revlumen-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def rows(df, *columns):
    """Rows of the given columns as plain tuples, in result order."""
    chosen = df.select(*columns) if columns else df
    return [tuple(r) for r in chosen.collect()]


def analytics_frame(spark, data):
    """Classified rows from (id, type, area, severity, sentiment, score, version, created)."""
    names = ("review_id", "issue_type", "feature_area", "severity", "sentiment", "score", "app_version",
             "review_created_at")
    schema = ", ".join(f"{n} {'int' if n == 'score' else 'string'}" for n in names) + ", seq bigint"
    return spark.createDataFrame([(*row, i) for i, row in enumerate(data)], schema)


SIX = (
    ("r1", "Bug", "Login/OTP", "P1", "Negative", 1, "1.0.0", "2026-02-01T10:00:00Z"),
    ("r2", "Bug", "Login/OTP", "P0", "Negative", 1, "1.0.0", "2026-02-02T10:00:00Z"),
    ("r3", "Performance", "Notifications", "P2", "Mixed", 3, "1.0.1", "2026-02-08T10:00:00Z"),
    ("r4", "Feature Request", "Onboarding", "FYI", "Neutral", 4, "1.0.1", "2026-02-09T10:00:00Z"),
    ("r5", "Bug", "Login/OTP", "P1", "Negative", 2, "1.0.2", "2026-02-10T10:00:00Z"),
    ("r6", "Praise", "Card Controls", "FYI", "Positive", 5, "1.0.2", "2026-02-11T10:00:00Z"),
)


@pytest.fixture
def six(spark):
    return analytics_frame(spark, SIX)
