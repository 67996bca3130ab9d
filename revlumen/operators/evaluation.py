"""Comparison of predicted labels with golden labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlumen.functions.numbers import ratio, round_to

# Accuracy and recall gates and the tolerated drop.
ACCURACY_GATE = 0.90
SAFETY_RECALL_GATE = 1.0
MAX_REGRESSION = 0.02


def golden_evaluation(predicted: DataFrame, golden: DataFrame, key: str = "review_id") -> DataFrame:
    """Accuracy per label dimension and recall of critical safety rows.

    ``golden`` carries ``expected_issue_type``, ``expected_severity`` and
    ``is_safety``. A golden row without a prediction counts as a miss.
    """
    joined = golden.join(predicted.select(key, "issue_type", "severity"), key, "left")
    found = (F.col("issue_type") == "Safety Concern") & (F.col("severity") == "P0")
    sums = joined.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("issue_type") == F.col("expected_issue_type")).alias("t"),
        F.count_if(F.col("severity") == F.col("expected_severity")).alias("s"),
        F.count_if("is_safety").alias("safe"), F.count_if(F.col("is_safety") & found).alias("hit"),
    )

    def line(name, part, whole, gate):
        value = round_to(ratio(part, whole), 4)
        return F.struct(F.lit(name).alias("metric"), part.alias("matches"), whole.alias("total"),
                        value.alias("value"), (value >= gate).alias("passes"))

    return sums.select(F.inline(F.array(
        line("issue_type_accuracy", F.col("t"), F.col("n"), ACCURACY_GATE),
        line("severity_accuracy", F.col("s"), F.col("n"), ACCURACY_GATE),
        line("p0_safety_recall", F.col("hit"), F.col("safe"), SAFETY_RECALL_GATE),
    )))


def regression(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Drop per metric against an earlier evaluation."""
    before = previous.select("metric", F.col("value").alias("previous_value"))
    drop = F.col("previous_value") - F.col("value")
    return current.join(before, "metric").select(
        "metric", "previous_value", "value", round_to(drop, 4).alias("drop"),
        (drop > MAX_REGRESSION).alias("is_regression"))


def binary_agreement(predicted: DataFrame, labels: DataFrame, key: str, prediction: str, label: str) -> DataFrame:
    """Agreement of a 0/1 prediction with a 0/1 label over the labelled rows."""
    joined = labels.select(key, label).join(predicted.select(key, prediction), key)
    yes, true = F.col(prediction) == 1, F.col(label) == 1
    return joined.agg(
        F.count("*").alias("labelled"),
        F.count_if(F.col(prediction) == F.col(label)).alias("agreeing"),
        F.count_if(~yes & ~true).alias("true_negatives"),
        F.count_if(~true).alias("negatives"),
    ).select(
        "labelled", "agreeing", round_to(ratio(F.col("agreeing"), F.col("labelled")), 4).alias("accuracy"),
        round_to(ratio(F.col("true_negatives"), F.col("negatives")), 4).alias("negative_recall"),
        (ratio(F.col("agreeing"), F.col("labelled")) >= ACCURACY_GATE).alias("passes"),
    )
