"""Ticket and Markdown exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlumen.schema import SENTIMENTS, SEVERITIES, or_default, require, with_seq

# Wording of the exports.
TICKET_PROJECT = "APP"
REPORT_TITLE = "*App Reviews Report*"
EMPTY_REPORT = "*No reviews to report.*"
SECTION_TITLES = {1: "P0 Critical Issues", 2: "P1 High Priority", 3: "Other Reports"}
MAX_LABEL_LENGTH = 100
MAX_SIGNAL_LENGTHS = {"summary": 5000, "device": 200, "os_version": 200, "app_version": 200}
LABELS = ("review_id", "issue_type", "feature_area", "severity", "sentiment")
TITLE_PART, BLANK_PART, HEADER_PART, ROW_PART = range(4)


def is_exportable(df: DataFrame) -> Column:
    """Whether a row may be exported: labels given and inside the vocabulary, signals of bounded length."""
    ok = F.coalesce(F.length("review_id") > 0, F.lit(False))
    for name in ("issue_type", "feature_area"):
        ok = ok & F.coalesce(F.length(name).between(1, MAX_LABEL_LENGTH), F.lit(False))
    known = df.schema["signals"].dataType.names if "signals" in df.columns else []
    for name, most in MAX_SIGNAL_LENGTHS.items():
        if name in known:
            ok = ok & F.coalesce(F.length(F.col("signals")[name]) <= most, F.lit(True))
    return (ok & F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
            & F.coalesce(F.col("sentiment").isin(*SENTIMENTS), F.lit(False)))


def require_exportable(df: DataFrame) -> DataFrame:
    count = df.agg(F.count_if(~is_exportable(df)).alias("n")).first()["n"]
    require(count == 0, f"{count} rows cannot be exported")
    return df


def tickets(df: DataFrame) -> DataFrame:
    """One ticket per row as a nested ``fields`` struct. No shuffle.

    A label that is missing reads ``Unknown``; ``write_tickets`` lets no such
    row through.
    """
    df = df.withColumns({c: or_default(F.col(c), "Unknown") for c in LABELS})
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value, F.lit("\n"))).otherwise("")

    description = F.concat(
        F.lit("*Automated Review Ticket*\n"),
        F.concat(F.lit("Review ID: "), "review_id", F.lit("\n")),
        F.concat(F.lit("Severity: "), "severity", F.lit("\n")),
        F.concat(F.lit("Feature Area: "), "feature_area", F.lit("\n")),
        F.concat(F.lit("Sentiment: "), "sentiment", F.lit("\n")),
        line("Device: ", F.col("signals.device")), line("OS: ", F.col("signals.os_version")),
        line("App Version: ", F.col("signals.app_version")),
    )
    summary = F.concat(F.lit("["), "severity", F.lit("] "), "feature_area", F.lit(": "), "issue_type",
                       F.lit(" Report"))
    return df.select("review_id", F.struct(
        F.struct(F.lit(TICKET_PROJECT).alias("key")).alias("project"),
        summary.alias("summary"), description.alias("description"),
        F.struct(F.when(F.col("issue_type") == "Bug", "Bug").otherwise("Task").alias("name")).alias("issuetype"),
        F.col("severity").alias("customfield_severity"),
    ).alias("fields"))


def write_tickets(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per ticket and line; fails before it writes if a row breaks the contract."""
    tickets(require_exportable(df)).select("fields").write.mode(mode).json(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """Lines of the report as (section, part, seq, line).

    Rows keep their input order inside a section through ``seq``, of whatever
    type it is; nothing is numbered or gathered globally. Sort by the first
    three columns to read it.
    """
    df = with_seq(df).withColumns({c: or_default(F.col(c), "Unknown") for c in LABELS})
    section = F.when(F.col("severity") == "P0", 1).when(F.col("severity") == "P1", 2).otherwise(3)
    urgent = F.concat(F.lit("- *["), "feature_area", F.lit("]* "), "issue_type", F.lit(" (ID: "),
                      "review_id", F.lit(")"))
    plain = F.concat(F.lit("- ["), "severity", F.lit("] "), "feature_area", F.lit(" - "), "issue_type")
    body = df.select(section.alias("section"), F.lit(ROW_PART).alias("part"), "seq",
                     F.when(section < 3, urgent).otherwise(plain).alias("line"))
    counts = body.agg(*[F.count_if(F.col("section") == n).alias(f"n{n}") for n in SECTION_TITLES],
                      F.count("*").alias("n"))
    no_place = F.lit(None).cast(df.schema["seq"].dataType)

    def head(number: int, part: int, line: Column, shown: Column) -> Column:
        return F.when(shown, F.struct(F.lit(number).alias("section"), F.lit(part).alias("part"),
                                      no_place.alias("seq"), line.alias("line")))

    lines = [head(0, TITLE_PART, F.when(F.col("n") > 0, REPORT_TITLE).otherwise(EMPTY_REPORT), F.lit(True))]
    for number, title in SECTION_TITLES.items():
        shown, size = F.col(f"n{number}") > 0, F.col(f"n{number}").cast("string")
        lines.append(head(number, BLANK_PART, F.lit(""), shown))
        lines.append(head(number, HEADER_PART, F.concat(F.lit(f"*{title} ("), size, F.lit(")*")), shown))
    return counts.select(F.inline(F.array_compact(F.array(*lines)))).unionByName(body)


def write_markdown(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The report as text part files in reading order; fails before it writes if a row breaks the contract."""
    lines = markdown_lines(require_exportable(df))
    lines.orderBy("section", "part", "seq").select("line").write.mode(mode).text(path)


def markdown_text(df: DataFrame, max_rows: int | None = None) -> str:
    """The report as one string, for a frame that fits the driver.

    Lines arrive part by part in reading order. ``max_rows`` makes a larger
    frame an error.
    """
    if max_rows is not None:
        require(df.limit(max_rows + 1).count() <= max_rows, f"more than {max_rows} rows; use write_markdown")
    return "\n".join(row["line"] for row in markdown_lines(df).orderBy("section", "part", "seq").toLocalIterator())
