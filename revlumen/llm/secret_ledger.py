"""Secret scan over an incremental ledger of text blobs.

Every version of every file is named by the SHA-256 of its text. The ledger holds one row per (blob, rule
version) that was scanned, with its findings; a run scans only pairs that the ledger lacks, appends them, and
joins the findings back to every path that holds the blob. DataFrame functions only.

Nulls: a null text counts as empty. Repeated rows give repeated results. Empty tables give empty results.
A version with extra columns keeps them, unless they clash with the columns added here, which replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import staged


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax) and the least length of what group ``group`` matched."""

    kind: str
    pattern: str
    group: int
    least: int
    # Whether runs shorter than ``least`` may be skipped by the pattern itself: only if no match can start in one.
    hint: str | None = None


# The kinds in the order that breaks ties, with their patterns.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
RULES_VERSION = 1

LEDGER_SCHEMA = "blob string, rules int, spans array<struct<start:bigint,kind:int,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, ok>>: per match the code points since the last one, its own and whether it counts.

    ``hint`` scans for long runs only; a run that is too short can hold no start of another match of that kind.
    """
    pattern = F.lit(rule.hint or rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.hint or rule.pattern, -1), lambda p: F.length(p).cast("bigint"))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    held = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
    return F.when(text.rlike(rule.hint or rule.pattern), F.transform(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        lambda p: F.struct(p["gap"].alias("gap"), F.length(p["hit"]).cast("bigint").alias("size"),
                           (held(p["hit"]) >= rule.least).alias("ok"))))


def _numbered(matches: Column, kind: int) -> Column:
    rows = F.transform(matches, lambda m, at: F.struct(
        F.lit(kind).alias("kind"), at.alias("at"), m["gap"].alias("gap"), m["size"].alias("size"), m["ok"].alias("ok")))
    return F.coalesce(rows, F.array().cast("array<struct<kind:int,at:int,gap:bigint,size:bigint,ok:boolean>>"))


def _count_of(spans: Column, kind: int) -> Column:
    return F.coalesce(F.size(F.filter(spans, lambda s: s["kind"] == kind)), F.lit(0)).cast("bigint")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` for blobs (blob, text) that hold findings; spans sort by start, then rule."""
    found = blobs.select("blob", *[_matches(F.col("text"), r).alias(f"_m{i}") for i, r in enumerate(rules)])
    found = found.where(F.coalesce(*[F.col(f"_m{i}") for i in range(len(rules))]).isNotNull())
    tagged = [_numbered(F.col(f"_m{i}"), i) for i in range(len(rules))]
    # Matches are few and narrow; laid out by blob once, for the sums and for the lists. A blob may come twice.
    rows = found.dropDuplicates(["blob"]).select("blob", F.inline(F.concat(*tagged)))
    run = W.partitionBy("blob", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).where("ok")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end")
    return ended.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger so far; none yet is an empty one."""
    if path is not None:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_unseen(versions: DataFrame, ledger: DataFrame, key: list[str], rules: tuple[Rule, ...] = RULES,
                rules_version: int = RULES_VERSION) -> DataFrame:
    """Ledger rows for the blobs of ``versions`` (``key``, text) that ``ledger`` lacks under these rules.

    One holder per blob is chosen on narrow rows, so that a text with many copies is scanned once; only the
    chosen texts then meet their ids. Blobs without findings get a row too, with an empty list.
    """
    known = ledger.where(F.col("rules") == rules_version).select("blob").distinct()
    holders = versions.select(*key, blob_id(F.col("text")).alias("blob")).groupBy("blob").agg(
        F.min(F.struct(*key)).alias("_holder")).join(known, "blob", "left_anti")
    holder = holders.select("blob", *[F.col(f"_holder.{k}").alias(f"_h{i}") for i, k in enumerate(key)])
    texts = versions.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.coalesce("text", F.lit("")).alias("text"),
                            blob_id(F.col("text")).alias("_blob"))
    same = F.col("blob") == F.col("_blob")
    for i in range(len(key)):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_h{i}"))
    chosen = texts.join(holder, same, "left_semi").select(F.col("_blob").alias("blob"), "text")
    return holder.select("blob").join(scan_blobs(chosen, rules), "blob", "left").select(
        "blob", F.lit(rules_version).cast("int").alias("rules"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def scan_versions(versions: DataFrame, key: list[str], ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES,
                  rules_version: int = RULES_VERSION) -> DataFrame:
    """Findings of every version: the columns of ``versions`` and ``blob, spans``.

    ``versions`` holds ``key`` (path and revision, or a document id) and ``text``. With ``ledger_path`` the new
    rows are appended there and later runs skip them; without, they are staged for this run only. Raise
    ``rules_version`` whenever ``rules`` change.
    """
    spark = versions.sparkSession
    versions = versions.drop("blob", "spans")
    before = read_ledger(spark, ledger_path)
    fresh = scan_unseen(versions, before, key, rules, rules_version)
    if ledger_path is None:
        ledger = staged(fresh, "secret-ledger")
    else:
        # Staged first: the append must not read the folder that it extends.
        staged(fresh, "secret-ledger").write.mode("append").parquet(ledger_path)
        ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    hits = ledger.where((F.col("rules") == rules_version) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    return versions.withColumn("blob", blob_id(F.col("text"))).join(hits.select("blob", "spans"), "blob", "left")


def span_columns(spans: Column, rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Counts per kind, the spans as text, and the digest of that text."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    joined = F.coalesce(F.array_join(texts, ","), F.lit(""))
    counts = {f"n_{r.kind}": _count_of(spans, i) for i, r in enumerate(rules)}
    return counts | {"base_sha256": F.sha2(joined, 256), "spans": joined}


def documents_query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    found = scan_versions(documents.select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", *[c.alias(n) for n, c in span_columns(F.col("spans")).items()])
