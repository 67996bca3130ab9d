"""URL filter: rules first, then a log-likelihood ratio of two character models.

The models are smoothed variable-order Markov models of accepted and of rejected URLs. The rules name both sets:
what they allow or block is the training data, all of it, except a held-out fifth that sets the threshold.

* A character is predicted from the longest context of up to ``ORDER`` characters that training holds at least
  ``LEAST_SEEN`` times; along the way every order is smoothed with the next shorter one by the number of distinct
  characters that followed it (Witten-Bell), down to equal chances for all known characters and one unknown.
* The score of a URL is the difference of its log-likelihoods per character, the end mark included. The
  threshold is the score that separates the held-out accepted and rejected URLs best (mean of both accuracies).

All of it is joins and sums over distinct character runs. Counts are gathered over every URL, so the models grow
with the input and never pass through the driver. A run of characters that makes up more than 2^-16 of all places
is joined by broadcast (there are fewer than 2^16 of those, whatever the input); the others meet by a shuffle in
which no key is hot. Scores are sums of whole millionths, so reruns agree to the bit.

A null URL, or one without ``://``, has an empty host and path, so no rule fits; without ``://`` all of it is
scored. What is null or empty shows no evidence and scores 0. Without accepted or without rejected examples all
scores are 0, and without both among the held-out ones the threshold is 0; a score at the threshold or above is
allowed. Very long URLs are read whole. Repeated rows get equal results, ties between rules go to the longer path,
then to block. An empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import ascii_lower, staged

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 5
LEAST_SEEN = 2
FREQUENT = 1 << 16
# Of ten equal parts of all URLs, so many are held out for the threshold.
HELD_OUT_TENTHS = 2
UNIT = 1_000_000
# Scores are binned this finely per character to find the threshold.
BINS_PER_NAT = 100
_START, _END = "\x02", "\x03"
_HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST_PATH, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _HOST_PATH, 2)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict), both null where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[2]), r[0] != "block"))
    found = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    fits = [(F.col("host") == host) | F.col("host").endswith(f".{host}") for _, host, _ in ranked]
    fits = [f & F.col("path").startswith(path) for f, (_, _, path) in zip(fits, ranked)]

    def first(value) -> Column:
        return F.coalesce(*[F.when(f, F.lit(value(r))) for f, r in zip(fits, ranked)], F.lit(None).cast("string"))

    return found.withColumn("rule", first(lambda r: r[1] + r[2])).withColumn("ruled", first(lambda r: r[0]))


def _scored_text(url: Column) -> Column:
    """What the models read: the lower-cased host and everything after it."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(text)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest)))


def character_runs(text: Column, order: int = ORDER) -> Column:
    """For every character and the end mark: the ``order`` characters before it and itself, as one string."""
    marked = F.concat(F.lit(_START * order), text, F.lit(_END))
    characters = F.regexp_extract_all(marked, F.lit("(?s)."), F.lit(0))

    def runs(c: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(c) - order)
        return F.transform(places, lambda i: F.concat(*[F.get(c, i + (k - 1)) for k in range(order + 1)]))

    # A list of one makes the characters computed once.
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.array(characters), runs)))


def run_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``run, allow, block, places`` over ``text, trained`` (allow, block or null): occurrences by class and in all."""
    runs = texts.select("trained", F.explode(character_runs(F.col("text"), order)).alias("run"))
    return runs.groupBy("run").agg(
        F.count(F.when(F.col("trained") == "allow", 1)).alias("allow"),
        F.count(F.when(F.col("trained") == "block", 1)).alias("block"), F.count("*").alias("places"))


def _smoothed(counts: DataFrame, k: int, order: int, shorter: DataFrame | None, characters: Column | None) -> DataFrame:
    """``run, allow, block``: chances of the last of ``k + 1`` characters after the others, per class.

    A context has at most as many rows as there are characters, so none of the groups here can be large.
    """
    run = F.expr(f"substring(run, {order - k + 1}, {k + 1})")
    own = counts.groupBy(run.alias("run")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    context = W.partitionBy(F.expr(f"substring(run, 1, {k})"))
    known = own.select(
        "run", *[F.col(c).alias(f"n_{c}") for c in ("allow", "block")],
        *[F.sum(c).over(context).alias(f"all_{c}") for c in ("allow", "block")],
        *[F.count(F.when(F.col(c) > 0, 1)).over(context).alias(f"kinds_{c}") for c in ("allow", "block")])
    if shorter is None:
        based = known.withColumn("below_allow", 1.0 / characters).withColumn("below_block", 1.0 / characters)
    else:
        below = shorter.select(F.col("run").alias("_rest"), F.col("allow").alias("below_allow"), F.col("block").alias("below_block"))
        based = known.join(below, F.expr("substring(run, 2)") == F.col("_rest")).drop("_rest")

    def chance(c: str) -> Column:
        n, total, kinds, under = F.col(f"n_{c}"), F.col(f"all_{c}"), F.col(f"kinds_{c}"), F.col(f"below_{c}")
        mixed = (n + kinds * under) / (total + kinds)
        return F.when(total >= (LEAST_SEEN if k else 1), mixed).otherwise(under)

    return based.select("run", chance("allow").alias("allow"), chance("block").alias("block"))


def run_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``run, places, ratio``: log of the accepted over the rejected chance of a run's last character, in millionths."""
    known = counts.select(F.expr("substring(run, -1)").alias("c")).distinct().count() + 1
    chances = None
    for k in range(order + 1):
        chances = _smoothed(counts, k, order, chances, F.lit(known))
    ratio = F.round(F.log(F.col("allow") / F.col("block")) * UNIT).cast("bigint")
    return counts.select("run", "places").join(chances.select("run", ratio.alias("ratio")), "run")


def _score_sums(texts: DataFrame, ratios: DataFrame, key: list[str], order: int) -> DataFrame:
    """``key, total, n``: the summed ratios and the number of places of the rows of one key."""
    places = ratios.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    often = ratios.where(F.col("places") * FREQUENT > places).select("run", "ratio")
    seldom = ratios.where(F.col("places") * FREQUENT <= places).select("run", F.col("ratio").alias("_late"))
    runs = texts.select(*key, F.explode(character_runs(F.col("text"), order)).alias("run"))
    # Fewer than FREQUENT rows of a few characters each.
    met = runs.join(F.broadcast(often), "run", "left")
    at_once = met.where(F.col("ratio").isNotNull()).select(*key, "ratio")
    later = met.where(F.col("ratio").isNull()).select(*key, "run").join(seldom, "run").select(*key, F.col("_late").alias("ratio"))
    return at_once.union(later).groupBy(*key).agg(F.sum("ratio").alias("total"), F.count("*").alias("n"))


def threshold(scored: DataFrame) -> float:
    """The score that separates held-out rows best; ``scored`` holds ``ruled, score``.

    Scores are counted in bins, so what comes to the driver depends on the spread of scores, which smoothing
    bounds, and not on the number of rows. Of equally good cuts the one nearest 0 is taken, then the smaller one.
    """
    binned = scored.groupBy(F.floor(F.col("score") * BINS_PER_NAT).alias("bin")).agg(
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"), F.count(F.when(F.col("ruled") == "block", 1)).alias("block"))
    rows = sorted(tuple(r) for r in binned.collect())
    allow, block = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allow or not block:
        return 0.0
    cuts, passed, stopped, low = [], allow, 0, None
    for at, here_allow, here_block in [*rows, (None, 0, 0)]:
        # Any cut above the bins before and not above this one parts the rows alike.
        cut = max(low, 0) if at is None else min(at, 0 if low is None else max(low, 0))
        cuts.append((passed * block + stopped * allow, -abs(cut), -cut))
        passed, stopped, low = passed - here_allow, stopped + here_block, at + 1 if at is not None else low
    return -max(cuts)[2] / BINS_PER_NAT


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``page_id, url``."""
    rows = with_rule(pages.select("page_id", "url"), rules).withColumn("text", _scored_text(F.col("url")))
    held = F.crc32(F.col("text").cast("binary")) % 10 < HELD_OUT_TENTHS
    rows = staged(rows.withColumn("held", held & F.col("ruled").isNotNull()), "urls")
    trained = rows.select("text", F.when(~F.col("held"), F.col("ruled")).alias("trained"))
    counts = staged(run_counts(trained, order), "runs")
    seen = counts.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    ratios = run_ratios(counts, order)
    ratios = staged(ratios if seen[0] and seen[1] else ratios.withColumn("ratio", F.lit(0).cast("bigint")), "ratios")
    # Rows that repeat a page and URL are counted, summed together and told apart again.
    key = ["page_id", "url_hash"]
    keyed = rows.withColumn("url_hash", F.xxhash64(F.col("url").isNull(), "url"))
    sums = _score_sums(keyed, ratios, key, order).select(
        *key, "total", "n", *[F.lit(None).cast("string").alias(c) for c in ("host", "path", "rule", "ruled")],
        F.lit(False).alias("held"), F.lit(0).cast("bigint").alias("copies"))
    zero = F.lit(0).cast("bigint")
    whole = keyed.groupBy(*key).agg(
        zero.alias("total"), zero.alias("n"), *[F.first(c).alias(c) for c in ("host", "path", "rule", "ruled", "held")],
        F.count("*").alias("copies"))
    merged = whole.union(sums).groupBy(*key).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("host", "path", "rule", "ruled", "held")],
        F.sum("copies").alias("copies"))
    score = F.when(F.col("n") > 0, F.col("total") / F.col("n") / UNIT).otherwise(F.lit(0.0))
    scored = staged(merged.withColumn("score", score), "scored-urls")
    cut = threshold(scored.where("held").select("ruled", "score"))
    by_score = F.when((F.col("score") >= cut) | (F.col("n") == 0), "allow").otherwise("block")
    each = scored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return each.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")


def pages_query(pages: DataFrame) -> DataFrame:
    return judged(pages)
