"""URL models, filter audit and ranked search against plain Python: nulls, empties, long texts, ties, repeats."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from revlumen.llm import filter_audit, ranked_search, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- URL models ---------------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, host string, text string, run string, ruled string"


def pages_of(spark, urls):
    """Pages whose extra columns clash with the operator's own names."""
    return spark.createDataFrame([(i, u, "x", "x", "x", "allow") for i, u in urls], PAGES)


def host_and_path(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")


def fitting_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_verdicts(urls, order=url_filter.ORDER):
    """Verdicts and scores by dictionaries of contexts."""
    read = []
    for url in urls:
        text = (url or "").split("://", 1)[1] if "://" in (url or "") else url or ""
        host = re.match(r"[^/?#]*", text)[0]
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in host) + text[len(host):]
        ruled = fitting_rule(*host_and_path(url))[0]
        held = ruled is not None and zlib.crc32(text.encode()) % 10 < url_filter.HELD_OUT_TENTHS
        read.append((text, ruled, held))
    counts = {c: [defaultdict(Counter) for _ in range(order + 1)] for c in ("allow", "block")}
    characters = set()
    for text, ruled, held in read:
        marked = "\x02" * order + text + "\x03"
        for at in range(order, len(marked) if text else 0):
            characters.add(marked[at])
            if ruled and not held:
                for k in range(order + 1):
                    counts[ruled][k][marked[at - k:at]][marked[at]] += 1

    def chance(c, context, x):
        p = 1 / (len(characters) + 1)
        for k in range(order + 1):
            seen = counts[c][k].get(context[order - k:], Counter())
            if seen.total() >= (url_filter.LEAST_SEEN if k else 1):
                p = (seen[x] + len(seen) * p) / (seen.total() + len(seen))
        return p

    trained = all(counts[c][0].get("") for c in counts)
    scores = []
    for text, _, _ in read:
        marked = "\x02" * order + text + "\x03"
        parts = [round(1e6 * math.log(chance("allow", marked[i - order:i], marked[i]) / chance("block", marked[i - order:i], marked[i])))
                 for i in range(order, len(marked))] if text and trained else []
        scores.append(sum(parts) / len(parts) / 1e6 if parts else 0.0)
    held = [(s, r) for s, (_, r, h) in zip(scores, read) if h]
    bins = sorted({math.floor(s * 100) for s, _ in held})
    good, bad = sum(r == "allow" for _, r in held), sum(r == "block" for _, r in held)
    cut = 0.0
    if good and bad:
        cut = -max((sum(r == "allow" and math.floor(s * 100) >= e for s, r in held) * bad
                    + sum(r == "block" and math.floor(s * 100) < e for s, r in held) * good, -abs(e), -e)
                   for e in range(min(bins[0], 0), max(bins[-1] + 1, 0) + 1))[2] / 100
    return [(r or ("allow" if s >= cut or not t else "block"), s) for s, (t, r, _) in zip(scores, read)]


def random_urls(n, seed=1):
    rng = random.Random(seed)
    names = ["news", "shop", "spam", "casino", "blog"]
    return [f"http{rng.choice(['', 's'])}://{rng.choice(names)}{rng.randrange(4)}.Example.{rng.choice(['org', 'com', 'net'])}"
            f"/{rng.choice(['en', 'es', 'de', 'fr'])}/{rng.randrange(300)}{rng.choice(['', '?a=b', '#x', '.html'])}" for _ in range(n)]


ODD_URLS = [None, "", "no scheme/at all", "://", "://org", "http://org", "http://org/", "HTTP://A.B.ORG/x?y://z.com/de/",
            "http://é.com/fr/é😀", "http://x.com/de/\n/q", "http://notexample.org/es/1", "http://example.org/es/", "x://y://z/"]


def test_url_verdicts(spark):
    urls = ODD_URLS + random_urls(300) + ["http://long.net/" + "ab/" * 20000] + ["http://hot.example.net/en/7"] * 150
    rows = list(enumerate(urls)) + [(0, urls[0]), (20, urls[20]), (20, urls[20]), (None, urls[30]), (None, None)]
    want = plain_verdicts([u for _, u in rows])
    expected = sorted(((i, *host_and_path(u), fitting_rule(*host_and_path(u))[1], v, round(s, 9))
                       for (i, u), (v, s) in zip(rows, want)), key=str)
    found = url_filter.pages_query(pages_of(spark, rows)).collect()
    assert sorted(((*r[:5], round(r["score"], 9)) for r in found), key=str) == expected


def test_url_models_tell_unseen_urls_apart(spark):
    """Held-out accuracy: URLs of the two kinds that no rule names."""
    rng = random.Random(3)
    rules = (("allow", "net", "/a/"), ("block", "net", "/b/"))

    def url(good, folder):
        words = ["library", "science", "history", "archive"] if good else ["casino", "pills", "bonus", "jackpot"]
        return f"http://{rng.choice('abcdefgh')}{rng.randrange(9)}.net/{folder}/{rng.choice(words)}-{rng.choice(words)}{rng.randrange(1000)}"

    known = [url(i % 2, "ba"[i % 2]) for i in range(400)]
    fresh = [url(i % 2, "c") for i in range(100)]
    found = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages_of(spark, enumerate(known + fresh)), rules).collect()}
    assert all(found[i] == ("block", "allow")[i % 2] for i in range(400))
    assert sum(found[400 + i] == ("block", "allow")[i % 2] for i in range(100)) >= 97


@pytest.mark.parametrize("urls", [[], ["http://a.org/x", None, "http://b.net/y"], ["http://a.com/de/x", "http://b.net/y"]])
def test_urls_without_examples(spark, urls):
    found = {r["page_id"]: r for r in url_filter.pages_query(pages_of(spark, enumerate(urls))).collect()}
    assert len(found) == len(urls) and all(r["score"] == 0 for r in found.values())
    assert all(r["verdict"] == ("block" if "com/de" in (u or "") else "allow") for r, u in zip(map(found.get, range(9)), urls))


# --- Filter audit -------------------------------------------------------------------------------------------------

DOCUMENTS = "doc_id bigint, text string, lang string, mask int, part string, n int, good int"


def plain_audit(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    marks = {i: [0, 0] for i, _, _ in labels}
    for i, *pair in labels:
        marks[i] = [int(a or b == 1) for a, b in zip(marks[i], pair)]
    failed = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        failed.append((lang or "", {f for f in bad if bad[f]}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [f for f in failed if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = own
            for step, x in enumerate(order, 1):
                gone = [f for f in alive if x in f[1]]
                kept = [f for f in alive if x not in f[1]]
                out[part, order, step] = [len(kept), len(gone), sum(x in f[1] for f in own) - len(gone),
                                          sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                alive = kept
    total = Counter()
    for (part, order, step), counts in out.items():
        total[part, order[step - 1]] += counts[1]
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(150))
    texts = [None, "", "   ", "\x0b\x1f", long, long + " #", long.upper(), "x " * 30000, "É" * 200, "a|b", long + "\u00a0", "AB c"]
    rows = [(rng.randrange(40), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(160)]
    rows += [(None, long, "en"), (None, None, None), (3, long, "en"), (3, long, "en")] + [(100 + i, "hot copy", "en") for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    documents = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCUMENTS)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "1 AS mask", "'y' AS part")
    found = {tuple(r) for r in filter_audit.documents_query(documents, marks).collect()}
    assert found == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.documents_query(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, 0, "", 0, 0)], DOCUMENTS)
    # An empty text fails A only: gone from its step on.
    found = {(r["filter_order"], r["step"]): r for r in filter_audit.documents_query(one, labels).collect()}
    assert len(found) == 600 and {r["part"] for r in found.values()} == {""}
    assert all(r["kept"] == (s <= o.index("A")) and r["removed"] == (o[s - 1] == "A") and r["redundant"] == 0
               and r["shapley"] == 120 * (o[s - 1] == "A") for (o, s), r in found.items())


# --- Ranked search ------------------------------------------------------------------------------------------------

def plain_ranking(rows, items, top):
    def terms(text):
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                                  "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
    held = [(i, terms(t)) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


RANKED_DOCUMENTS = "doc_id bigint, text string, shard bigint, item int, n string"


@pytest.mark.parametrize("sizes", [(256, 8192, 4096, 256, 200), (3, 40, 64, 8, 2)])
def test_ranking(spark, monkeypatch, sizes):
    """Production sizes, and sizes that make many shards, blocks and blocks of items."""
    for name, size in zip(("ITEMS", "TERMS", "SHARD_DOCUMENTS", "BLOCK_DOCUMENTS", "SEED_BLOCKS"), sizes):
        monkeypatch.setattr(ranked_search, name, size)
    rng = random.Random(7)
    vocabulary = [f"Wort{i}" for i in range(300)] + ["É", "é", "x_y", "a-b", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 60, 200])))) for i in range(400)]
    rows += [(None, rows[3][1]), (None, None), (500, ""), (501, "--- \x00"), (502, "wort1 " * 30000), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(600 + i, "hot passage of wort9 copies") for i in range(150)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40])))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "nowhere to be found"), (15, "hot passage"), (3, items[3][1]), (None, "wort1 copies"), (2, "wort7")]
    documents = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], RANKED_DOCUMENTS).repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS item", "2 AS rank")
    found = sorted((tuple(r) for r in ranked_search.ranked(documents, benchmark, 20).collect()), key=str)
    # An id whose texts differ is ranked once for each, so its ranks repeat.
    assert found == plain_ranking(rows, items, 20)


def test_ranking_of_nothing(spark):
    documents = spark.createDataFrame([(1, "a b", 1, 2, "x")], RANKED_DOCUMENTS)
    benchmark = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked_search.documents_query(documents.limit(0), benchmark).count() == 0
    assert ranked_search.documents_query(documents, benchmark.limit(0)).count() == 0
    # One document holds the only term: its weight floor(1000 * ln(4 / 3)) is positive.
    assert [tuple(r) for r in ranked_search.documents_query(documents, benchmark).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 20 * 100)))]


def test_summaries_bound_their_blocks(spark):
    """Every block's summary is an upper bound of its members' impacts, and blocks partition the lists."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"t{int(rng.expovariate(0.1))}" for _ in range(rng.choice([2, 30, 90]))), 1, 2, "x") for i in range(900)]
    documents = spark.createDataFrame(rows, RANKED_DOCUMENTS).coalesce(1)
    number = {f"t{i}".encode(): i for i in range(40)}
    vectors = ranked_search.term_vectors(documents, number)
    held = {(r["shard"], r["place"]): r for r in vectors.collect()}
    n, total = len(held), sum(r["n"] for r in held.values())
    seen = Counter()
    for block in ranked_search.term_blocks(vectors, len(number), n, total).collect():
        for place in block["members"]:
            doc = held[block["shard"], place]
            seen[block["term"]] += 1
            m = 50 + 50 * doc["n"] * n // total
            for t, k in zip(doc["terms"], doc["times"]):
                assert block["summary"][t] * ranked_search.STEP >= 10**9 * k // (1000 * k + 20 * m)
    assert seen == Counter(t for r in held.values() for t in r["terms"]) and len({r["shard"] for r in held.values()}) == 1
