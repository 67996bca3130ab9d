"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

# Pieces between matches and the matches themselves give the positions, kind by kind.
_SECRETS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(k, kind, least) AS (VALUES
  (0, 'assign', 6),
  (1, 'access', 20),
  (2, 'hex', 24)),
cut AS (
  SELECT r, k, kind, least, CASE k WHEN 0 THEN regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS hits,
    CASE k WHEN 0 THEN regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS held,
    CASE k WHEN 0 THEN string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+') ELSE string_split_regex(t, '[0-9a-f]+') END AS gaps
  FROM docs, kinds),
flat AS (SELECT r, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, hits, held, gaps FROM cut),
ended AS (
  SELECT r, k, kind, least, i, length(hits[i]) AS n, length(held[i]) AS held_n,
    sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM flat),
spans AS (SELECT r, k, kind, stop - n AS start, stop FROM ended WHERE held_n >= least),
lists AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (r)
"""

# Plain window equality: every window of a document against every window of an item.
_PHRASES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, w FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
lengths AS (SELECT DISTINCT least(len(w), 10) AS n FROM items),
asked AS (
  SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items)),
there AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
met AS (SELECT r, item_id, i, n FROM there JOIN asked USING (n, words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes; its table follows from the polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            f"lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)")


def _shards(bits: int = 5, count: int = 8) -> str:
    """The curve walked level by level over ranked values; the tables of the curve follow from its rule."""
    from revlumen.llm.hilbert import curve_table

    digits, following = curve_table(3)
    names = ("source", "lang", "size")
    ranks = ", ".join(
        f"r_{n} AS (SELECT {n} AS v, (coalesce(sum(k) OVER (ORDER BY {n} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        f" * {1 << bits} // (SELECT count(*) FROM d))::BIGINT AS b FROM (SELECT {n}, count(*) AS k FROM d GROUP BY {n}))" for n in names)
    level = "SELECT doc_id, size, text_crc32, r_source.b AS b0, r_lang.b AS b1, r_size.b AS b2, 0 AS s, 0::BIGINT AS h FROM d "
    level += " ".join(f"JOIN r_{n} ON d.{n} IS NOT DISTINCT FROM r_{n}.v" for n in names)
    for at in reversed(range(bits)):
        corner = f"(s * 8 + ((b0 >> {at}) & 1) + ((b1 >> {at}) & 1) * 2 + ((b2 >> {at}) & 1) * 4 + 1)"
        level = f"SELECT doc_id, size, text_crc32, b0, b1, b2, {following}[{corner}] AS s, h * 8 + {digits}[{corner}] AS h FROM ({level})"
    # The tables hold no repeated ids, so ids alone break ties.
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, text, coalesce(strlen(text), 0) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
{ranks}, placed AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY h, doc_id) - 1 AS p FROM ({level})),
n AS (SELECT count(*) AS n FROM d)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * {count} // n)::INTEGER AS shard,
  p - ((p * {count} // n) * n + {count - 1}) // {count} AS slot, NULL::INTEGER AS grown_shard FROM placed, n
"""


# All pairs that share a shingle, and everything that links reach.
_NEAR = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s FROM (
    SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, x) AS (SELECT r, r FROM docs UNION SELECT reach.r, steps.b FROM reach JOIN steps ON steps.a = reach.x),
least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.x GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least USING (r) LEFT JOIN sizes USING (r)
"""


# Each order is walked filter by filter; a document counts as gone from its first failure on.
_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
marks AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1)::INTEGER AS good, max(coalesce(toxic, 0) = 1)::INTEGER AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
  FROM docs JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s::INTEGER AS s, substr(o, s::INTEGER, 1) AS x FROM orders, range(1, 6) AS r(s)),
grouped AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: f[k]) AS failed
  FROM fails GROUP BY part, f),
seen AS (
  SELECT part, o, s, x, n, good, toxic, f[x] AS bad, len(failed) = 1 AS one,
    len(list_filter(failed, lambda k: instr(o, k) < s)) > 0 AS gone FROM grouped, steps),
counted AS (
  SELECT part, o AS filter_order, s AS step, x, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bad AND one), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, o, s, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM counted
"""

# Every document against every item.
_RANKED = r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
lengths AS (SELECT r, doc_id, count(*) AS n FROM words GROUP BY r, doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT r, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)) AS impact
  FROM postings JOIN lengths USING (r), totals),
scores AS (
  SELECT item_id, r, doc_id, sum(w * impact)::BIGINT AS score FROM impacts JOIN weights USING (term) JOIN asked USING (term)
  GROUP BY item_id, r, doc_id),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
"""


def _url_models(order: int = 5) -> str:
    """The models order by order: counts of a run and of its context, smoothed with the next shorter run."""
    from revlumen.llm.url_filter import BINS_PER_NAT, HELD_OUT_TENTHS, LEAST_SEEN, RULES, UNIT

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    whole = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    models = "m0 AS (SELECT run, 1.0::DOUBLE / (count(*) OVER () + 1) AS allow, 1.0::DOUBLE / (count(*) OVER () + 1) AS block FROM (SELECT DISTINCT run[-1:] AS run FROM runs))"
    for k in range(order + 1):
        least = LEAST_SEEN if k else 1
        chance = ("CASE WHEN all_{0} >= " + str(least) + " THEN ({0} + kinds_{0} * below_{0}) / (all_{0} + kinds_{0}) ELSE below_{0} END AS {0}")
        rest = "run[2:]" if k else "run"
        models += f""",
c{k} AS (SELECT run[-{k + 1}:] AS run, sum(allow) AS allow, sum(block) AS block FROM runs GROUP BY ALL),
w{k} AS (SELECT *, sum(allow) OVER c AS all_allow, sum(block) OVER c AS all_block, count(*) FILTER (allow > 0) OVER c AS kinds_allow,
  count(*) FILTER (block > 0) OVER c AS kinds_block FROM c{k} WINDOW c AS (PARTITION BY run[:{k}])),
m{k + 1} AS (SELECT run, {chance.format("allow")}, {chance.format("block")} FROM (
  SELECT w{k}.*, s.allow AS below_allow, s.block AS below_block FROM w{k} JOIN m{k} s ON s.run = w{k}.{rest}))"""
    return f"""
WITH pages_ AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
split AS (
  SELECT r, page_id, {lower.format(f"regexp_extract(url, {whole}, 1)")} AS host, regexp_extract(url, {whole}, 2) AS path,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE url END AS rest FROM pages_),
read_ AS (
  SELECT r, page_id, host, path, {lower.format("regexp_extract(rest, '^[^/?#]*')")} || substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS text FROM split),
rules(ruled, rule_host, rule_path) AS (VALUES {rules}),
fits AS (
  SELECT r, first(ruled ORDER BY length(rule_host || rule_path) DESC) AS ruled, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule
  FROM read_ JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
urls AS (
  SELECT r, page_id, host, path, text, rule, ruled, ruled IS NOT NULL AND {_crc32("text")} % 10 < {HELD_OUT_TENTHS} AS held FROM read_ LEFT JOIN fits USING (r)),
marked AS (SELECT r, text, ruled, held, repeat(chr(2), {order}) || text || chr(3) AS t FROM urls WHERE text <> ''),
places AS (SELECT r, CASE WHEN NOT held THEN ruled END AS trained, t[i:i + {order}] AS run FROM (
  SELECT r, held, ruled, t, unnest(range(1, length(t) - {order} + 1)) AS i FROM marked)),
runs AS (SELECT run, count(*) FILTER (trained = 'allow') AS allow, count(*) FILTER (trained = 'block') AS block FROM places GROUP BY run),
{models},
ratios AS (SELECT run, CASE WHEN (SELECT sum(allow) > 0 AND sum(block) > 0 FROM runs) THEN round(ln(allow / block) * {UNIT})::BIGINT ELSE 0 END AS ratio FROM m{order + 1}),
sums AS (SELECT r, sum(ratio)::DOUBLE / count(*) / {UNIT} AS score FROM places JOIN ratios USING (run) GROUP BY r),
scored AS (SELECT urls.*, coalesce(score, 0) AS score, score IS NULL AS silent FROM urls LEFT JOIN sums USING (r)),
bins AS (
  SELECT floor(score * {BINS_PER_NAT})::BIGINT AS bin, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block
  FROM scored WHERE held GROUP BY 1),
edges AS (
  SELECT bin, (SELECT coalesce(sum(allow), 0) FROM bins b WHERE b.bin >= e.bin) AS passed,
    (SELECT coalesce(sum(block), 0) FROM bins b WHERE b.bin < e.bin) AS stopped
  FROM (SELECT unnest(range(least(min(bin), 0), greatest(max(bin) + 1, 0) + 1)) AS bin FROM bins) e),
cut AS (
  SELECT coalesce((SELECT bin FROM edges, (SELECT sum(allow) AS a, sum(block) AS b FROM bins) WHERE a > 0 AND b > 0
    ORDER BY passed * b + stopped * a DESC, abs(bin), bin LIMIT 1), 0) / {BINS_PER_NAT}.0::DOUBLE AS cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut OR silent THEN 'allow' ELSE 'block' END) AS verdict, score FROM scored, cut
"""


ORACLE_SQL = {
    "op1_secret_ledger": _SECRETS,
    "op4_hilbert_shards": _shards(),
    "op5_circulant_minhash": _NEAR,
    "op10_phrase_index": _PHRASES,
    "op11_url_models": _url_models(),
    "op12_filter_audit": _AUDIT,
    "op13_ranked_search": _RANKED,
}
