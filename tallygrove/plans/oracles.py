"""DuckDB SQL with the rows of the registered queries, written on its own terms."""

from tallygrove.functions.postings import EVENT_WORDS, JOB_WORDS
from tallygrove.functions.urls import ID_LIKE_PARAMS, ID_PARAMS, NON_ID_PARAMS, SKIP_LABELS, SORT_PARAMS, TWO_LEVEL

SQL: dict[str, str] = {}
_REASON = """CASE WHEN regexp_matches(text, 'License') THEN 'exclude_title' WHEN n // 100 > 7 THEN 'years_from>7' WHEN n < 60 THEN 'years_to<60'
    WHEN lang = 'de' THEN 'category:ml' WHEN regexp_extract(text, 'the|les|und') <> '' THEN 'title:' || regexp_extract(text, 'the|les|und') ELSE 'no_keyword' END"""
_MATCH = f"SELECT doc_id, reason[:9] = 'category:' OR reason[:6] = 'title:' AS passed, reason FROM (SELECT doc_id, {_REASON} AS reason FROM (SELECT *, len(string_split(text, ' ')) AS n FROM documents))"
_KEY = "regexp_replace(lower(trim({})), '[\\s\\-_.]+', '', 'g')"
_COMPANY = "regexp_replace(lower(coalesce({}, '')), '\\(주\\)|㈜|주식회사|\\(유\\)|\\(사\\)|[^\\p{{L}}\\p{{N}}_]', '', 'g')"
_TITLE = "regexp_replace(lower(regexp_replace(coalesce({}, ''), '\\[[^\\]]*\\]|\\([^)]*\\)|【[^】]*】|<[^>]*>', '', 'g')), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL["flagship"] = """SELECT r_name, n_name, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY 1, 2"""
SQL["match_reason"] = _MATCH
SQL["top_reasons"] = f"SELECT reason, count(*) AS n FROM ({_MATCH}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
SQL["analyzable_filter"] = "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR length(coalesce(text, '')) >= 2000"
SQL["open_status_counts"] = """SELECT count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS n_high,
count(*) FILTER (o_orderpriority LIKE '1%') AS n_urgent, count(*) AS n_all FROM orders"""
SQL["count_with_total"] = "SELECT o_orderpriority, count(*) AS n, 0 AS is_total FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*), 1 FROM orders"
SQL["default_counts"] = "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY 1"
SQL["semi_in_subquery"] = "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)"
SQL["anti_left_join"] = "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL"
SQL["null_aware_not_in"] = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT nullif(l_orderkey, -1) FROM lineitem)"
SQL["four_way_left_join"] = """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
SQL["stale_or_missing"] = """SELECT c_custkey AS user_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey
AND ts >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 17 DAY)"""
SQL["latest_per_key"] = "SELECT user_id, event_id, event_type FROM events WHERE event_id IN (SELECT max(event_id) FROM events WHERE event_type <> 'view' GROUP BY user_id)"
SQL["keep_first_ordinal"] = "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2"
SQL["canonical_form"] = f"""WITH c AS (SELECT {_KEY.format('p_brand')} AS key, p_name AS form, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2)
SELECT key, form, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1"""
SQL["exploded_frequency"] = f"""SELECT {_KEY.format('p_type')} AS item, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders) AS ratio
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
SQL["solo_element"] = """SELECT item, count(*) AS n FROM (SELECT l_orderkey, any_value(p_type) AS item FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1 HAVING count(DISTINCT p_type) = 1) GROUP BY 1"""
SQL["histogram10"] = "SELECT least(9, floor(value / 10))::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1"
SQL["fingerprint"] = """SELECT (SELECT max(o_orderkey) FROM orders) || '|' || (SELECT count(*) FROM lineitem) || '|' || (SELECT sum(c_custkey) FROM customer) || '|' ||
(SELECT max(p_size) FROM part) || '|' || coalesce((SELECT max(event_id) FROM events WHERE value < 0)::VARCHAR, 'None') AS version"""
SQL["crossfilter_counts"] = """WITH r AS (SELECT *, o_orderstatus = 'O' AS a, c_mktsegment IN ('BUILDING', 'MACHINERY') AS b, o_orderpriority <> '5-LOW' AS c, o_totalprice > 100000 AS e
FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM r WHERE b AND c AND e GROUP BY ALL
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM r WHERE a AND c AND e GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM r WHERE a AND b AND e GROUP BY ALL"""
SQL["weighted_recommendation"] = """WITH p AS (SELECT c_custkey, (c_custkey % 5) * 25.0::DOUBLE AS a, CASE WHEN c_acctbal > 0 THEN least(100.0::DOUBLE, c_acctbal / 100) END AS b,
CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey * 4 END AS c FROM customer)
SELECT c_custkey, floor((a * 25 + coalesce(b * 15, 0) + coalesce(c * 10, 0)) / (25 + CASE WHEN b IS NULL THEN 0 ELSE 15 END + CASE WHEN c IS NULL THEN 0 ELSE 10 END) + 0.5)::INTEGER AS rec FROM p"""
_CREDITS = "(SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END::DOUBLE AS credit FROM part)"
_COVERAGE = f"""SELECT l_orderkey, count(DISTINCT l_partkey) AS items, CASE WHEN count(DISTINCT l_partkey) >= 3 THEN round_even(avg(coalesce(credit, 0)) * 100, 0)::INTEGER END AS score
FROM lineitem LEFT JOIN (SELECT *, TRUE AS known FROM {_CREDITS}) ON l_partkey = p_partkey WHERE known IS NULL OR credit IS NOT NULL GROUP BY 1"""
SQL["coverage_score"] = _COVERAGE
SQL["gap_list"] = f"""WITH f AS (SELECT l_orderkey, l_partkey, min((l_linenumber, l_partkey)) AS first_at FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY first_at, l_partkey) AS gaps FROM f LEFT JOIN {_CREDITS} ON l_partkey = p_partkey WHERE coalesce(credit, 0) < 1 GROUP BY 1"""
SQL["combined_fit"] = f"""SELECT l_orderkey AS o_orderkey, CASE WHEN score IS NULL THEN l_orderkey % 101 ELSE round_even(0.75::DOUBLE * (l_orderkey % 101) + 0.25::DOUBLE * score, 0)::INTEGER END AS fit FROM ({_COVERAGE})"""
SQL["rescore_changed"] = """SELECT l_orderkey, hits, cuts FROM (SELECT l_orderkey, count(*) FILTER (l_tax > 0.05) AS hits, nullif(count(*) FILTER (l_discount > 0.05), 0) AS cuts,
count(*) FILTER (l_tax > 0.02) AS h, nullif(count(*) FILTER (l_discount > 0.02), 0) AS c FROM lineitem GROUP BY 1) WHERE hits IS DISTINCT FROM h OR cuts IS DISTINCT FROM c"""
_LIKE = "(a.title <> '' AND b.title <> '' AND (a.title = b.title OR (least(length(a.title), length(b.title)) >= 6 AND (contains(a.title, b.title) OR contains(b.title, a.title)))))"
_DEDUPE = f"""WITH r AS (SELECT p_partkey AS id, {_COMPANY.format('p_brand')} AS company, {_TITLE.format('p_name')} AS title, length(p_type) % 3 AS priority FROM part),
p0 AS (SELECT * FROM r WHERE priority = 0),
d1 AS (SELECT a.id, (SELECT min(b.id) FROM p0 b WHERE b.company = a.company AND {_LIKE}) AS dup_of FROM r a WHERE priority = 1),
p1 AS (SELECT * FROM p0 UNION ALL SELECT r.* FROM r JOIN d1 USING (id) WHERE dup_of IS NULL),
d2 AS (SELECT a.id, (SELECT min((b.priority, b.id)) FROM p1 b WHERE b.company = a.company AND {_LIKE}) AS best FROM r a WHERE priority = 2)
SELECT id, NULL::BIGINT AS dup_of FROM p0 UNION ALL SELECT id, dup_of FROM d1 UNION ALL SELECT id, best[2] FROM d2"""
SQL["greedy_dedupe"] = _DEDUPE
SQL["containment_pairs"] = """WITH s AS (SELECT DISTINCT c_custkey AS owner, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 46), z AS (SELECT owner, count(*) AS n FROM s GROUP BY 1)
SELECT a.owner AS a, b.owner AS b, count(*) / any_value(z.n) AS containment FROM s a JOIN s b ON a.item = b.item AND a.owner <> b.owner JOIN z ON z.owner = a.owner GROUP BY 1, 2 HAVING containment >= 0.5"""
_SIGHT = """r AS (SELECT event_type AS source, user_id AS id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 5)::INTEGER AS page FROM events),
k AS (SELECT DISTINCT source, id FROM r WHERE id % 2 = 0 OR page > 20),
f AS (SELECT source, page, count(*) AS ids, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.source = x.source AND k.id = x.id)) AS fresh,
    count(*) FILTER (NOT EXISTS (SELECT 1 FROM r e WHERE e.source = x.source AND e.id = x.id AND e.page < x.page)) AS unseen
    FROM (SELECT DISTINCT * FROM r) x GROUP BY 1, 2)"""
SQL["incremental_stop"] = f"""WITH {_SIGHT},
s AS (SELECT source, page + 1 AS n, fresh, unseen, lag(fresh) OVER (PARTITION BY source ORDER BY page) AS before, max(page + 1) OVER (PARTITION BY source) AS last,
    EXISTS (SELECT 1 FROM k WHERE k.source = f.source) AS known FROM f)
SELECT source, coalesce(min(CASE WHEN n = 1 THEN CASE WHEN known AND fresh = 0 THEN 1 END WHEN unseen = 0 THEN n - 1 WHEN fresh = 0 AND before = 0 AND n > 2 THEN n END), any_value(last))::INTEGER AS last_page
FROM s GROUP BY 1"""
SQL["barren_stop"] = f"WITH {_SIGHT} SELECT source, coalesce(min(CASE WHEN unseen = 0 OR ids < 3 THEN page + 1 END), max(page + 1))::INTEGER AS last_page FROM f GROUP BY 1"
SQL["incremental_anti"] = "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01') GROUP BY 1"
SQL["vanish_guard"] = """WITH r AS (SELECT c_nationkey AS source, c_custkey AS id FROM customer), s AS (SELECT * FROM r WHERE id % (2 + source % 2) <> 0 AND source % 4 <> 3)
SELECT source, id FROM r WHERE (SELECT count(*) FROM s WHERE s.source = r.source) > 0 AND (SELECT count(*) FROM s WHERE s.source = r.source) >= 0.5 * (SELECT count(*) FROM r q WHERE q.source = r.source)
AND id NOT IN (SELECT id FROM s)"""
SQL["upsert_snapshot"] = """WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), n AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_totalprice > 100000 THEN o_totalprice + 1 END AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01')
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.s ELSE o.o_orderstatus END AS o_orderstatus, coalesce(n.p, o.o_totalprice) AS o_totalprice,
coalesce(o.o_orderpriority, 'new') AS o_orderpriority FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""
SQL["replace_and_insert"] = "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_size + 100 WHEN p_size > 10 THEN p_size ELSE -1 END AS p_size FROM part"
SQL["hash_upsert_class"] = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'inserted' WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS class, count(*) AS n FROM orders GROUP BY 1"
SQL["orphan_close"] = """SELECT event_id, floor(epoch(TIMESTAMP '2024-01-30 00:00:00' - ts) / 60)::BIGINT AS age_minutes FROM events
WHERE event_type = 'error' AND epoch(TIMESTAMP '2024-01-30 00:00:00' - ts) > 30 * 60"""
SQL["stale_lock"] = """SELECT user_id, max(event_id) AS run FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 60 MINUTE
AND ts < TIMESTAMP '2024-01-20 12:00:00' + INTERVAL 1 MINUTE GROUP BY 1"""
_STREAK = """SELECT user_id, count(*) FILTER (bad AND ok_after = 0) AS streak FROM (SELECT user_id, event_type IN ('error', 'view', 'click') AS bad,
count(*) FILTER (event_type NOT IN ('error', 'view', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok_after FROM events) GROUP BY 1"""
SQL["failure_streak"] = _STREAK
SQL["site_state"] = f"SELECT *, CASE WHEN streak >= 7 THEN 'dead' WHEN streak >= 3 THEN 'paused' ELSE 'active' END AS status FROM ({_STREAK})"
SQL["cumulative_total"] = """SELECT o_custkey, o_orderkey, length(o_orderpriority)::INTEGER AS added,
sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders"""
SQL["page_slice"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 300"
SQL["case_insensitive_sort"] = "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey)::INTEGER AS place FROM part"
SQL["status_rank_sort"] = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 9 END, o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders"""
SQL["top_n_tiebreak"] = "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 25"
SQL["limit_or_all"] = "SELECT n_nationkey, n_name FROM nation"
SQL["top_k_per_group"] = "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS place FROM part QUALIFY place <= 3"
SQL["shares_of_top"] = "SELECT p_brand, count(*) AS n, count(*) / max(count(*)) OVER () AS bar, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8"
_AB = "a AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 300000)"
SQL["union_keep_first"] = f"WITH {_AB} SELECT id, min(precedence)::INTEGER AS precedence FROM (SELECT id, 0 AS precedence FROM a UNION ALL SELECT id, 1 FROM b) GROUP BY 1"
SQL["except_intersect"] = f"WITH {_AB} SELECT id, 'only_a' AS side FROM (SELECT id FROM a EXCEPT ALL SELECT id FROM b) UNION ALL SELECT id, 'both' FROM (SELECT id FROM a INTERSECT SELECT id FROM b)"
SQL["subset_test"] = """WITH u AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (value > 80), []) AS high, coalesce(list(DISTINCT event_type) FILTER (value < 5), []) AS low FROM events GROUP BY 1)
SELECT user_id, list_has_all(high, low) AS is_subset, len(list_intersect(low, high))::INTEGER AS shared FROM u"""
SQL["text_keys"] = f"SELECT doc_id, {_KEY.format('text')} AS label, {_COMPANY.format('text')} AS company, {_TITLE.format('text')} AS title FROM documents"
SQL["contacts"] = """WITH e AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') AS found FROM documents),
x AS (SELECT doc_id, unnest(found) AS email, generate_subscripts(found, 1) AS p FROM e), f AS (SELECT doc_id, email, min(p) AS p FROM x GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::INTEGER AS pos, email FROM f QUALIFY pos <= 50"""
_URL = r"""u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][\w+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][\w+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
v AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '^[^=]*=.')) AS pairs FROM u)"""
_NAME = "lower(split_part(p, '=', 1))"
_VALUE = "regexp_replace(p, '^[^=]*=', '')"
SQL["external_id"] = f"""WITH {_URL} SELECT page_id, coalesce(
list_filter(seg, lambda s: regexp_full_match(s, '[0-9]+'))[-1],
(list_transform(list_filter(pairs, lambda p: {_NAME} IN {_in(ID_PARAMS)}), lambda p: {_VALUE}))[1],
(list_transform(list_filter(pairs, lambda p: {_NAME} NOT IN {_in(NON_ID_PARAMS)} AND regexp_matches({_NAME}, '(seq|id|no|idx|num|key|code|pk)$')), lambda p: {_VALUE}))[1],
(list_transform(list_filter(pairs, lambda p: {_NAME} NOT IN {_in(NON_ID_PARAMS)} AND regexp_full_match({_VALUE}, '[0-9]+')), lambda p: {_VALUE}))[1],
seg[-1], regexp_replace(url, '#.*$', '')) AS external_id FROM v"""
SQL["site_ids"] = f"""WITH {_URL}, l AS (SELECT *, string_split(lower(host), '.') AS labels FROM v),
t AS (SELECT *, array_to_string(labels[-2:], '.') AS tail, len(labels) >= 3 AND array_to_string(labels[-2:], '.') IN {_in(TWO_LEVEL)} AS country FROM l),
o AS (SELECT *, CASE WHEN country THEN labels[:len(labels) - 2] WHEN len(labels) >= 2 THEN labels[:len(labels) - 1] ELSE labels END AS own FROM t),
n AS (SELECT *, list_filter(own, lambda x: x NOT IN {_in(SKIP_LABELS)}) AS named FROM o)
SELECT page_id, lower(host) AS host, CASE WHEN NOT country THEN coalesce(named[1], own[-1]) WHEN tail = 'go.kr' AND len(named) >= 2 THEN named[1] ELSE coalesce(named[-1], own[-1]) END AS site_id,
tail AS registrable, regexp_replace(url, '[^/]*$', '') AS prefix FROM n"""
SQL["url_params"] = f"""WITH {_URL}, x AS (SELECT page_id, unnest(pairs) AS p, generate_subscripts(pairs, 1) AS pos FROM v)
SELECT page_id, pos::INTEGER AS pos, split_part(p, '=', 1) AS name, {_VALUE} AS value FROM x"""
SQL["url_pattern"] = rf"""WITH {_URL}, n AS (SELECT *, list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: split_part(p, '=', 1)) AS names,
regexp_extract(rtrim(path, '/'), '[^/]*$') AS last FROM v)
SELECT page_id, regexp_extract(url, '^[A-Za-z][\w+.\-]*://[^/?#]*') || regexp_replace(regexp_replace(regexp_replace(path, '\d+', '{{N}}', 'g'), '/[^\x00-\x7F][^/]*\.htm$', '/{{KW}}.htm'), '/%[A-F0-9]{{2}}[^/]*\.htm', '/{{KW}}.htm', 'g') AS pattern,
query <> '' AND NOT (regexp_full_match(last, '[0-9]+') OR (length(last) >= 8 AND regexp_matches(last, '[0-9]') AND NOT regexp_matches(last, '\.(jsp|php|do|html|htm|asp)$')))
AND NOT list_has_any(names, {_list(ID_LIKE_PARAMS)}) AND len(names) > 0 AND list_has_all({_list(SORT_PARAMS)}, names) AS sort_only FROM n"""
_ANCHOR = """a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hrefs FROM pages),
h AS (SELECT page_id, generate_subscripts(hrefs, 1)::INTEGER AS pos, unnest(hrefs) AS href FROM a)"""
SQL["anchor_extract"] = f"WITH {_ANCHOR} SELECT page_id, pos, href FROM h"
SQL["anchor_fingerprint_stats"] = f"""WITH {_ANCHOR} SELECT CASE WHEN regexp_extract(href, '^javascript:\\s*([\\w$.]+)\\s*\\(', 1) <> '' THEN 'js:' || regexp_extract(href, '^javascript:\\s*([\\w$.]+)\\s*\\(', 1)
ELSE regexp_replace(href, '[?#].*$', '') END AS fingerprint, count(*) AS n, count(DISTINCT href) AS n_urls, count(DISTINCT page_id) AS n_pages FROM h GROUP BY 1"""
_TEXTS = """a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS texts FROM pages),
h AS (SELECT page_id, unnest(hrefs) AS href, unnest(texts) AS text FROM a)"""
_WORDS = lambda words: f"coalesce(regexp_matches(text, '(?i){'|'.join(words)}'), false)"
SQL["list_quality"] = f"""WITH {_TEXTS}, m AS (SELECT page_id, count(*) AS list_rows, avg((length(href) > 1)::INTEGER) AS l, avg({_WORDS(JOB_WORDS)}::INTEGER) AS t, count(*) FILTER ({_WORDS(JOB_WORDS)}) AS title_hits,
avg({_WORDS(EVENT_WORDS)}::INTEGER) AS e, count(DISTINCT regexp_replace(href, '\\d+', '{{N}}', 'g')) / count(*) AS path_ratio, avg((href = '/')::INTEGER) AS p, avg(starts_with(href, 'http')::INTEGER) AS x FROM h GROUP BY 1)
SELECT page_id, list_rows, title_hits, round(path_ratio, 6) AS path_ratio, CASE WHEN list_rows < 2 THEN 'list_rows' WHEN l < 0.5 THEN 'link_ratio' WHEN t < 0.1 THEN 'title_floor' WHEN t < 0.3 AND title_hits < 2 THEN 'title_ratio'
WHEN path_ratio > 0.5 THEN 'path_ratio' WHEN e > 0.5 THEN 'event_ratio' WHEN p > 0.7 THEN 'parent_ratio' WHEN x > 0.5 THEN 'external_ratio' ELSE 'ok' END AS reason FROM m"""
SQL["json_extract_props"] = "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events"
SQL["profile_hash"] = "SELECT doc_id, sha1(text)[:12] AS hash FROM documents"
SQL["company_scores"] = """WITH c AS (SELECT *, c_custkey AS k, c_acctbal / 10 AS rev, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 7 % 6000 END AS emp, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 50 - 20 END AS growth FROM customer),
s AS (SELECT *, CASE WHEN emp > 0 THEN CASE WHEN emp >= 5000 THEN 100 WHEN emp >= 1000 THEN 90 WHEN emp >= 300 THEN 75 WHEN emp >= 50 THEN 50 WHEN emp >= 10 THEN 30 ELSE 15 END WHEN k % 4 = 0 THEN 50 END AS sz FROM c)
SELECT c_custkey, CASE WHEN k % 11 = 0 THEN greatest(coalesce(sz, 0), 90) ELSE sz END::INTEGER AS size, greatest(0, round_even(100 - (k % 30 + 1) * 1.5::DOUBLE, 0))::INTEGER AS pay,
greatest(0, least(100, 50 + CASE k % 3 WHEN 0 THEN 15 WHEN 1 THEN 15 ELSE 10 END + CASE WHEN k % 2 = 0 THEN CASE WHEN c_acctbal > 0 THEN 10 ELSE -10 END ELSE 0 END
+ CASE WHEN growth IS NULL THEN 0 WHEN growth >= 20 THEN 8 WHEN growth >= 0 THEN 3 WHEN growth < -10 THEN -8 ELSE -3 END))::INTEGER AS stability,
CASE WHEN rev <= 0 THEN 5 WHEN rev < 10 THEN 15 WHEN rev < 50 THEN 30 WHEN rev < 100 THEN 45 WHEN rev < 500 THEN 60 WHEN rev < 1000 THEN 75 WHEN rev < 5000 THEN 88 ELSE 100 END AS revenue,
CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS n_welfare FROM s"""
SQL["entity_match"] = """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 500
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) = 1"""
SQL["recheck_average"] = """SELECT doc_id, CASE WHEN a BETWEEN 60 AND 85 AND b IS NOT NULL THEN round_even((a + b) / 2, 0)::INTEGER ELSE a END::INTEGER AS fit
FROM (SELECT doc_id, doc_id % 101 AS a, 60 + quality * 15 + toxic AS b FROM documents LEFT JOIN labels USING (doc_id))"""
SQL["batch_ids"] = "SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 6)::BIGINT AS batch_id FROM documents"
SQL["coverage_deficit"] = """SELECT o_orderkey, greatest(0, o_orderkey % 7 - coalesce(n, 0)) AS deficit, CASE WHEN n IS NULL THEN 'nothing loaded' WHEN o_orderkey % 7 > n THEN 'partial' ELSE 'complete' END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
SQL["duplicates_attached"] = f"SELECT p_partkey, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS copies FROM part LEFT JOIN ({_DEDUPE}) ON dup_of = p_partkey GROUP BY 1"
SQL["rename_and_remove"] = """WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3)
SELECT 'orders' AS name, count(*) AS n FROM orders WHERE CASE WHEN o_custkey = 7 THEN 999999 ELSE o_custkey END NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'customer', count(*) FROM customer WHERE CASE WHEN c_custkey = 7 THEN 999999 ELSE c_custkey END NOT IN (SELECT k FROM gone)"""
SQL["rollup_report"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, round(sum(value) FILTER (event_type <> 'error'), 4) AS total, max(event_id) AS last
FROM events GROUP BY 1"""
