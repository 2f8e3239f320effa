"""DuckDB SQL with the rows of those queries that SQL can express."""

SQL: dict[str, str] = {}

# base32 of a hexadecimal SHA-1: five hexadecimal digits are four base32 characters
SQL["op5_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
        list_transform(range(0, 8), lambda g: ('0x' || substr(h, g * 5 + 1, 5))::INTEGER) AS parts
    FROM p
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
    array_to_string(list_transform(range(0, 32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def _licenses() -> str:
    """Every template in every window, counted exactly, and the rule between templates that share much."""
    from tallygrove.llm.licenses import OWN_SHARE, SHINGLE, TEMPLATES, margins, rivals, shingles_of

    n, reach, pairs = {name: len(shingles_of(t)) for name, t in TEMPLATES.items()}, margins(TEMPLATES), rivals(TEMPLATES)
    rows = ", ".join(f"('{name}', {n[name]}, {reach[n[name]]}, '{' '.join(x)}')" for name, t in TEMPLATES.items() for x in shingles_of(t))
    own = ", ".join(f"('{a}', '{b}', {n[a]}, {len(part)}, '{x}')" for a, b, part in pairs for x in part)
    return f"""
WITH t(license, n, margin, shingle) AS (VALUES {rows}),
o(large, small, large_n, own_n, shingle) AS (VALUES {own}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(0, greatest(0, len(words) - {SHINGLE - 1}))) AS p, words FROM w),
h AS (
    SELECT doc_id, license, n, margin, shingle, p, greatest(1, n // 4) AS step
    FROM (SELECT doc_id, p, array_to_string(words[p + 1 : p + {SHINGLE}], ' ') AS shingle FROM s) JOIN t USING (shingle)
),
k AS (SELECT *, unnest(range(greatest(0, ceil((p - (n + step - 1) + 1) / step)::BIGINT), p // step + 1)) AS k FROM h),
c AS (
    SELECT doc_id, license, k, k * step AS first, k * step + n + step - 2 AS last, n, margin, count(DISTINCT shingle) / n AS containment
    FROM k GROUP BY doc_id, license, n, margin, step, k HAVING count(DISTINCT shingle) / n >= 0.8
),
without_own AS (
    SELECT c.doc_id, c.license, c.k
    FROM c JOIN o ON o.large = c.license LEFT JOIN h ON h.doc_id = c.doc_id AND h.license = o.large AND h.shingle = o.shingle AND h.p BETWEEN c.first AND c.last
    GROUP BY c.doc_id, c.license, c.k, o.small, o.own_n HAVING count(DISTINCT h.shingle) < {OWN_SHARE} * o.own_n
),
in_larger AS (
    SELECT c.doc_id, c.license, c.k
    FROM c JOIN (SELECT DISTINCT large, small, large_n, own_n FROM o) AS r ON r.small = c.license AND r.large_n > c.n
    JOIN h ON h.doc_id = c.doc_id AND h.license = r.large AND h.p BETWEEN c.first - c.margin AND c.last + c.margin
    LEFT JOIN o ON o.large = r.large AND o.small = r.small AND o.shingle = h.shingle
    GROUP BY c.doc_id, c.license, c.k, r.large, r.large_n, r.own_n
    HAVING count(DISTINCT h.shingle) / r.large_n >= 0.8 AND count(DISTINCT o.shingle) >= {OWN_SHARE} * r.own_n
)
SELECT doc_id, license, max(containment) AS containment FROM c
WHERE (doc_id, license, k) NOT IN (SELECT * FROM without_own) AND (doc_id, license, k) NOT IN (SELECT * FROM in_larger)
GROUP BY ALL
"""


SQL["op3_licenses"] = _licenses()

# all pairs of distinct lines of five characters or more (the longer one) that share a half, by edit distance
SQL["op1_lines"] = """
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (
    SELECT doc_id, pos - 1 AS pos, parts[pos] AS line
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM s) WHERE regexp_matches(parts[pos], '[^\x20\x09-\x0D]')
),
c AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first_at FROM l GROUP BY line),
k AS (
    SELECT line, n, first_at, unnest([
        'p' || n || substr(line, 1, n // 2), 'p' || (n - 1) || substr(line, 1, (n - 1) // 2),
        's' || n || right(line, n // 2), 's' || (n - 1) || right(line, (n - 1) // 2)]) AS half FROM c
),
near AS (
    SELECT DISTINCT a.line FROM k a JOIN k b ON a.half = b.half AND b.first_at < a.first_at AND abs(a.n - b.n) <= 1 AND greatest(a.n, b.n) >= 5
    WHERE levenshtein(a.line, b.line) <= 1
),
gone AS (
    SELECT l.doc_id, l.pos, length(l.line) AS chars FROM l JOIN c USING (line) LEFT JOIN near ON near.line = l.line
    WHERE near.line IS NOT NULL OR (l.doc_id, l.pos) > c.first_at
),
g AS (SELECT doc_id, count(*) AS n_removed, sum(chars) AS removed_chars, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN coalesce(s.text, '') = '' THEN 0 ELSE len(s.parts) END AS n_lines,
    coalesce(g.n_removed, 0) AS n_removed, coalesce(g.removed_chars, 0)::BIGINT AS removed_chars, coalesce(g.removed, '') AS removed
FROM s LEFT JOIN g USING (doc_id)
"""

# crc32 from its polynomial, byte by byte over a table that SQL makes; words that share a deletion, then forms followed to their roots
SQL["op12_spelling"] = """
WITH RECURSIVE crc_table AS MATERIALIZED (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(0, 256)) AS i))
),
r AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
),
h AS (
    SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM (SELECT run, k, encode(doc_id || ':' || run) AS b FROM r WHERE length(run) >= 5), crc_table
),
v AS (
    SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
pairs AS (
    SELECT a.word, b.word AS other, b.n FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest
    UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest
),
best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM pairs GROUP BY word),
formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
    FROM v LEFT JOIN best USING (word)
),
onward AS (
    SELECT word, word AS root FROM formed WHERE form IS NULL
    UNION ALL SELECT f.word, o.root FROM formed AS f JOIN onward AS o ON f.form = o.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN onward USING (word)
"""

# all windows of 35 words, counted as texts
SQL["op13_doubling"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
k AS (SELECT row, i, array_to_string(words[i + 1 : i + 35], ' ') AS w FROM (SELECT row, words, unnest(range(0, len(words) - 34)) AS i FROM d)),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS pos FROM k WHERE w IN (SELECT w FROM k GROUP BY w HAVING count(*) > 1)),
kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
    FROM (SELECT row, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM d) ANTI JOIN gone USING (row, pos) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)
"""
