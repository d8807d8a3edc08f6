"""DuckDB SQL for the contract queries that SQL can express."""

OP2 = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
ps AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM ps),
d AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM d GROUP BY doc_id),
m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
t AS (SELECT doc_id, host, unnest(['base', 'symbols', 'dup_lines', 'word_length']) AS rule,
             unnest([base_failed, 5 * n_symbols > n_words AND n_words > 0, 10 * n_dup_lines > 6 * n_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words]) AS failed FROM f),
h AS (SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM t GROUP BY ALL),
s AS (SELECT rule, count(*) AS hosts, sum(n) AS total, sum(k)::DOUBLE / sum(n) AS m, sum(k * k / n) / sum(n) AS q FROM h GROUP BY rule),
v AS (SELECT *, q - m * m - m * (1 - m) * hosts / total AS v FROM s),
b AS (SELECT rule, m, CASE WHEN v <= 1e-12 THEN 10000.0 ELSE greatest(1.0, least(10000.0, m * (1 - m) / v - 1)) END AS s FROM v),
p AS (SELECT host, rule, m, (k + s * m) / (n + s) AS rate FROM h JOIN b USING (rule)),
x AS (SELECT host, bool_and(rate <= greatest(0.3, 4 * m)) AS host_kept FROM p GROUP BY host),
g2 AS (SELECT doc_id, bool_or(failed AND NOT rate < m / 4) AS gone FROM t JOIN p USING (host, rule) WHERE rule <> 'base' GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_kept AND NOT gone) AS kept, host_kept
FROM f JOIN x USING (host) JOIN g2 USING (doc_id)
"""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP7 = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, octet_length(x) - 49)) AS p, unnest(list_transform(range(0, octet_length(x) - 49), lambda k: md5_number(x[k + 1 : k + 50]))) AS g FROM t WHERE octet_length(x) >= 50),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
w AS (SELECT doc_id, p, first FROM p JOIN f USING (g)),
d AS (SELECT doc_id, p, CASE WHEN lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 >= p THEN 0 ELSE 1 END AS opens FROM w WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM d),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY ALL),
g AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev, b FROM r),
s AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(hex(x[prev + 1 : a]), '' ORDER BY a) || hex(any_value(x)[max(b) + 1 : octet_length(any_value(x))]) AS left_x FROM g JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_x, hex(x)))) AS kept_sha256
FROM t LEFT JOIN s USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, ws[i : i + least(10, len(ws)) - 1] AS g FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, ws[i : i + n - 1] AS g FROM (SELECT d.*, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op2_host_rules": OP2, "op7_repeats": OP7, "op10_decontaminate": OP10}
