"""DuckDB SQL that gives the rows of the queries which SQL can express, by plain definitions."""

URL_FILTER = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rule, rhost, rpath) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), m AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (page_id)
"""

QUALITY_RULES = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS r(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, n_symbols > n_words AS f3, n_lines > 1 AND 2 * n_dup_lines > n_lines AS f4 FROM m
), host AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS bad FROM f) GROUP BY source, rule
), mean AS (
  SELECT rule, sum(bad) / sum(n) AS p, sum(n) AS total, count(*) AS k, sum(n * n) AS n2 FROM host GROUP BY rule
), spread AS (
  SELECT rule, p, p * (1 - p) AS chance, (sum(n * (bad / n - p) ** 2) - (any_value(k) - 1) * p * (1 - p)) / greatest(any_value(total) - any_value(n2) / any_value(total), 1e-9) AS beyond
  FROM host JOIN mean USING (rule) GROUP BY rule, p
), prior AS (
  SELECT rule, p, CASE WHEN beyond > 1e-12 THEN least(greatest(chance / beyond - 1, 1.0), 1e9) ELSE 1e9 END AS strength FROM spread
), bad_host AS (
  SELECT source, bool_or((bad + p * strength) / (n + strength) > 0.5) AS host_bad FROM host JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT host_bad AS kept
FROM f JOIN bad_host ON f.source IS NOT DISTINCT FROM bad_host.source
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM t)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM (SELECT sh.*, n FROM sh JOIN n USING (doc_id)) a JOIN (SELECT sh.*, n FROM sh JOIN n USING (doc_id)) b
    ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a
)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(c, t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(c, t.doc_id)) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

NEAR_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.a = vec_id
"""
