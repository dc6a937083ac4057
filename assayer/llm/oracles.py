"""The SQL (DuckDB) of the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       n_chars,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""

_QUALITY_BASE = r"""
words AS (
  SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM documents)
),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n
  FROM (
    SELECT doc_id, pos, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  ) WHERE third IS NOT NULL
),
repeats AS (
  SELECT doc_id, count(DISTINCT covered) AS n
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS covered FROM windows WHERE n > 1) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
base AS (
  SELECT d.doc_id, d.source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words
  FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
flagged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed
  FROM flagged WHERE source IS NOT NULL GROUP BY source
),
moments AS (SELECT avg(failed / n) AS mean, var_pop(failed / n) AS spread FROM hosts),
prior AS (
  SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 0.0
                    WHEN spread * 1e6 <= mean * (1 - mean) THEN 1e6
                    ELSE mean * (1 - mean) / spread - 1 END AS weight
  FROM moments
),
rejected AS (
  SELECT source FROM hosts, prior WHERE (failed + mean * weight) / (n + weight) >= 0.8
)
"""

QUALITY = f"""
WITH {_QUALITY_BASE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(source IN (SELECT source FROM rejected), false) AS kept
FROM flagged
"""

URL_FILTER = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
       (SELECT rule_host || rule_path FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ORDER BY length(rule_host || rule_path) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""

HARD_NEGATIVES = r"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER w)::INTEGER AS rank,
       n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""
