"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from brindle.llm.quality import Rules

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

PLACE = """floor(1e9::DOUBLE * CASE class
         WHEN 0 THEN 2 * $y / (1.5::DOUBLE + sqrt(greatest(0, 2.25::DOUBLE - 2 * $y)))
         WHEN 1 THEN 2 * $y / (1 + sqrt(1::DOUBLE))
         ELSE CASE WHEN $y >= 0.375 THEN 0.5 + 2 * ($y - 0.375::DOUBLE) / (1 + sqrt(greatest(0, 1 + 2 * ($y - 0.375::DOUBLE)))) ELSE 2 * $y / (0.5::DOUBLE + sqrt(greatest(0, 0.25::DOUBLE + 2 * $y))) END
       END) / 1e9::DOUBLE"""

ORACLE_SQL["op3_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM docs GROUP BY source
), weighed AS (
  SELECT source, source_size, n % 3 AS class, [5, 2, 1][n % 3 + 1] AS weight, 2 * source_size AS most, 2.0::DOUBLE * source_size / [5, 2, 1][n % 3 + 1] AS fills FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighed WINDOW b AS (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, class, least(most::DOUBLE, (SELECT level FROM levels WHERE level < fills ORDER BY fills LIMIT 1) * weight) AS target FROM levels
), laid AS (
  SELECT doc_id, size, source_size, class, target, floor(target + 0.5)::BIGINT AS lim,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source
), taken AS (
  SELECT *, greatest(0, least(size, lim - start)) AS t0, greatest(0, least(size, lim - start - source_size)) AS t1, start::DOUBLE / nullif(target, 0) AS y0, (start + source_size)::DOUBLE / nullif(target, 0) AS y1 FROM laid
)
SELECT doc_id, size, source_size, target, (t0 + t1)::BIGINT AS taken, CASE WHEN t0 > 0 THEN """ + PLACE.replace("$y", "y0") + """ END AS position, CASE WHEN t1 > 0 THEN """ + PLACE.replace("$y", "y1") + """ END AS second_position
FROM taken
"""

ORACLE_SQL["op10_line_dedup"] = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>', ' ', 'g'),
      '(?i)</?(p|div|li|ul|ol|h[1-6]|nav|header|footer|article|aside|section|main|table|tr|td|th|br|form|body|html|head)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS lines
  FROM pages
), hosts AS (
  SELECT host, count(*) AS n FROM p GROUP BY host
), common AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) JOIN hosts USING (host)
  GROUP BY host, line, n HAVING (count(*) - 1) * 100 > n * 30
), sets AS (
  SELECT host, list(line) AS dropped FROM common GROUP BY host
), kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda s: NOT list_contains(coalesce(dropped, []), s)) AS stay FROM p LEFT JOIN sets USING (host)
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped, coalesce(array_to_string(stay, chr(10)), '') AS text FROM kept
"""


def _quality(rules: Rules) -> str:
    n, grams = rules.repeat_words_n, rules.max_dup_ngram_share
    chars = ", ".join(f"coalesce(max(chars) FILTER (n = {k} AND later), 0)::BIGINT AS dup_{k}gram_chars" for k in grams)
    too_many = " OR ".join(f"dup_{k}gram_chars > {most}::DOUBLE * word_chars" for k, most in grams.items())
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), words AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), word AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM words
), line AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d
), bare AS (SELECT r, line, i, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM line
), again AS (SELECT r, count(*) AS n_dup_lines, sum(chars) AS dup_line_chars FROM (FROM bare WHERE chars > 0 QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY i) > 1) GROUP BY r
), gram AS (SELECT r, n, i, array_to_string(words[i + 1:i + n], ' ') AS gram FROM (SELECT r, words, n, unnest(range(len(words) - n + 1)) AS i FROM words, (SELECT unnest([{n}, {", ".join(map(str, grams))}]) AS n))
), found AS (SELECT r, n, i, later FROM (SELECT r, n, i, unnest([FALSE, TRUE]) AS later, count(*) OVER (PARTITION BY r, n, gram) AS times, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS nth FROM gram) WHERE CASE WHEN later THEN nth > 1 ELSE times > 1 END
), cover AS (SELECT DISTINCT r, n, later, unnest(range(i, i + n)) AS i FROM found
), covered AS (SELECT r, n, later, count(*) AS words, sum(length(w)) AS chars FROM cover JOIN word USING (r, i) GROUP BY r, n, later
), per AS (SELECT r, coalesce(max(words) FILTER (n = {n} AND NOT later), 0)::BIGINT AS n_repeat_words, {chars} FROM covered GROUP BY r
), base AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM word GROUP BY r
), f AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(dup_{k}gram_chars, 0)::BIGINT AS dup_{k}gram_chars" for k in grams)}
  FROM d LEFT JOIN base USING (r) LEFT JOIN again USING (r) LEFT JOIN per USING (r)
), j AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words_pct} * n_words AS base_failed FROM f)
SELECT *, NOT (base_failed OR dup_line_chars > {rules.max_dup_line_share}::DOUBLE * word_chars OR {too_many}) AS kept FROM j
"""


ORACLE_SQL["op1_quality_rules"] = _quality(Rules())
