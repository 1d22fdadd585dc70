"""SQL twins of the training-text queries."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text expression: each byte is mixed in and followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]))"
    # 3988292384 is the polynomial.
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295::BIGINT)"


OP12 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP13 = f"""
WITH own AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT conv_id, turns, ({crc32("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), members AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT depth, turns[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends
  FROM members GROUP BY ALL
), children AS (
  SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.prefix[n.depth][2]) END AS saving
  FROM nodes n LEFT JOIN children c USING (depth, prefix)
), above AS (
  SELECT unnest(range(0, depth + 1)) AS depth, prefix AS whole, n_children, saving FROM full_nodes
), totals AS (
  SELECT depth, whole[1:depth] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved FROM above GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves,
  t.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN totals t USING (depth, prefix)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Components by closure: every node reaches itself and whatever its links reach.
_COMPONENTS = """edges(a, b) AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a),
smallest AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""

OP1 = f"""
WITH RECURSIVE able AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links(a, b) AS (
  SELECT x.vec_id, y.vec_id FROM able x JOIN able y
    ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), {_COMPONENTS},
degrees AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(component, vec_id)) AS kept
FROM embeddings LEFT JOIN degrees d ON d.id = vec_id LEFT JOIN smallest s ON s.id = vec_id
"""

OP2 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, place, array_to_string(w[place + 1:place + 50], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS place FROM texts WHERE len(w) >= 50)
), firsts AS (
  SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS k FROM windows JOIN firsts USING (words) WHERE first_id < doc_id
), kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.k) AS kept_text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM texts) t ANTI JOIN gone USING (doc_id, k)
  GROUP BY t.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256, coalesce(kept_text, '') AS kept_text
FROM texts LEFT JOIN kept USING (doc_id)
"""

OP4 = rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^ \t-\r]')) AS lines
  FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM texts
), trios AS (
  SELECT doc_id, place, word, lead(word) OVER following AS second, lead(word, 2) OVER following AS third
  FROM words WINDOW following AS (PARTITION BY doc_id ORDER BY place)
), windows AS (
  SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, word, second, third) AS times FROM trios WHERE third IS NOT NULL
), repeats AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(place, place + 3)) AS k FROM windows WHERE times > 1) GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts t LEFT JOIN repeats USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), measured AS (
  SELECT doc_id, lang, source, base_failed, measure, v,
    (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS bucket
  FROM (
    SELECT *, unnest(['word_length', 'symbols', 'dup_lines', 'repeat_words']) AS measure,
      unnest([1000 * word_chars // greatest(n_words, 1), 1000 * n_symbols // greatest(n_words, 1),
        1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1)]) AS v
    FROM failed)
), passing AS (
  SELECT 'group' AS kind, lang, source, measure, bucket FROM measured WHERE NOT base_failed
  UNION ALL SELECT 'lang', lang, NULL, measure, bucket FROM measured WHERE NOT base_failed
  UNION ALL SELECT 'all', NULL, NULL, measure, bucket FROM measured WHERE NOT base_failed
), sketch AS (
  SELECT kind, lang, source, measure, bucket, count(*) AS n FROM passing GROUP BY kind, lang, source, measure, bucket
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY kind, lang, source, measure ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY kind, lang, source, measure) AS rows_in
  FROM sketch
), ends AS (
  SELECT kind, lang, source, measure, max(rows_in)::BIGINT AS n,
    2.0::DOUBLE * min(bucket) FILTER (100 * upto >= 90 * rows_in) AS most,
    0.5::DOUBLE * min(bucket) FILTER (100 * upto >= 10 * rows_in) AS least,
    min(bucket) FILTER (100 * upto >= 99 * rows_in) AS tail
  FROM summed GROUP BY kind, lang, source, measure
), verdicts AS (
  SELECT m.doc_id,
    bool_and(m.v <= (g.n * g.most + 100 * ((l.n * l.most + 100 * a.most) / (l.n + 100))) / (g.n + 100)
        + CASE WHEN m.measure = 'word_length' THEN 0 ELSE a.tail END
      AND (m.measure <> 'word_length'
        OR m.v >= (g.n * g.least + 100 * ((l.n * l.least + 100 * a.least) / (l.n + 100))) / (g.n + 100))) AS fine
  FROM measured m
  JOIN ends g ON g.kind = 'group' AND g.measure = m.measure AND g.lang IS NOT DISTINCT FROM m.lang AND g.source IS NOT DISTINCT FROM m.source
  JOIN ends l ON l.kind = 'lang' AND l.measure = m.measure AND l.lang IS NOT DISTINCT FROM m.lang
  JOIN ends a ON a.kind = 'all' AND a.measure = m.measure
  WHERE NOT m.base_failed GROUP BY m.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, true) AS kept
FROM failed LEFT JOIN verdicts USING (doc_id)
"""

OP7 = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fits AS (
  SELECT page_id, max_by(concat(rule_host, rule_path), strlen(concat(rule_host, rule_path))) AS rule,
    max_by(rule_verdict, strlen(concat(rule_host, rule_path))) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, concat('.', rule_host))) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

OP9 = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[place + 1:place + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS place FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links(a, b) AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)
), {_COMPONENTS}
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(component, t.doc_id)) AS component_id,
  t.doc_id = least(t.doc_id, coalesce(component, t.doc_id)) AS kept
FROM texts t LEFT JOIN sizes z ON z.doc_id = t.doc_id LEFT JOIN smallest s ON s.id = t.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": OP1,
    "op2_substring_dedup": OP2,
    "op4_quality_rules": OP4,
    "op7_url_filter": OP7,
    "op9_minhash_near_dedup": OP9,
    "op12_exact_top_k": OP12,
    "op13_conversation_trie": OP13,
}
