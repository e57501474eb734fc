"""DuckDB SQL for the operators that SQL expresses."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = r"""
WITH rules(verdict, rule) AS (
  VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')
), r AS (
  SELECT verdict, rule, regexp_extract(rule, '^[^/]*') AS rule_host, regexp_extract(rule, '/.*$') AS rule_path FROM rules
), u AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), fits AS (
  SELECT rid, rule, r.verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(rule_host) DESC) AS k
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rid)
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (
  SELECT a AS node, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node
), c AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.root, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s
), o AS (
  SELECT *, row_number() OVER by_ratio AS k,
         sum(cap) OVER by_ratio - cap AS fixed,
         sum(weight) OVER () - sum(weight) OVER by_ratio + weight AS shared,
         1.5 * sum(source_size) OVER () AS budget
  FROM w WINDOW by_ratio AS (ORDER BY cap / weight, r ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT (budget::DOUBLE - fixed) / shared AS level FROM o
  WHERE (budget::DOUBLE - fixed) / shared * weight <= cap ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM level), 0) * weight) AS target FROM w
), c AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT *, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM c
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM n
"""

OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), places AS (
  SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 4], ' ')) AS n FROM places
), repeats AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM windows WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaims
  FROM d LEFT JOIN repeats USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_exclaims > n_words THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 128 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, n_exclaims, failed
FROM f
"""

ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {ITEM_WORDS} AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, {ITEM_WORDS} AS w FROM benchmark
), i AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[p:p + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0)
), places AS (
  SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i)
), found AS (
  SELECT rid, p, x.k, item FROM (SELECT rid, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM places) x JOIN i ON x.g = i.g AND x.k = i.k
), hit AS (
  SELECT rid, count(DISTINCT q)::BIGINT AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT rid, p, k FROM found)) GROUP BY rid
), items AS (
  SELECT rid, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

SQL = {"op2_url_filters": OP2, "op7_minhash_near_dedup": OP7, "op8_exact_top_k": OP8, "op9_mixing": OP9, "op10_quality_rules": OP10, "op11_benchmark_decontamination": OP11}
