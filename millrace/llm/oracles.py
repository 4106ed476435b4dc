"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op8_decontaminate": r"""
WITH dw AS (
  SELECT d.doc_id, w.i AS pos, w.word FROM documents d,
  LATERAL (SELECT unnest(regexp_extract_all(translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word,
                  generate_subscripts(regexp_extract_all(translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1) AS i) w
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_aggregate(words[s : s + least(8, len(words)) - 1], 'string_agg', ' ') AS window_text, least(8, len(words)) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 7) + 1)) AS s FROM iw WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram FROM dw, sizes WHERE n = 8
  UNION ALL
  SELECT a.doc_id, a.pos, n, (SELECT string_agg(b.word, ' ' ORDER BY b.pos) FROM dw b WHERE b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + n - 1) FROM dw a, sizes WHERE n < 8
), hit AS (
  SELECT g.doc_id, g.pos, g.n, w.item_id FROM grams g JOIN win w ON w.n = g.n AND w.window_text = g.gram
), marks AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM (SELECT DISTINCT doc_id, pos, n FROM hit), LATERAL (SELECT unnest(range(0, n)) AS o)
), ids AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(w.n, 0) AS n_words, coalesce(m.n, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM dw GROUP BY doc_id) w USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM marks GROUP BY doc_id) m USING (doc_id)
LEFT JOIN ids i USING (doc_id)
""",
    "op9_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS key, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), base AS (
  SELECT page_id, key, coalesce(translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM base
), keys AS (
  SELECT DISTINCT key, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0 WHEN rule IS NULL THEN NULL ELSE 0.0 END AS acc FROM ruled
), known AS (SELECT key, acc, substr(md5(key), 1, 1) IN ('0', '1', '2', '3') AS aside FROM keys WHERE acc IS NOT NULL
), pos AS (SELECT key, unnest(range(1, length(key) + 1)) AS ix FROM (SELECT DISTINCT key FROM keys)
), grams AS (SELECT key, substr(key, ix, s) AS gram, s FROM (SELECT key, ix, unnest(range(1, 5)) AS s FROM pos) WHERE ix + s - 1 <= length(key)
), cnt AS (
  SELECT gram, s, sum(acc)::DOUBLE AS a, sum(1 - acc)::DOUBLE AS r FROM grams JOIN (SELECT key, acc FROM known WHERE NOT aside) USING (key) GROUP BY gram, s
), tot AS (SELECT sum(a) AS a, sum(r) AS r FROM cnt WHERE s = 1
), ctx AS (SELECT substr(gram, 1, s - 1) AS c, s, sum(a) AS na, sum(r) AS nr FROM cnt WHERE s > 1 GROUP BY 1, 2
), p1 AS (SELECT gram, (cnt.a + 1) / (tot.a + 256) AS pa, (cnt.r + 1) / (tot.r + 256) AS pr FROM cnt, tot WHERE s = 1
), p2 AS (SELECT cnt.gram, (a + 4 * l.pa) / (na + 4) AS pa, (r + 4 * l.pr) / (nr + 4) AS pr, l.pa AS la, l.pr AS lr FROM cnt JOIN ctx ON ctx.s = 2 AND c = substr(cnt.gram, 1, 1) JOIN p1 l ON l.gram = substr(cnt.gram, 2) WHERE cnt.s = 2
), p3 AS (SELECT cnt.gram, (a + 4 * l.pa) / (na + 4) AS pa, (r + 4 * l.pr) / (nr + 4) AS pr, l.pa AS la, l.pr AS lr FROM cnt JOIN ctx ON ctx.s = 3 AND c = substr(cnt.gram, 1, 2) JOIN p2 l ON l.gram = substr(cnt.gram, 2) WHERE cnt.s = 3
), p4 AS (SELECT cnt.gram, (a + 4 * l.pa) / (na + 4) AS pa, (r + 4 * l.pr) / (nr + 4) AS pr, l.pa AS la, l.pr AS lr FROM cnt JOIN ctx ON ctx.s = 4 AND c = substr(cnt.gram, 1, 3) JOIN p3 l ON l.gram = substr(cnt.gram, 2) WHERE cnt.s = 4
), model AS (
  SELECT gram, ln(pa / pr) AS delta FROM p1 UNION ALL SELECT gram, ln(pa / pr) - ln(la / lr) FROM p2 UNION ALL SELECT gram, ln(pa / pr) - ln(la / lr) FROM p3 UNION ALL SELECT gram, ln(pa / pr) - ln(la / lr) FROM p4
), scores AS (SELECT key, sum(delta) / length(key) AS score FROM grams JOIN model USING (gram) GROUP BY key
), sp AS (SELECT acc, avg(score) AS mean, stddev_pop(score) AS sd FROM known JOIN scores USING (key) WHERE aside GROUP BY acc
), bound AS (SELECT (x.mean * y.sd + y.mean * x.sd) / (x.sd + y.sd) AS b FROM sp x, sp y WHERE x.acc = 1 AND y.acc = 0)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN coalesce(score, 0) >= (SELECT b FROM bound) THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN scores USING (key)
""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), f AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM l WHERE trim(line, ' ') <> ''
), w AS (SELECT a.doc_id, a.p, a.line AS l1, b.line AS l2 FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.p = a.p + 1
), r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, p) AS n FROM w
), s AS (SELECT doc_id, p, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS n FROM f WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50
), d AS (SELECT DISTINCT doc_id, q AS p FROM (SELECT doc_id, unnest([p, p + 1]) AS q FROM r WHERE n > 1 UNION ALL SELECT doc_id, p FROM s WHERE n > 1)
), runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR prev <> p - 1) AS n_runs
            FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM d) GROUP BY doc_id
), gone AS (SELECT f.doc_id, f.i FROM f JOIN d USING (doc_id, p)
), kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS body FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id
)
SELECT t.doc_id, coalesce(c.n, 0)::INTEGER AS n_lines, coalesce(r.n_removed, 0)::INTEGER AS n_removed, coalesce(r.n_runs, 0)::INTEGER AS n_runs,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents t LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) c USING (doc_id)
LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
    "op10_shard": r"""
WITH RECURSIVE tab AS (
  SELECT i::UBIGINT AS i, i::UBIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, k + 1 FROM tab WHERE k < 8
), lut AS (SELECT list(v ORDER BY i) AS l FROM tab WHERE k = 8
), base AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 8 AS size,
         xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT)),
                         lambda a, b: xor(a // 256, l[(xor(a, b) % 256 + 1)::INT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, lut
), rows_ AS (SELECT *, row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, 'null') AS k FROM base
), leaves AS (SELECT i AS shard, i // 12 AS region, i // 4 AS rack FROM range(25) r(i)
), trees AS (SELECT n, shard, region, rack FROM leaves, (VALUES (24), (25)) t(n) WHERE shard < n
), drawn AS (  -- every node's draw divided by the weight below it; the hash does not depend on the tree
  SELECT rid, n, node, path, -ln((('0x' || substr(md5(k || '/' || path), 1, 13))::BIGINT::DOUBLE + 0.5) * pow(2.0::DOUBLE, -52)) / weight AS t, parent
  FROM rows_, (
    SELECT n, region AS node, '' AS parent, region::VARCHAR AS path, count(*)::DOUBLE AS weight FROM trees GROUP BY n, region
    UNION ALL SELECT n, rack, region::VARCHAR, region || '/' || rack, count(*)::DOUBLE FROM trees GROUP BY n, region, rack
    UNION ALL SELECT n, shard, region || '/' || rack, region || '/' || rack || '/' || shard, 1.0 FROM trees
  ) nodes
), won AS (SELECT rid, n, parent, node, path FROM drawn QUALIFY row_number() OVER (PARTITION BY rid, n, parent ORDER BY t, node) = 1
), places AS (
  SELECT a.rid, a.n, c.node AS shard FROM won a JOIN won b ON b.rid = a.rid AND b.n = a.n AND b.parent = a.path JOIN won c ON c.rid = b.rid AND c.n = b.n AND c.parent = b.path
  WHERE a.parent = ''
), spots AS (
  SELECT r.*, p.shard::INTEGER AS shard, g.shard::INTEGER AS grown_shard,
         ('0x' || substr(md5(k || '/' || text_crc32 || '/' || size), 1, 13))::BIGINT AS bits
  FROM rows_ r JOIN places p ON p.rid = r.rid AND p.n = 24 JOIN places g ON g.rid = r.rid AND g.n = 25
), n AS (SELECT greatest(16, ceil(max(c) / 50000.0)::BIGINT) AS chunks FROM (SELECT count(*) AS c FROM spots GROUP BY shard)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bits % chunks, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM spots, n
""",
    "op1_repeated_strings": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), w AS (
  SELECT doc_id, p, md5_number(substr(hx, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 99)) AS p FROM b WHERE length(hx) >= 200)
), later AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1
), spans AS (  -- windows that overlap or touch make one run
  SELECT doc_id, min(p) AS a, max(p) + 100 AS e
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later))
  GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM spans GROUP BY doc_id
), kept AS (
  SELECT b.doc_id, length(hx)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         CASE WHEN starts IS NULL THEN hx ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i:
           substr(hx, 2 * (CASE WHEN i = 0 THEN 0 ELSE ends[i] END) + 1, 2 * ((CASE WHEN i = len(starts) THEN length(hx) // 2 ELSE starts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE ends[i] END)))), '') END AS rest
  FROM b LEFT JOIN cuts USING (doc_id)
)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
""",
    "op2_near_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
""",
    "op6_near_copies": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0)) GROUP BY ALL
), n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
""",
}
