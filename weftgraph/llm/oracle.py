"""SQL over the same tables for the queries that SQL can express."""

OP6_NGRAM_JACCARD_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS root, doc_id AS id FROM documents UNION SELECT root, b FROM reach JOIN both_ways ON a = id),
 least AS (SELECT root, min(id) AS component_id FROM reach GROUP BY root)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN least ON root = doc_id"""

OP10_URL_FILTERS = r"""WITH u AS (SELECT DISTINCT coalesce(url, '') AS url FROM pages),
 h AS (SELECT url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host FROM u),
 p AS (SELECT url, host, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3 + length(host)), '^[^?#]*') ELSE '' END AS path FROM h),
 rules(rh, rp, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
 r AS (SELECT p.*, (SELECT arg_max(struct_pack(rule := rh || rp, says := says), length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM p),
 k AS (SELECT url, host, path, best.rule AS rule, best.says AS says, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 5 = 0 AS held_out FROM r),
 g AS (SELECT url, says, held_out, substr(chr(2) || chr(2) || chr(2) || chr(2) || lower(url) || chr(3), CAST(i AS BIGINT), 5) AS g FROM (SELECT *, unnest(range(1, length(url) + 2)) AS i FROM k)),
 c AS (SELECT g, count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS b FROM g WHERE says IS NOT NULL AND NOT held_out GROUP BY g),
 t AS (SELECT sum(a) AS a, sum(b) AS b FROM c),
 n0 AS (SELECT substr(g, 5, 1) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL), n1 AS (SELECT substr(g, 4, 2) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL),
 n2 AS (SELECT substr(g, 3, 3) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL), n3 AS (SELECT substr(g, 2, 4) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL),
 c1 AS (SELECT substr(g, 4, 1) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL), c2 AS (SELECT substr(g, 3, 2) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL),
 c3 AS (SELECT substr(g, 2, 3) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL), c4 AS (SELECT substr(g, 1, 4) AS x, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL),
 d AS (SELECT DISTINCT g FROM g),
 q0 AS (SELECT d.g, (coalesce(n.a, 0) + 2.0::DOUBLE / 256) / (coalesce(t.a, 0) + 2.0::DOUBLE) AS a, (coalesce(n.b, 0) + 2.0::DOUBLE / 256) / (coalesce(t.b, 0) + 2.0::DOUBLE) AS b FROM d CROSS JOIN t LEFT JOIN n0 n ON n.x = substr(g, 5, 1)),
 q1 AS (SELECT q.g, (coalesce(n.a, 0) + 2.0::DOUBLE * q.a) / (coalesce(m.a, 0) + 2.0::DOUBLE) AS a, (coalesce(n.b, 0) + 2.0::DOUBLE * q.b) / (coalesce(m.b, 0) + 2.0::DOUBLE) AS b FROM q0 q LEFT JOIN n1 n ON n.x = substr(g, 4, 2) LEFT JOIN c1 m ON m.x = substr(g, 4, 1)),
 q2 AS (SELECT q.g, (coalesce(n.a, 0) + 2.0::DOUBLE * q.a) / (coalesce(m.a, 0) + 2.0::DOUBLE) AS a, (coalesce(n.b, 0) + 2.0::DOUBLE * q.b) / (coalesce(m.b, 0) + 2.0::DOUBLE) AS b FROM q1 q LEFT JOIN n2 n ON n.x = substr(g, 3, 3) LEFT JOIN c2 m ON m.x = substr(g, 3, 2)),
 q3 AS (SELECT q.g, (coalesce(n.a, 0) + 2.0::DOUBLE * q.a) / (coalesce(m.a, 0) + 2.0::DOUBLE) AS a, (coalesce(n.b, 0) + 2.0::DOUBLE * q.b) / (coalesce(m.b, 0) + 2.0::DOUBLE) AS b FROM q2 q LEFT JOIN n3 n ON n.x = substr(g, 2, 4) LEFT JOIN c3 m ON m.x = substr(g, 2, 3)),
 q4 AS (SELECT q.g, ln((coalesce(n.a, 0) + 2.0::DOUBLE * q.a) / (coalesce(m.a, 0) + 2.0::DOUBLE)) - ln((coalesce(n.b, 0) + 2.0::DOUBLE * q.b) / (coalesce(m.b, 0) + 2.0::DOUBLE)) AS ratio FROM q3 q LEFT JOIN c n ON n.g = q.g LEFT JOIN c4 m ON m.x = substr(q.g, 1, 4)),
 sc AS (SELECT url, any_value(says) AS says, any_value(held_out) AS held_out, avg(ratio) AS score FROM g JOIN q4 USING (g) GROUP BY url),
 st AS (SELECT avg(score) FILTER (says = 'allow') AS ma, greatest(stddev_pop(score) FILTER (says = 'allow'), 1e-6) AS da, avg(score) FILTER (says = 'block') AS mb, greatest(stddev_pop(score) FILTER (says = 'block'), 1e-6) AS db FROM sc WHERE held_out),
 th AS (SELECT coalesce((ma * db + mb * da) / (da + db), 0) AS at_score FROM st)
SELECT page_id, host, path, rule, coalesce(k.says, CASE WHEN score >= at_score THEN 'allow' ELSE 'block' END) AS verdict FROM pages JOIN k ON k.url = coalesce(pages.url, '') JOIN sc ON sc.url = k.url CROSS JOIN th"""

OP11_SOURCE_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS m FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 30),
 v AS (SELECT lang, count(*) AS v, sum(m) AS m FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
 x AS (SELECT g.lang, g.source, k.term, k.m, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 s AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
 p AS (SELECT x.lang, x.source, x.term, x.n, 1 + (1000000000::HUGEINT * (x.n + 5)) // (s.total + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (x.m + 5)) // (v.m + 5 * v.v) AS q
   FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""
