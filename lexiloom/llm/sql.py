"""SQL that gives the same rows as a pN_ query, where SQL can say it."""

from __future__ import annotations

_TOPIC = r"list_filter(list_transform(topics, lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x IS NOT NULL AND x <> '')[1]"

_POOL = f"""pool AS (SELECT new_id, min(topic) AS topic FROM (SELECT new_id, {_TOPIC} AS topic FROM reuters21578) WHERE new_id IS NOT NULL AND topic IS NOT NULL GROUP BY new_id),
counts AS (SELECT topic, count(*) AS n FROM pool GROUP BY topic), size AS (SELECT count(*) AS n FROM pool)"""

P1 = f"WITH {_POOL} SELECT t.topic FROM topic_targets t LEFT JOIN counts c ON c.topic = t.topic, size s WHERE greatest(t.target_share * (t.sample_share * s.n), t.min_rows) > coalesce(c.n, 0) * (1 + 1e-9)"

_SIZES = """r AS (SELECT 'summaries' AS tab, sum_id AS id, max(coalesce(length(document), 0) + coalesce(length(summary), 0)) AS size, min(nullif(lower(trim(source)), '')) AS source FROM summaries WHERE sum_id IS NOT NULL GROUP BY sum_id
UNION ALL SELECT 'wikitext', line_id, max(coalesce(length(text), 0)), min(nullif(lower(trim(source)), '')) FROM wikitext WHERE line_id IS NOT NULL GROUP BY line_id),
s AS (SELECT tab, source, sum(size) AS size FROM r GROUP BY tab, source), x AS (SELECT m.*, coalesce(s.size, 0) AS size FROM mix_targets m LEFT JOIN s ON s.tab = m.tab AND s.source = lower(trim(m.source))),
g AS (SELECT *, budget_share * sum(size) OVER w * weight / sum(weight) OVER w AS target FROM x WINDOW w AS (PARTITION BY mix_name))"""

P3 = f"WITH {_SIZES} SELECT mix_name, lower(trim(source)) AS source FROM g WHERE max_repeats * size < target * (1 - 1e-12)"

# Word bags as sets of (word, repeat); two bags of at least 3/4 likeness share one of their rarest n - ceil(3n/4) + 1 members.
_BAGS = r"""w AS (SELECT tab, id, role, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM d), k AS (SELECT tab, id, role, w, row_number() OVER (PARTITION BY tab, id, w) AS j FROM w),
n AS (SELECT tab, id, count(*) AS n FROM k GROUP BY tab, id HAVING count(*) >= 30), f AS (SELECT k.*, n.n, count(*) OVER (PARTITION BY k.tab, k.w, k.j) AS df FROM k JOIN n USING (tab, id)),
g AS (SELECT tab, id, role, w, j FROM (SELECT *, row_number() OVER (PARTITION BY tab, id ORDER BY df, w, j) AS place FROM f) WHERE place <= n - ceil(0.75 * n) + 1),
c AS (SELECT DISTINCT a.tab, a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.tab = b.tab AND a.w = b.w AND a.j = b.j AND a.id < b.id{0}),
s AS (SELECT c.tab, id_a, id_b, a.n AS na, b.n AS nb, count(*) AS s FROM c JOIN f a ON a.tab = c.tab AND a.id = c.id_a JOIN f b ON b.tab = c.tab AND b.id = c.id_b AND b.w = a.w AND b.j = a.j GROUP BY ALL),
p AS (SELECT tab, id_a, id_b FROM s WHERE 4 * s >= 3 * (na + nb - s))"""

P2 = f"""WITH d AS (SELECT 'reddit_finance' AS tab, id, any_value(body) AS t, 0 AS role FROM reddit_finance WHERE body IS NOT NULL GROUP BY id UNION ALL SELECT 'reuters21578', new_id, any_value(text), 0 FROM reuters21578 WHERE text IS NOT NULL GROUP BY new_id UNION ALL SELECT 'news_finance', news_id, any_value(description), 0 FROM news_finance WHERE description IS NOT NULL GROUP BY news_id),
{_BAGS.replace('{0}', '')}"""

P2C = P2 + """, b AS (SELECT tab, id, md5(string_agg(w || ' ' || j, ',' ORDER BY w, j)) AS bag FROM f GROUP BY tab, id), e AS (SELECT tab, id_a AS x, id_b AS y FROM p UNION ALL SELECT tab, id_b, id_a FROM p),
l AS (SELECT e.tab, x, count(*) AS links FROM e JOIN b bx ON bx.tab = e.tab AND bx.id = x JOIN b bz ON bz.tab = e.tab AND bz.id = y WHERE bx.bag <> bz.bag GROUP BY e.tab, x)
SELECT b.tab, b.id, min(b.id) OVER w AS class_id, count(*) OVER w AS copies, coalesce(l.links, 0) AS links FROM b LEFT JOIN l ON l.tab = b.tab AND l.x = b.id WINDOW w AS (PARTITION BY b.tab, b.bag)"""

P2 += " SELECT tab, id_a, id_b FROM p"

P6 = f"""WITH r AS (SELECT 'reuters21578' AS tab, new_id AS id, any_value(text) AS t, any_value(lower(trim(split))) AS split FROM reuters21578 WHERE text IS NOT NULL GROUP BY new_id
UNION ALL SELECT 'summaries', sum_id, any_value(document), any_value(lower(trim(split))) FROM summaries WHERE document IS NOT NULL GROUP BY sum_id
UNION ALL SELECT 'wikitext', line_id, any_value(text), any_value(lower(trim(split))) FROM wikitext WHERE text IS NOT NULL GROUP BY line_id),
d AS (SELECT tab, id, t, CASE WHEN split = 'train' THEN 1 ELSE 2 END AS role FROM r WHERE split IN ('train', 'test', 'validation')),
{_BAGS.replace('{0}', ' AND a.role <> b.role')}"""

P6R = P6 + """, e AS (SELECT tab, id_a AS id FROM p UNION SELECT tab, id_b FROM p),
v AS (SELECT DISTINCT * FROM (SELECT 'reuters21578' AS tab, new_id AS id, lower(trim(split)) AS split, NULL::VARCHAR AS source FROM reuters21578 UNION ALL SELECT 'summaries', sum_id, lower(trim(split)), nullif(lower(trim(source)), '') FROM summaries
UNION ALL SELECT 'wikitext', line_id, lower(trim(split)), nullif(lower(trim(source)), '') FROM wikitext) WHERE id IS NOT NULL AND split IN ('test', 'validation'))
SELECT v.tab, split, source, count(DISTINCT v.id) AS records, count(DISTINCT e.id) AS overlapping FROM v LEFT JOIN e ON e.tab = v.tab AND e.id = v.id GROUP BY ALL"""

P6 += " SELECT tab, id_a, id_b FROM p"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p2_classes": P2C, "p3_found": P3, "p6_found": P6, "p6_report": P6R}
