"""The same results in SQL, for the queries that SQL can express at the size of the correctness check."""

USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

P1 = f"""
WITH d AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM video_face_detections WHERE {USABLE}),
r AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM creator_face_embeddings WHERE {USABLE}),
s AS (SELECT d.id AS detection_id, r.id AS face_id, list_cosine_similarity(d.e, r.e) AS c FROM d, r),
t AS (SELECT detection_id, face_id, round(c, 6) AS similarity,
      CAST(row_number() OVER (PARTITION BY detection_id ORDER BY round(c, 6) DESC, face_id) AS INTEGER) AS rank FROM s WHERE c >= 0.85)
"""

P2 = """
WITH i AS (SELECT DISTINCT video_id AS v, 't' || tag_id AS x FROM video_tags UNION SELECT DISTINCT video_id, 'c' || creator_id FROM video_creators),
n AS (SELECT x, count(*) AS n FROM i GROUP BY x),
p AS (SELECT a.x AS item_a, b.x AS item_b, count(*) AS n_both FROM i a JOIN i b ON a.v = b.v AND a.x < b.x GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT item_a, item_b, n_both, na.n AS n_a, nb.n AS n_b, (SELECT count(DISTINCT v) FROM i) AS baskets
      FROM p JOIN n na ON na.x = item_a JOIN n nb ON nb.x = item_b)
"""

P6 = """
WITH d AS (SELECT DISTINCT id, video_id, det_score, timestamp_seconds FROM video_face_detections WHERE det_score BETWEEN 0 AND 1 AND NOT isnan(det_score)),
t AS (SELECT video_id, id AS detection_id, det_score,
      CAST(row_number() OVER (PARTITION BY video_id ORDER BY det_score DESC, timestamp_seconds, id) AS INTEGER) AS rank FROM d)
"""

P3 = f"""
WITH RECURSIVE v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM video_face_detections
      WHERE lower(trim(match_status)) IN ('pending', 'no_match') AND {USABLE}),
l AS (SELECT x.id AS a, y.id AS b FROM v x, v y WHERE x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.85),
w AS (SELECT id AS a, id AS b FROM v UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
g AS (SELECT a, min(b) AS group_id, count(*) AS n FROM w GROUP BY a HAVING count(*) >= 3)
"""

SQL: dict[str, str] = {
    "p2_found": P2 + "SELECT item_a, item_b FROM t WHERE n_both * baskets >= 4 * n_a * n_b",
    "p2_pairs": P2 + "SELECT *, CAST(n_both AS DOUBLE) * baskets / (CAST(n_a AS DOUBLE) * n_b) AS lift FROM t",
    "p6_found": P6 + "SELECT video_id, detection_id FROM t WHERE rank <= 3",
    "p6_top": P6 + "SELECT video_id, detection_id, det_score, rank FROM t WHERE rank <= 3",
    "p1_found": P1 + "SELECT detection_id, face_id FROM t WHERE rank <= 3",
    "p1_neighbours": P1 + "SELECT detection_id, face_id, similarity, rank FROM t WHERE rank <= 3",
    "p3_found": P3 + "SELECT group_id, a AS detection_id FROM g",
    "p3_groups": P3
    + """, u AS (SELECT g.group_id, g.n AS size, g.a AS id, list_transform(v.e, lambda x: x / sqrt(list_sum(list_transform(v.e, lambda y: y * y)))) AS e FROM g JOIN v ON v.id = g.a),
x AS (SELECT group_id, generate_subscripts(e, 1) AS j, unnest(e) AS y FROM u),
m AS (SELECT group_id, j, sum(y) AS y FROM x GROUP BY ALL), c AS (SELECT group_id, list(y ORDER BY j) AS c FROM m GROUP BY 1),
s AS (SELECT u.group_id, u.size, u.id AS detection_id, round(list_cosine_similarity(u.e, c.c), 6) AS similarity FROM u JOIN c USING (group_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC, detection_id) AS INTEGER) AS rank FROM s)
SELECT group_id, size, rank, detection_id, similarity FROM r WHERE rank <= 3""",
}
