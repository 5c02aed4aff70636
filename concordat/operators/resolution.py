"""Entity resolution and its evaluation: blocking, comparison under a veto, clusters, fusion, substitutes, review."""

#: Groups are equal texts, clusters are texts that are equal without their spaces.
TRUTH = "p AS (SELECT doc_id, sha256_hex(norm) AS grp, sha256_hex(replace(norm, ' ', '')) AS cl FROM texts)"

SQL = {
    "exact_text_duplicates": "SELECT norm_hash, COUNT(*) AS copies, MIN(doc_id) AS first_doc FROM (SELECT doc_id, sha256_hex(norm) AS norm_hash FROM texts) GROUP BY norm_hash HAVING COUNT(*) > 1",
    "blocking_stats": """WITH k AS (SELECT 'exact' AS pass, COUNT(*) AS n, 300 AS cap FROM items GROUP BY class, brand, name UNION ALL SELECT 'class_band', COUNT(*), 150 FROM items GROUP BY class, size_mm
        UNION ALL SELECT 'identity', COUNT(*), 200 FROM items GROUP BY class, brand, size_mm UNION ALL SELECT 'token', COUNT(*), 100 FROM items GROUP BY class, name)
        SELECT pass, COUNT(*) AS buckets, count_if(n > cap) AS oversized_buckets, MAX(n) AS largest_bucket, CAST(SUM(CASE WHEN n BETWEEN 2 AND cap THEN n * (n - 1) / 2 ELSE 0 END) AS BIGINT) AS pairs FROM k GROUP BY pass""",
    "blocking_pass_gain": """WITH c AS (SELECT a.item AS x, b.item AS y, 1 AS pass FROM items a JOIN items b ON a.class = b.class AND a.brand = b.brand AND a.name = b.name AND a.item < b.item
        UNION ALL SELECT a.item, b.item, 2 FROM items a JOIN items b ON a.class = b.class AND a.size_mm = b.size_mm AND a.item < b.item
        UNION ALL SELECT a.item, b.item, 3 FROM items a JOIN items b ON a.class = b.class AND a.brand = b.brand AND a.size_mm = b.size_mm AND a.item < b.item)
        SELECT CAST(pass AS BIGINT) AS pass, COUNT(*) AS gained FROM (SELECT x, y, MIN(pass) AS pass FROM c GROUP BY x, y) GROUP BY pass""",
    "compare_attributes": "SELECT item_a, item_b, attr, role, outcome FROM compared",
    "veto_pairs": "SELECT item_a, item_b, compared, matched, vetoes, CAST(matched AS DOUBLE) / compared AS agreement, CASE WHEN vetoes > 0 THEN 'veto' WHEN in_band > 0 THEN 'tolerance_match' ELSE 'match' END AS verdict FROM verdicts",
    "veto_attribute_counts": "SELECT attr, COUNT(*) AS pairs FROM compared WHERE (role = 'identity' AND outcome = 'mismatch') OR (role = 'performance' AND outcome = 'out_of_band') GROUP BY attr",
    "substitution_direction": """SELECT p.item_a, p.item_b, CASE WHEN p.size_b >= p.size_a AND p.price_b >= p.price_a THEN 'a_to_b' WHEN p.size_a >= p.size_b AND p.price_a >= p.price_b THEN 'b_to_a' END AS direction
        FROM pairs p JOIN verdicts v ON p.item_a = v.item_a AND p.item_b = v.item_b WHERE v.vetoes > 0 AND v.identity_vetoes = 0""",
    "score_pairs": """WITH s AS (SELECT p.item_a, p.item_b, v.vetoes, v.identity_vetoes, p.brand_a <> p.brand_b AS other_maker, p.price_a = p.price_b AS anchor,
        0.34 * (CASE WHEN p.text_a = p.text_b THEN 1.0 ELSE 0.7 END) + 0.24 * 0.5 + 0.42 * CAST(v.matched AS DOUBLE) / v.compared AS s FROM pairs p JOIN verdicts v ON p.item_a = v.item_a AND p.item_b = v.item_b),
        t AS (SELECT *, CASE WHEN anchor THEN least(1.0, 0.74 + 0.26 * s) ELSE s END AS conf FROM s)
        SELECT item_a, item_b, CASE WHEN vetoes > 0 AND anchor THEN 'conflict' WHEN vetoes > 0 OR other_maker THEN 'distinct' WHEN conf >= 0.86 THEN 'duplicate' WHEN conf >= 0.45 THEN 'review' ELSE 'distinct' END AS verdict,
        CASE WHEN vetoes > 0 AND anchor THEN 'grey' WHEN vetoes > 0 OR other_maker THEN 'low' WHEN conf >= 0.86 THEN 'high' WHEN conf >= 0.45 THEN 'grey' ELSE 'low' END AS band FROM t""",
    "pairwise_prf": f"""WITH {TRUTH}, cg AS (SELECT cl, grp, COUNT(*) AS n FROM p GROUP BY cl, grp), c AS (SELECT cl, COUNT(*) AS n FROM p GROUP BY cl), g AS (SELECT grp, COUNT(*) AS n FROM p GROUP BY grp),
        t AS (SELECT CAST((SELECT SUM(n * (n - 1) / 2) FROM cg) AS DOUBLE) AS tp, CAST((SELECT SUM(n * (n - 1) / 2) FROM c) AS DOUBLE) AS pred, CAST((SELECT SUM(n * (n - 1) / 2) FROM g) AS DOUBLE) AS truth)
        SELECT tp, pred - tp AS fp, truth - tp AS fn, tp / nullif(pred, 0) AS prec, tp / nullif(truth, 0) AS recall FROM t""",
    "bcubed_prf": f"""WITH {TRUTH}, w AS (SELECT doc_id, COUNT(*) OVER (PARTITION BY cl, grp) AS b, COUNT(*) OVER (PARTITION BY cl) AS c, COUNT(*) OVER (PARTITION BY grp) AS g FROM p)
        SELECT CAST(SUM(CAST(CAST(b AS DOUBLE) / c AS DECIMAL(18,10))) AS DOUBLE) / COUNT(*) AS prec, CAST(SUM(CAST(CAST(b AS DOUBLE) / g AS DECIMAL(18,10))) AS DOUBLE) / COUNT(*) AS recall FROM w""",
    "blocking_recall": """WITH t AS (SELECT item_a, item_b, item_a % 5 < 3 AS tuning FROM pairs WHERE brand_a = brand_b), c AS (SELECT a.item AS x, b.item AS y FROM items a JOIN items b ON a.class = b.class AND a.size_mm = b.size_mm AND a.item < b.item)
        SELECT tuning, COUNT(*) AS true_pairs, COUNT(c.x) AS found, CAST(COUNT(c.x) AS DOUBLE) / COUNT(*) AS recall FROM t LEFT JOIN c ON t.item_a = c.x AND t.item_b = c.y GROUP BY tuning""",
    "trap_accuracy": """SELECT CASE WHEN v.identity_vetoes > 0 THEN 'identity_critical' ELSE 'performance_out_of_band' END AS kind, COUNT(*) AS traps, count_if(v.vetoes > 0) AS refused FROM verdicts v JOIN pairs p ON v.item_a = p.item_a AND v.item_b = p.item_b
        WHERE p.brand_a <> p.brand_b OR abs(p.size_a - p.size_b) > 2 GROUP BY 1""",
    "threshold_sweep": """WITH s AS (SELECT l.quality, CAST(floor(least(d.n_chars, 9999) / 357.0) AS BIGINT) AS cut FROM labels l JOIN documents d ON l.doc_id = d.doc_id), h AS (SELECT cut, count_if(quality = 1) AS pos, COUNT(*) AS n FROM s GROUP BY cut),
        r AS (SELECT cut, SUM(pos) OVER (ORDER BY cut DESC) AS tp, SUM(n) OVER (ORDER BY cut DESC) AS called, SUM(pos) OVER () AS allpos FROM h)
        SELECT cut, CAST(tp AS DOUBLE) / CAST(called AS DOUBLE) AS prec, CAST(tp AS DOUBLE) / CAST(allpos AS DOUBLE) AS recall, 2 * CAST(tp AS DOUBLE) / (CAST(called AS DOUBLE) + CAST(allpos AS DOUBLE)) AS f1 FROM r""",
    "auc_rank": """WITH s AS (SELECT d.n_chars AS x, CAST(SUM(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(SUM(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.n_chars),
        r AS (SELECT p, n, coalesce(SUM(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below FROM s), t AS (SELECT SUM(p) AS p, SUM(n) AS n, SUM(p * (below + n / 2)) AS good FROM r) SELECT p, n, good / (p * n) AS auc FROM t""",
    "fuse_attributes": """WITH v AS (SELECT c.cluster, i.size_mm AS v, COUNT(*) AS n, MAX(i.item) AS latest FROM clusters c JOIN items i ON c.item = i.item GROUP BY c.cluster, i.size_mm),
        k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, latest DESC) AS place, COUNT(*) OVER (PARTITION BY cluster) AS kinds, SUM(n) OVER (PARTITION BY cluster) AS members FROM v)
        SELECT cluster, CAST(v AS BIGINT) AS size_mm, CASE WHEN members = 1 THEN 'sole_value' WHEN kinds = 1 THEN 'unanimous' WHEN 2 * n > members THEN 'majority_vote' ELSE 'most_recent_purchase' END AS rule FROM k WHERE place = 1""",
    "modal_label": "SELECT class, brand, n FROM (SELECT class, brand, COUNT(*) AS n, row_number() OVER (PARTITION BY class ORDER BY COUNT(*) DESC, brand) AS k FROM items GROUP BY class, brand) WHERE k = 1",
    "render_golden": "SELECT cluster, MIN(name) || ', ' || MIN(class) || ', ' || MIN(brand) || CASE WHEN COUNT(*) > 1 THEN ', ' || CAST(COUNT(*) AS VARCHAR(10)) || ' RECORDS' ELSE '' END AS label FROM clusters GROUP BY cluster",
    "rule_substitutes": """SELECT item_a, item_b, CASE WHEN f AND b THEN 'equivalent' ELSE 'supersedes' END AS rel, CASE WHEN f AND b THEN 'both' WHEN f THEN 'a_to_b' ELSE 'b_to_a' END AS direction
        FROM (SELECT item_a, item_b, size_b >= size_a AND price_b >= price_a - 0.000001 AS f, size_a >= size_b AND price_a >= price_b - 0.000001 AS b FROM pairs WHERE brand_a = brand_b AND abs(size_a - size_b) <= 10) WHERE f OR b""",
    "relations_by_side": """WITH e AS (SELECT item_a AS item, item_b AS other FROM pairs WHERE brand_a <> brand_b UNION ALL SELECT item_b, item_a FROM pairs WHERE brand_a <> brand_b) SELECT i.brand, COUNT(DISTINCT least(e.item, e.other) * 1000000000 + greatest(e.item, e.other)) AS relations FROM e JOIN items i ON e.item = i.item GROUP BY i.brand""",
    "directed_edge_metrics": """WITH d AS (SELECT item_a, item_b, size_b >= size_a AS forward, price_b >= price_a AS truth, (item_a + item_b) % 3 <> 0 AS found FROM pairs WHERE brand_a = brand_b)
        SELECT COUNT(*) AS edges, count_if(found) AS predicted, count_if(found AND forward = truth) AS right_way, CAST(count_if(found) AS DOUBLE) / COUNT(*) AS recall, CAST(count_if(found AND forward = truth) AS DOUBLE) / nullif(count_if(found), 0) AS direction_accuracy FROM d""",
    "frozen_clusters": "WITH f AS (SELECT DISTINCT cluster FROM clusters WHERE coded) SELECT c.item, c.cluster, f.cluster IS NOT NULL AS frozen FROM clusters c LEFT JOIN f ON c.cluster = f.cluster",
    "review_queue": """SELECT v.item_a, v.item_b, CASE WHEN v.vetoes = 0 AND v.matched = v.compared THEN 'high' WHEN v.vetoes = 0 THEN 'grey' ELSE 'low' END AS band FROM verdicts v LEFT JOIN (SELECT item_a, item_b FROM pairs WHERE (item_a + item_b) % 10 = 0) d ON v.item_a = d.item_a AND v.item_b = d.item_b
        WHERE d.item_a IS NULL AND (v.vetoes = 0 OR v.in_band > 0)""",
    "next_serials": """WITH u AS (SELECT class, cluster % 50 AS serial FROM clusters WHERE coded GROUP BY class, cluster % 50), g AS (SELECT class, serial, row_number() OVER (PARTITION BY class ORDER BY serial) - 1 AS k FROM u)
        SELECT class, coalesce(MIN(CASE WHEN serial <> k THEN k END), MAX(k) + 1) AS next_serial FROM g GROUP BY class""",
    "auto_issue_gate": """SELECT c.cluster, MAX(c.members) AS members, bool_and(v.vetoes = 0) AS no_veto, bool_and(v.matched = v.compared) AS full_agreement, MAX(c.members) >= 2 AND bool_and(v.vetoes = 0 AND v.matched = v.compared) AS may_issue
        FROM clusters c JOIN clusters d ON c.cluster = d.cluster AND c.item < d.item JOIN verdicts v ON v.item_a = c.item AND v.item_b = d.item GROUP BY c.cluster""",
    "adjudicate_pairs": "SELECT item_a, item_b, CASE WHEN identity_vetoes > 0 THEN 'veto' WHEN vetoes > 0 THEN 'distinct' WHEN matched < compared THEN 'coverage' ELSE 'merge' END AS lean FROM verdicts",
    "probe_topk": """WITH q AS (SELECT * FROM items WHERE item = (SELECT MIN(item) FROM items)) SELECT i.item, (CASE WHEN i.class = q.class THEN 0.5 ELSE 0.0 END) + (CASE WHEN i.brand = q.brand THEN 0.3 ELSE 0.0 END) + (CASE WHEN i.name = q.name THEN 1.0 ELSE 0.0 END) AS score
        FROM items i CROSS JOIN q WHERE i.item <> q.item AND (i.class = q.class OR i.brand = q.brand OR i.name = q.name) ORDER BY score DESC, i.item LIMIT 80""",
    "catalogue_search": """SELECT item, description, CASE WHEN description LIKE '%SIZE 1%' THEN 0 ELSE 1 END AS phrase_miss FROM items WHERE ' ' || upper(description) LIKE '% SIZE%' AND ' ' || upper(description) LIKE '% 1%'""",
    "code_lookup": """WITH c AS (SELECT 7 AS probe UNION ALL SELECT 12 UNION ALL SELECT 999999999), h AS (SELECT probe, item, 1 AS method FROM c JOIN items ON item = probe UNION ALL SELECT probe, item, 2 FROM c JOIN items ON size_mm = probe), m AS (SELECT probe, MIN(method) AS method FROM h GROUP BY probe)
        SELECT CAST(h.probe AS BIGINT) AS probe, h.item, CAST(h.method AS BIGINT) AS method FROM h JOIN m ON h.probe = m.probe AND h.method = m.method""",
    "pending_rows": "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL",
    "ingest_validate": """WITH r AS (SELECT doc_id AS row_no, norm AS code, norm, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS k FROM texts)
        SELECT row_no, CASE WHEN code = '' THEN 'missing code' WHEN length(norm) < 60 THEN 'missing description' WHEN k > 1 THEN 'duplicate in file' ELSE 'accepted' END AS outcome FROM r""",
    "band_counts": "SELECT CASE WHEN vetoes > 0 THEN 'low' WHEN matched = compared THEN 'high' ELSE 'grey' END AS band, COUNT(*) AS pairs FROM verdicts GROUP BY 1",
    "queue_facets": "WITH f AS (SELECT item_a, item_b, brand_a AS brand FROM pairs UNION SELECT item_a, item_b, brand_b FROM pairs) SELECT brand, COUNT(*) AS tasks FROM f GROUP BY brand",
    "incremental_pairs": "SELECT item_a, item_b FROM pairs WHERE item_a % 10 = 9 OR item_b % 10 = 9",
}
