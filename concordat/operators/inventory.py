"""Stock: totals, consolidation, age, dead stock, transfers, scorecards, retirement, change plans."""

from ..plans.roles import total

PLAN = """WITH k AS (SELECT c.cluster, s.material, s.company, CAST(SUM(CAST(s.on_hand AS DECIMAL(18,4))) AS DOUBLE) AS stock, CAST(SUM(CAST(s.on_hand * s.unit_value AS DECIMAL(18,4))) AS DOUBLE) AS value
        FROM stock s JOIN clusters c ON s.material = c.item WHERE c.coded GROUP BY c.cluster, s.material, s.company),
    o AS (SELECT l_partkey AS material, COUNT(*) AS open_lines FROM lineitem l JOIN orders r ON l.l_orderkey = r.o_orderkey CROSS JOIN as_of WHERE r.o_orderstatus = 'O' AND CAST(r.o_orderdate AS DATE) >= as_of - INTERVAL '93' DAY GROUP BY l_partkey),
    r AS (SELECT k.*, coalesce(o.open_lines, 0) AS open_lines, row_number() OVER (PARTITION BY k.cluster ORDER BY k.stock DESC, k.material, k.company) AS place FROM k LEFT JOIN o ON k.material = o.material),
    plan AS (SELECT cluster, material, company, stock, value, open_lines, CASE WHEN place = 1 THEN 'crossref' ELSE 'block' END AS action,
        CASE WHEN open_lines > 0 THEN 'hold' WHEN place > 1 AND stock > 0 AND value >= 5000000 THEN 'conflict' ELSE 'safe' END AS impact FROM r)"""

SQL = {
    "stock_totals": f"SELECT company, {total('on_hand')} AS on_hand, {total('on_hand * unit_value')} AS value, COUNT(*) AS positions, COUNT(DISTINCT material) AS materials FROM stock GROUP BY company",
    "consolidated_stock": f"SELECT material, COUNT(DISTINCT company) AS companies, COUNT(*) AS positions, {total('on_hand')} AS on_hand, {total('on_hand - reserved')} AS available, {total('on_hand * unit_value')} AS value FROM stock GROUP BY material",
    "stock_age_bins": f"""WITH b AS (SELECT s.*, CASE WHEN last_move >= as_of - INTERVAL '186' DAY THEN '0-6' WHEN last_move >= as_of - INTERVAL '372' DAY THEN '6-12' WHEN last_move >= as_of - INTERVAL '558' DAY THEN '12-18'
        WHEN last_move >= as_of - INTERVAL '744' DAY THEN '18-24' WHEN last_move >= as_of - INTERVAL '930' DAY THEN '24-30' ELSE '30+' END AS age FROM stock s CROSS JOIN as_of WHERE on_hand > 0)
        SELECT age, COUNT(DISTINCT material) AS materials, COUNT(*) AS positions, {total('on_hand * unit_value')} AS value FROM b GROUP BY age""",
    "dead_stock": f"""SELECT material, COUNT(DISTINCT company) AS companies, {total('on_hand')} AS on_hand, {total('on_hand * unit_value')} AS value, CAST(MAX(last_move) AS VARCHAR(10)) AS last_move
        FROM stock CROSS JOIN as_of WHERE on_hand > 0 AND last_move < as_of - INTERVAL '372' DAY GROUP BY material""",
    "tpl_idle_stock": """SELECT material, company, plant, on_hand, CAST(last_move AS VARCHAR(10)) AS last_move FROM stock CROSS JOIN as_of WHERE on_hand > 0 AND last_move < as_of - INTERVAL '12' MONTH""",
    "transfer_suggestions": """WITH a AS (SELECT s.*, on_hand - reserved AS available FROM stock s), m AS (SELECT material FROM a GROUP BY material HAVING COUNT(DISTINCT company) >= 2 AND MAX(on_hand) > 0),
        f AS (SELECT a.*, row_number() OVER (PARTITION BY a.material ORDER BY available * unit_value DESC, a.company, plant) AS k FROM a JOIN m ON a.material = m.material CROSS JOIN as_of
              WHERE on_hand > 0 AND available >= 50 AND last_move < as_of - INTERVAL '372' DAY),
        t AS (SELECT a.*, row_number() OVER (PARTITION BY a.material ORDER BY a.company, plant) AS k FROM a JOIN m ON a.material = m.material WHERE available < 10)
        SELECT f.material, f.company AS source, f.plant AS source_plant, t.company AS target, t.plant AS target_plant, f.available AS surplus, t.available AS shortage
        FROM f JOIN t ON f.material = t.material AND f.k = 1 AND t.k = 1 WHERE f.company <> t.company""",
    "quality_scorecard": """WITH own AS (SELECT DISTINCT company, material FROM purchase), i AS (SELECT o.company, c.*, p.p_size > 10 AS has_part_number, p.p_size % 5 <> 0 AS has_unit FROM own o JOIN clusters c ON o.material = c.item JOIN part p ON p.p_partkey = c.item),
        d AS (SELECT company, cluster, COUNT(*) AS n FROM i GROUP BY company, cluster), dd AS (SELECT company, SUM(n - 1) AS dup FROM d GROUP BY company),
        q AS (SELECT company, COUNT(*) AS n, count_if(class IS NOT NULL) AS classed, count_if(has_unit) AS units, count_if(has_part_number) AS numbers FROM i GROUP BY company),
        j AS (SELECT q.company, n, classed, units, numbers, dup FROM q JOIN dd ON q.company = dd.company),
        g AS (SELECT coalesce(company, 'ALL') AS company, SUM(n) AS n, SUM(classed) AS classed, SUM(units) AS units, SUM(numbers) AS numbers, SUM(dup) AS dup FROM j GROUP BY GROUPING SETS ((company), ()))
        SELECT company, CAST(n AS BIGINT) AS items, CAST(dup AS BIGINT) AS internal, 0.50 * CAST(classed AS DOUBLE) / CAST(n AS DOUBLE) + 0.15 * CAST(units AS DOUBLE) / CAST(n AS DOUBLE)
            + 0.10 * CAST(numbers AS DOUBLE) / CAST(n AS DOUBLE) + 0.25 * (1 - CAST(dup AS DOUBLE) / CAST(n AS DOUBLE)) AS score FROM g""",
    "retirement_candidates": """WITH last AS (SELECT material, company, MAX(po_date) AS last_po FROM purchase GROUP BY material, company), s AS (SELECT material, company, MAX(last_move) AS last_move, SUM(on_hand) AS on_hand FROM stock GROUP BY material, company)
        SELECT s.material, s.company, CAST(last_po AS VARCHAR(10)) AS last_po, CAST(last_move AS VARCHAR(10)) AS last_move, on_hand = 0 AS empty_stock FROM s JOIN last ON s.material = last.material AND s.company = last.company CROSS JOIN as_of
        WHERE last_po < as_of - INTERVAL '744' DAY AND last_move < as_of - INTERVAL '744' DAY""",
    "harmonisation_by_class": """SELECT class, COUNT(*) AS items, count_if(coded) AS coded_items, count_if(NOT coded AND members > 1) AS duplicate_pending, count_if(NOT coded AND members = 1) AS unique_items FROM clusters GROUP BY class""",
    "migration_plan": f"{PLAN} SELECT * FROM plan",
    "migration_diff": f"""{PLAN} SELECT material, company, 'code' AS field, CAST(NULL AS VARCHAR(20)) AS was, CAST(cluster AS VARCHAR(20)) AS becomes FROM plan WHERE impact = 'safe' AND action = 'crossref'
        UNION ALL SELECT material, company, 'blocked', '0', '1' FROM plan WHERE impact = 'safe' AND action = 'block' UNION ALL SELECT material, company, 'supersedes', CAST(NULL AS VARCHAR(20)), CAST(cluster AS VARCHAR(20)) FROM plan WHERE impact = 'safe' AND action = 'block'""",
    "migration_drift": f"""{PLAN}, applied AS (SELECT * FROM plan WHERE impact = 'safe' AND material % 7 <> 0) SELECT p.impact, p.action, COUNT(*) AS planned, COUNT(a.material) AS applied, COUNT(*) - COUNT(a.material) AS drift
        FROM plan p LEFT JOIN applied a ON p.material = a.material AND p.company = a.company GROUP BY p.impact, p.action""",
    "count_variance": """WITH s AS (SELECT material, company, plant, on_hand, CASE WHEN material % 11 = 0 THEN NULL ELSE floor(on_hand * (1 + (material % 5 - 2) / 100.0)) END AS counted FROM stock)
        SELECT material, company, plant, on_hand, CAST(counted AS DOUBLE) AS counted, CAST(counted - on_hand AS DOUBLE) AS variance, CASE WHEN counted IS NULL THEN 'unknown' WHEN counted > on_hand THEN 'over' WHEN counted < on_hand THEN 'short' ELSE 'exact' END AS state FROM s""",
    "critical_spares": """SELECT DISTINCT s.material, s.company, min(CASE WHEN p.p_size <= 10 THEN 'A' WHEN p.p_size <= 30 THEN 'B' ELSE 'C' END) OVER (PARTITION BY s.material) AS criticality FROM stock s JOIN part p ON s.material = p.p_partkey""",
}
