"""Procurement analytics: purchases, joint demand, prices, vendors, ABC classes, savings, and the reviewed query templates."""

from ..plans.roles import CAPTURE, total

DEMAND = f"""SELECT material, COUNT(DISTINCT company) AS companies, MIN(CASE WHEN unit_price > 0 THEN unit_price END) AS lo,
    MAX(CASE WHEN unit_price > 0 THEN unit_price END) AS hi, {total("qty * pack")} AS volume FROM recent GROUP BY material
    HAVING COUNT(DISTINCT company) >= 2 AND MAX(unit_price) > 0"""

SQL = {
    "items_by_class": "SELECT p_type AS class, COUNT(*) AS items, COUNT(DISTINCT p_brand) AS brands, MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM part GROUP BY p_type",
    "purchase_fact": "SELECT material, class, company, CAST(po_date AS VARCHAR(10)) AS po_date, po, line, qty, price, CAST(pack AS BIGINT) AS pack, unit_price FROM recent",
    "joint_demand": f"WITH d AS ({DEMAND}) SELECT material, companies, lo, hi, volume, (hi - lo) * volume AS ceiling, (hi - lo) * volume * {CAPTURE} AS estimate FROM d ORDER BY ceiling DESC, material LIMIT 50",
    "joint_demand_shares": f"""WITH d AS ({DEMAND}), v AS (SELECT material, company, {total("qty * pack")} AS own FROM recent GROUP BY material, company)
        SELECT v.material, v.company, v.own, v.own / d.volume AS share, (d.hi - d.lo) * d.volume * {CAPTURE} * (v.own / d.volume) AS attributed FROM v JOIN d ON v.material = d.material""",
    "price_variance": f"""WITH c AS (SELECT material, company, {total("unit_price")} / COUNT(*) AS mean FROM recent WHERE unit_price > 0 GROUP BY material, company)
        SELECT material, COUNT(*) AS companies, MIN(mean) AS lo, MAX(mean) AS hi, (MAX(mean) - MIN(mean)) / MAX(mean) AS spread,
        min_by(company, struct_key) AS cheapest, max_by(company, struct_key) AS dearest FROM (SELECT *, mean AS struct_key FROM c) GROUP BY material HAVING COUNT(*) > 1""",
    "price_anomalies": f"""WITH c AS (SELECT material, company, {total("unit_price")} / COUNT(*) AS mean FROM recent WHERE unit_price > 0 GROUP BY material, company)
        SELECT a.material, a.company, a.mean, COUNT(*) AS peers, median(b.mean) AS peer_median, a.mean > 1.5 * median(b.mean) AS anomaly
        FROM c a JOIN c b ON a.material = b.material AND a.company <> b.company GROUP BY a.material, a.company, a.mean HAVING COUNT(*) >= 2""",
    "vendor_key": "SELECT s_suppkey, spelling, vendor_key FROM vendor_keys",
    "vendor_overlap": """SELECT vendor_key, COUNT(DISTINCT company) AS companies, COUNT(DISTINCT material) AS materials, COUNT(DISTINCT spelling) AS spellings
        FROM recent r JOIN vendor_keys v ON r.vendor_id = v.s_suppkey GROUP BY vendor_key HAVING COUNT(DISTINCT company) >= 2""",
    "shared_vendor_materials": """SELECT material, COUNT(DISTINCT company) AS companies, COUNT(DISTINCT vendor_key) AS vendors FROM recent r JOIN vendor_keys v ON r.vendor_id = v.s_suppkey
        GROUP BY material HAVING COUNT(DISTINCT company) >= 2 AND COUNT(DISTINCT vendor_key) >= 2""",
    "abc_classes": f"""WITH s AS (SELECT company, material, {total("value")} AS spend FROM recent GROUP BY company, material),
        r AS (SELECT company, material, spend, CAST(SUM(CAST(spend AS DECIMAL(18,4))) OVER (PARTITION BY company ORDER BY spend DESC, material DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running,
              CAST(SUM(CAST(spend AS DECIMAL(18,4))) OVER (PARTITION BY company) AS DOUBLE) AS everything FROM s)
        SELECT company, material, spend, running / everything AS share, CASE WHEN running / everything <= 0.70 THEN 'A' WHEN running / everything <= 0.90 THEN 'B' ELSE 'C' END AS abc FROM r""",
    "savings_ladder": f"""WITH d AS ({DEMAND}), t AS (SELECT {total("value")} AS spend FROM recent), s AS (SELECT {total("r.value")} AS shared FROM recent r JOIN d ON r.material = d.material),
        e AS (SELECT {total("(hi - lo) * volume")} AS ceiling FROM d)
        SELECT spend, shared, ceiling, ceiling * 0.6 AS estimate, ceiling * 0.4 AS cautious, ceiling * 0.8 AS hopeful FROM t CROSS JOIN s CROSS JOIN e""",
    "funnel_ratios": """WITH c AS (SELECT COUNT(*) AS n FROM items), f AS (
        SELECT 1 AS step, 'possible' AS rung, CAST(n AS DOUBLE) * (n - 1) / 2 AS size FROM c
        UNION ALL SELECT 2, 'candidates', CAST(COUNT(*) AS DOUBLE) FROM pairs UNION ALL SELECT 3, 'not vetoed', CAST(COUNT(*) AS DOUBLE) FROM verdicts WHERE vetoes = 0
        UNION ALL SELECT 4, 'materials', CAST(COUNT(DISTINCT cluster) AS DOUBLE) FROM clusters UNION ALL SELECT 5, 'coded', CAST(COUNT(DISTINCT cluster) AS DOUBLE) FROM clusters WHERE coded)
        SELECT CAST(step AS BIGINT) AS step, rung, size, size / LAG(size) OVER (ORDER BY step) AS ratio FROM f""",
    "price_trend": """SELECT company, material, COUNT(*) AS orders, min_by(unit_price, k) AS first_price, max_by(unit_price, k) AS last_price,
        CASE WHEN max_by(unit_price, k) > min_by(unit_price, k) THEN 'up' WHEN max_by(unit_price, k) < min_by(unit_price, k) THEN 'down' ELSE 'flat' END AS direction
        FROM (SELECT *, row_number() OVER (PARTITION BY company, material ORDER BY po_date, po, line, qty, value) AS k FROM recent) GROUP BY company, material HAVING COUNT(*) > 1""",
    "latest_price": """SELECT material, company, unit_price, CAST(po_date AS VARCHAR(10)) AS po_date FROM (SELECT *, row_number() OVER (PARTITION BY material ORDER BY po_date DESC, po DESC, line DESC, qty DESC, value DESC, company) AS k FROM purchase) WHERE k = 1""",
    "spend_quarter": f"""WITH s AS (SELECT company, {total("value")} AS spend FROM recent GROUP BY company), r AS (SELECT company, spend, percent_rank() OVER (ORDER BY spend) AS share FROM s)
        SELECT company, spend, share, CASE WHEN share >= 0.75 THEN 'top quarter' WHEN share >= 0.5 THEN 'upper middle' WHEN share >= 0.25 THEN 'lower middle' ELSE 'bottom quarter' END AS band FROM r""",
    "premium_over_mean": f"""WITH c AS (SELECT material, company, {total("unit_price")} / COUNT(*) AS mean, {total("qty * pack")} AS volume FROM recent WHERE unit_price > 0 GROUP BY material, company),
        m AS (SELECT material, {total("mean")} / COUNT(*) AS overall FROM c GROUP BY material HAVING COUNT(*) >= 2)
        SELECT c.material, c.company, c.mean, m.overall, c.mean / m.overall - 1 AS premium, greatest(c.mean - m.overall, 0) * c.volume AS excess FROM c JOIN m ON c.material = m.material""",
    "redacted_prices": """SELECT material, company, po, line, qty, CASE WHEN company = 'NATION_0' THEN unit_price END AS unit_price, company <> 'NATION_0' AS redacted FROM recent""",
    "price_band": f"SELECT material, MIN(unit_price) AS lo, MAX(unit_price) AS hi, {total('unit_price')} / COUNT(*) AS mean, COUNT(*) AS n FROM recent WHERE unit_price > 0 GROUP BY material",
    "materials_by_company_count": """WITH k AS (SELECT material, COUNT(*) AS n, COUNT(DISTINCT company) AS k FROM purchase GROUP BY material)
        SELECT k AS companies, COUNT(*) AS materials, CAST(SUM(n) AS BIGINT) AS order_rows, CAST(SUM(n - k) AS BIGINT) AS internal FROM k GROUP BY k""",
    "internal_duplicates": "SELECT company, CAST(SUM(n - 1) AS BIGINT) AS duplicates, COUNT(*) AS groups FROM (SELECT company, material, COUNT(*) AS n FROM purchase GROUP BY company, material) GROUP BY company",
    "class_company_heatmap": """WITH d AS (SELECT class, company FROM (SELECT DISTINCT class FROM purchase) CROSS JOIN (SELECT DISTINCT company FROM purchase)),
        c AS (SELECT class, company, COUNT(DISTINCT material) AS n FROM purchase GROUP BY class, company), g AS (SELECT d.class, d.company, coalesce(c.n, 0) AS n FROM d LEFT JOIN c ON d.class = c.class AND d.company = c.company)
        SELECT class, company, n, CAST(n AS DOUBLE) / MAX(n) OVER () AS intensity FROM g""",
    "facets": "SELECT company, class, COUNT(*) AS order_rows, COUNT(DISTINCT material) AS materials FROM purchase GROUP BY GROUPING SETS ((company), (class), (company, class))",
    "tpl_duplicates_by_company": """WITH m AS (SELECT material FROM purchase GROUP BY material HAVING COUNT(DISTINCT company) > 1)
        SELECT company, COUNT(DISTINCT b.material) AS shared FROM purchase b JOIN m ON b.material = m.material GROUP BY company""",
    "tpl_price_by_company": f"SELECT company, {total('unit_price')} / COUNT(*) AS mean_price, COUNT(*) AS orders FROM recent WHERE class = 'TYPE_1' OR class = (SELECT MIN(p_type) FROM part) GROUP BY company",
    "tpl_price_spread": """SELECT material, COUNT(DISTINCT company) AS companies, MIN(unit_price) AS lo, MAX(unit_price) AS hi, (MAX(unit_price) - MIN(unit_price)) / MAX(unit_price) AS spread
        FROM recent GROUP BY material HAVING COUNT(DISTINCT company) > 1 AND MAX(unit_price) > 0 ORDER BY spread DESC, material LIMIT 20""",
    "tpl_joint_volume": f"SELECT material, {total('qty * pack')} AS volume, COUNT(DISTINCT company) AS companies FROM recent GROUP BY material HAVING COUNT(DISTINCT company) > 1 ORDER BY volume DESC, material LIMIT 20",
    "tpl_items_by_class": "SELECT class, COUNT(*) AS items FROM items GROUP BY class",
}
