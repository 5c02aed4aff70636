"""Roles that the driver tables play, as common table expressions that Spark and DuckDB both read.

company = nation of the customer, material = part, class = p_type, vendor = supplier, event log = events. Sums go through
decimals, so both engines add alike.
"""

from __future__ import annotations

import re

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MONTH_DAYS, CAPTURE, WINDOW_MONTHS = 31, 0.6, 24

PACK = "CASE WHEN p.p_size % 10 = 0 THEN 10 WHEN p.p_size % 5 = 0 THEN 5 ELSE 1 END"


def total(x: str) -> str:
    return f"CAST(SUM(CAST(floor(CAST({x} AS DOUBLE) * 10000 + 0.5) AS DECIMAL(28,0))) AS DOUBLE) / 10000"


ROLES = {
    "purchase": f"""SELECT l.l_partkey AS material, p.p_type AS class, n.n_name AS company, CAST(o.o_orderdate AS DATE) AS po_date, o.o_orderkey AS po,
        l.l_linenumber AS line, l.l_quantity AS qty, l.l_extendedprice AS value, l.l_extendedprice / l.l_quantity AS price,
        {PACK} AS pack, (l.l_extendedprice / l.l_quantity) / ({PACK}) AS unit_price, l.l_suppkey AS vendor_id
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "as_of": "SELECT MAX(CAST(o_orderdate AS DATE)) AS as_of FROM orders",
    "recent": f"SELECT b.* FROM purchase b CROSS JOIN as_of a WHERE b.po_date >= a.as_of - INTERVAL '{WINDOW_MONTHS * MONTH_DAYS}' DAY",
    "vendor": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' LTD' WHEN 1 THEN 'M/S ' || s_name || ' LIMITED' ELSE s_name END AS spelling FROM supplier""",
    "vendor_keys": """SELECT s_suppkey, spelling, trim(replace(replace(replace(replace(upper(spelling), 'M/S', ''), ' LIMITED', ''), ' LTD', ''), '&', ' AND ')) AS vendor_key FROM vendor""",
    "stock": f"""SELECT l.l_partkey AS material, p.p_type AS class, n.n_name AS company, l.l_returnflag AS plant,
        {total("CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity ELSE 0 END")} AS on_hand,
        CAST(SUM(CAST(CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity ELSE 0 END AS DECIMAL(18,4))) AS DOUBLE) * 0.1 AS reserved,
        MAX(CAST(l.l_shipdate AS DATE)) AS last_move, MAX(p.p_retailprice) AS unit_value
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY l.l_partkey, p.p_type, n.n_name, l.l_returnflag""",
    "items": """SELECT p_partkey AS item, p_name || ' ' || p_brand || ' ' || p_type || ' SIZE ' || CAST(p_size AS VARCHAR(10)) AS description,
        p_name AS name, p_type AS class, p_brand AS brand, p_size AS size_mm, p_retailprice AS price, p_partkey % 3 = 0 AS coded FROM part""",
    "clusters": """SELECT item, class, brand, name, coded, MIN(item) OVER (PARTITION BY name, class, brand) AS cluster,
        COUNT(*) OVER (PARTITION BY name, class, brand) AS members FROM items""",
    "pairs": """SELECT a.item AS item_a, b.item AS item_b, a.class, a.brand AS brand_a, b.brand AS brand_b, a.size_mm AS size_a, b.size_mm AS size_b,
        a.price AS price_a, b.price AS price_b, a.description AS text_a, b.description AS text_b
        FROM items a JOIN items b ON a.class = b.class AND a.name = b.name AND a.item < b.item""",
    "compared": """SELECT item_a, item_b, 'brand' AS attr, 'identity' AS role, CASE WHEN brand_a = brand_b THEN 'match' ELSE 'mismatch' END AS outcome FROM pairs
        UNION ALL SELECT item_a, item_b, 'size', 'performance', CASE WHEN size_a = size_b THEN 'match' WHEN abs(size_a - size_b) <= 2 THEN 'in_band' ELSE 'out_of_band' END FROM pairs
        UNION ALL SELECT item_a, item_b, 'price', 'cosmetic', CASE WHEN abs(price_a - price_b) <= 0.000001 THEN 'match'
            WHEN abs(price_a - price_b) <= 0.05 * greatest(price_a, price_b) THEN 'in_band' ELSE 'out_of_band' END FROM pairs""",
    "verdicts": """SELECT item_a, item_b, COUNT(*) AS compared, count_if(outcome IN ('match', 'in_band')) AS matched,
        count_if((role = 'identity' AND outcome = 'mismatch') OR (role = 'performance' AND outcome = 'out_of_band')) AS vetoes,
        count_if(role = 'identity' AND outcome = 'mismatch') AS identity_vetoes, count_if(outcome = 'in_band') AS in_band FROM compared GROUP BY item_a, item_b""",
    "log": "SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type AS action, value AS seconds, props FROM events",
    "texts": "SELECT doc_id, trim(lower(replace(replace(text, chr(10), ' '), chr(13), ' '))) AS norm, text, source, lang FROM documents",
}


def with_roles(sql: str) -> str:
    """The statement after the roles it names, and those that they name, in order."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in ROLES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.IGNORECASE) and name not in wanted:
                visit(ROLES[name])
                wanted.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS ({ROLES[n]})" for n in wanted)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:].lstrip()}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
