"""The event log: latency, trends, prevention, verification, event-time operators (the last are extensions)."""

SQL = {
    "decision_latency": """WITH r AS (SELECT action, seconds, row_number() OVER (PARTITION BY action ORDER BY seconds, event_id) - 1 AS k, COUNT(*) OVER (PARTITION BY action) AS n FROM log)
        SELECT action, MAX(n) AS n, MAX(CASE WHEN k = CAST(floor(n / 2.0) AS BIGINT) THEN seconds END) AS upper_median, MAX(CASE WHEN k = least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) THEN seconds END) AS p90 FROM r GROUP BY action""",
    "daily_trend": """WITH d AS (SELECT day, COUNT(*) AS n FROM log GROUP BY day) SELECT CAST(day AS VARCHAR(10)) AS day, n, CAST(SUM(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM d""",
    "tpl_pending": "SELECT action, user_id % 3 AS desk, COUNT(*) AS pending FROM log WHERE seconds > 100 GROUP BY action, user_id % 3",
    "tpl_latest_codes": "SELECT event_id, action, user_id FROM log ORDER BY ts DESC, event_id DESC LIMIT 25",
    "prevention_rate": """SELECT action, count_if(seconds >= 50) AS prevented, COUNT(*) AS total_rows, CAST(count_if(seconds >= 50) AS DOUBLE) / nullif(COUNT(*), 0) AS rate FROM log GROUP BY action""",
    "action_prefix": "SELECT action, COUNT(*) AS n FROM log WHERE action NOT LIKE 'c%' GROUP BY action",
    "ext_tumbling": "SELECT CAST(date_trunc('hour', ts) AS VARCHAR(19)) AS w, action, COUNT(*) AS n FROM log GROUP BY 1, 2",
    "ext_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM log),
        s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(k AS BIGINT) AS k, COUNT(*) AS n FROM s GROUP BY user_id, k""",
    "ext_dedup": "SELECT user_id, action, MIN(event_id) AS first_event FROM log GROUP BY user_id, action",
}
