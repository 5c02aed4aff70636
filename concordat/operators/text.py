"""Text and number functions over catalogue text, as queries. Each has a Spark and a DuckDB form where the engines differ."""

SQL = {
    "pack_quantity": "SELECT item, CASE WHEN description LIKE '%BOX OF%' THEN 1 ELSE 0 END AS boxed, CASE WHEN size_mm % 10 = 0 THEN 10 WHEN size_mm % 5 = 0 THEN 5 ELSE 1 END AS pack FROM items",
    "unit_convert": "SELECT item, CAST(size_mm AS DOUBLE) AS mm, size_mm / 25.4E0 AS inch, size_mm / 1000.0E0 AS metre, (size_mm - 32) * 5.0E0 / 9.0E0 AS celsius FROM items",
    "gtin_valid": """WITH d AS (SELECT p_partkey AS id, lpad(CAST(p_partkey * 7919 AS VARCHAR(20)), 12, '0') AS g FROM part), s AS (SELECT id, g, """
    + " + ".join(f"CAST(substr(g, {i}, 1) AS INT) * {1 if (12 - i) % 2 == 0 else 3}" for i in range(1, 13))
    + """ AS total_sum FROM d) SELECT id, g, CAST(total_sum AS BIGINT) AS total_sum, total_sum % 10 = 0 AS valid FROM s""",
}

#: name: (Spark, DuckDB)
#: Bounded tables whose every value counts, with their columns.
FINGERPRINTED = (("region", "r_regionkey, r_name"), ("nation", "n_nationkey, n_name, n_regionkey"))
PAIRS = {
    "vocabulary": (
        "SELECT w, COUNT(*) AS docs FROM (SELECT doc_id, explode(array_distinct(split(norm, ' +'))) AS w FROM texts) WHERE length(w) >= 4 AND w RLIKE '^[a-z]+$' GROUP BY w HAVING COUNT(*) >= 5",
        "SELECT w, COUNT(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(norm, ' +'))) AS w FROM texts) WHERE length(w) >= 4 AND regexp_matches(w, '^[a-z]+$') GROUP BY w HAVING COUNT(*) >= 5",
    ),
    "char_ngrams": (
        "SELECT item_id, explode(array_distinct(transform(sequence(1, greatest(length(t) - 2, 1)), i -> substr(t, i, 3)))) AS gram FROM (SELECT item_id, lower(text) AS t FROM benchmark)",
        "SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3)))) AS gram FROM (SELECT item_id, lower(text) AS t FROM benchmark)",
    ),
    "token_jaccard": (
        "WITH t AS (SELECT item, brand, class, array_distinct(split(description, ' ')) AS w FROM items) SELECT a.item AS item_a, b.item AS item_b, CAST(size(array_intersect(a.w, b.w)) AS DOUBLE) / size(array_union(a.w, b.w)) AS jaccard FROM t a JOIN t b ON a.class = b.class AND a.brand = b.brand AND a.item < b.item",
        "WITH t AS (SELECT item, brand, class, list_distinct(string_split(description, ' ')) AS w FROM items) SELECT a.item AS item_a, b.item AS item_b, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) AS jaccard FROM t a JOIN t b ON a.class = b.class AND a.brand = b.brand AND a.item < b.item",
    ),
    "token_delta": (
        "SELECT item_a, item_b, array_join(array_sort(array_except(split(text_b, ' '), split(text_a, ' '))), ' ') AS added FROM pairs",
        "SELECT item_a, item_b, array_to_string(list_sort(list_distinct(list_filter(string_split(text_b, ' '), lambda x: NOT list_contains(string_split(text_a, ' '), x)))), ' ') AS added FROM pairs",
    ),
    "figures_in_text": (
        "SELECT doc_id, CAST(size(regexp_extract_all(text, '[0-9]+', 0)) AS BIGINT) AS figures FROM documents",
        "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS figures FROM documents",
    ),
    "cosine_pairs": (
        """WITH v AS (SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, e, sqrt(aggregate(e, 0D, (s, x) -> s + x * x)) AS size FROM v)
        SELECT a.vec_id AS a, b.vec_id AS b, floor(1e6 * aggregate(zip_with(a.e, b.e, (x, y) -> x * y), 0D, (s, x) -> s + x) / (a.size * b.size) + 0.5) / 1e6 AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id""",
        """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v)
        SELECT a.vec_id AS a, b.vec_id AS b, floor(1e6 * list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.size * b.size) + 0.5) / 1e6 AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id""",
    ),
    "table_fingerprint": (
        " UNION ALL ".join(f"SELECT '{t}' AS tab, COUNT(*) AS n, sha256_hex(array_join(array_sort(collect_list(concat_ws('|', {c}))), '#')) AS fingerprint FROM {t}" for t, c in FINGERPRINTED).replace("sha256_hex(", "sha2(").replace(", '#'))", ", '#'), 256)"),
        " UNION ALL ".join(f"SELECT '{t}' AS tab, COUNT(*) AS n, sha256(array_to_string(list_sort(list(concat_ws('|', {c}))), '#')) AS fingerprint FROM {t}" for t, c in FINGERPRINTED),
    ),
}
