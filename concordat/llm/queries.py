"""The queries opN_<name> with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, bpe, language_id, media, mixing, ngram_join, packing, quality, target_encoding, token_counts, token_files, url_filter

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_rows(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), RULES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_encoding.encode_sales(*(table(spark, sf_dir, n) for n in ("sale_lines", "sales", "items", "vendors", "clients")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_packing, op3_ngram_join, op4_language_id, op5_bpe_round_trip, op6_nearest, op7_token_files, op8_media_chunks, op9_url_filter, op10_quality, op11_target_encoding, op12_alignment, op13_mixing, pipeline)
    return {f.__name__: f for f in own}


OP9_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM b),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
             ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
      FROM c JOIN r ON ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (page_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN len(a) >= 5 THEN list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' ')))
                          WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
u AS (SELECT g, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
f AS (SELECT rep, len(g) AS n, unnest(g) AS k FROM u),
p AS (SELECT a.rep AS x, b.rep AS y FROM f a JOIN f b ON a.k = b.k AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
c AS (SELECT rep AS x, rep AS y FROM u UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
l AS (SELECT x, min(y) AS y FROM c GROUP BY x),
m AS (SELECT s.doc_id, u.rep FROM s JOIN u ON list_sort(s.g) = u.g)
SELECT n.doc_id, n.n AS n_shingles, coalesce(l.y, n.doc_id) AS component_id
FROM n LEFT JOIN m USING (doc_id) LEFT JOIN l ON m.rep = l.x
"""


OP11_SQL = r"""
WITH f AS (SELECT sale_id, CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL)),
g AS (SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, coalesce(l.vendor_id, -1) AS vendor_id, coalesce(s.client_id, -1) AS client_id, s.sold_at AS t, f.fold,
             count(*) AS n, count(*) FILTER (l.flag = 'returned') AS s
      FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id JOIN f ON f.sale_id = s.sale_id WHERE s.sold_at IS NOT NULL GROUP BY ALL),
h AS (SELECT g.*, coalesce(i.kind, '-') AS kind, coalesce(CAST(v.nation_id AS VARCHAR), '-') AS nation, coalesce(c.segment, '-') AS segment
      FROM g LEFT JOIN items i USING (item_id) LEFT JOIN vendors v USING (vendor_id) LEFT JOIN clients c USING (client_id)),
e AS (SELECT c, k, t, fold, sum(n) AS n, sum(s) AS s FROM (SELECT 'all' AS c, '' AS k, t, fold, n, s FROM h UNION ALL SELECT 'kind', kind, t, fold, n, s FROM h UNION ALL SELECT 'nation', nation, t, fold, n, s FROM h
      UNION ALL SELECT 'segment', segment, t, fold, n, s FROM h UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), t, fold, n, s FROM h UNION ALL SELECT 'vendor', CAST(vendor_id AS VARCHAR), t, fold, n, s FROM h
      UNION ALL SELECT 'client', CAST(client_id AS VARCHAR), t, fold, n, s FROM h) GROUP BY ALL),
b AS (SELECT c, k, t, fold, coalesce(sum(n) OVER a, 0) - coalesce(sum(n) OVER o, 0) AS n, coalesce(sum(s) OVER a, 0) - coalesce(sum(s) OVER o, 0) AS s FROM e
      WINDOW a AS (PARTITION BY c, k ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), o AS (PARTITION BY c, k, fold ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
r AS (SELECT h.sale_id, h.item_id, h.vendor_id, h.n AS n_lines, h.s AS n_returned, b0.n AS n0, b0.s AS s0, b1.n AS n1, b1.s AS s1, b2.n AS n2, b2.s AS s2, b3.n AS n3, b3.s AS s3, bi.n AS item_n, bi.s AS si, bv.n AS vendor_n, bv.s AS sv, bc.n AS client_n, bc.s AS sc
      FROM h JOIN b b0 ON b0.c = 'all' AND b0.t = h.t AND b0.fold = h.fold JOIN b b1 ON b1.c = 'kind' AND b1.k = kind AND b1.t = h.t AND b1.fold = h.fold JOIN b b2 ON b2.c = 'nation' AND b2.k = nation AND b2.t = h.t AND b2.fold = h.fold
      JOIN b b3 ON b3.c = 'segment' AND b3.k = segment AND b3.t = h.t AND b3.fold = h.fold JOIN b bi ON bi.c = 'item' AND bi.k = CAST(item_id AS VARCHAR) AND bi.t = h.t AND bi.fold = h.fold
      JOIN b bv ON bv.c = 'vendor' AND bv.k = CAST(vendor_id AS VARCHAR) AND bv.t = h.t AND bv.fold = h.fold JOIN b bc ON bc.c = 'client' AND bc.k = CAST(client_id AS VARCHAR) AND bc.t = h.t AND bc.fold = h.fold),
p0 AS (SELECT *, CASE WHEN n0 < 1 THEN 500000 ELSE (1000000 * s0 + 50 * 500000) // (n0 + 50) END AS p FROM r),
p1 AS (SELECT *, CASE WHEN n1 < 1 THEN p ELSE (1000000 * s1 + 50 * p) // (n1 + 50) END AS pk, CASE WHEN n2 < 1 THEN p ELSE (1000000 * s2 + 50 * p) // (n2 + 50) END AS pn, CASE WHEN n3 < 1 THEN p ELSE (1000000 * s3 + 50 * p) // (n3 + 50) END AS ps FROM p0)
SELECT sale_id, item_id, vendor_id, n_lines, n_returned, CAST(item_n AS BIGINT) AS item_n, CAST(CASE WHEN item_n < 1 THEN pk ELSE (1000000 * si + 50 * pk) // (item_n + 50) END AS BIGINT) AS item_rate,
       CAST(vendor_n AS BIGINT) AS vendor_n, CAST(CASE WHEN vendor_n < 1 THEN pn ELSE (1000000 * sv + 50 * pn) // (vendor_n + 50) END AS BIGINT) AS vendor_rate,
       CAST(client_n AS BIGINT) AS client_n, CAST(CASE WHEN client_n < 1 THEN ps ELSE (1000000 * sc + 50 * ps) // (client_n + 50) END AS BIGINT) AS client_rate FROM p1
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- shares are dealt again and again among the sources that have not stopped
r AS (SELECT 0 AS step, source, source_size, weight, false AS stopped, CAST(0 AS DOUBLE) AS target FROM z
      UNION ALL
      SELECT step + 1, source, source_size, weight, stopped OR share >= 3 * source_size, CASE WHEN stopped OR share >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE share END
      FROM (SELECT *, CAST((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (stopped) OVER (), 0)) * weight AS DOUBLE) / sum(weight) FILTER (NOT stopped) OVER () AS share FROM r)
      WHERE step <= (SELECT count(*) FROM z)),
t AS (SELECT source, source_size, target, CAST(coalesce(floor(target / source_size * 4294967296), 0) AS HUGEINT) AS rate,
             CAST(('0x' || substr(md5('0:' || coalesce('=' || source, '')), 1, 8)) AS HUGEINT) AS off FROM r WHERE step = (SELECT max(step) FROM r)),
b AS (SELECT *, (size >> greatest(length(bin(size)) - 10, 0)) << greatest(length(bin(size)) - 10, 0) AS part, coalesce(substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), '') AS slot FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY part, slot, size, doc_id) AS k FROM b)
SELECT doc_id, size, source_size, target, CAST(c * size AS BIGINT) AS taken, CAST(c AS BIGINT) AS copies
FROM (SELECT k.*, source_size, target, (off + rate * k) // 4294967296 - (off + rate * (k - 1)) // 4294967296 AS c FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_target_encoding": OP11_SQL, "op13_mixing": OP13_SQL, "op9_url_filter": OP9_SQL, "op3_ngram_join": OP3_SQL}
