"""Queries that are DataFrame programs rather than one statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, numbers
from ..functions.normalise import normal_text
from ..operators import blocking, graph, refining
from ..session import ship
from ..storage import spread
from ..streaming import incremental
from .roles import with_roles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def described(name: str, brand: str, kind: str, size: str) -> Column:
    return F.concat_ws(" ", name, brand, kind, F.concat(F.lit("SIZE "), F.col(size).cast("string")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    return p.select(F.col("p_partkey").alias("item"), described("p_name", "p_brand", "p_type", "p_size").alias("description"), F.col("p_name").alias("name"), F.col("p_type").alias("class"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size_mm"), F.col("p_retailprice").alias("price"))


def size_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one class and brand whose sizes follow each other within one hang together: each part on the least of its size, and that one
    on the least of the size before. There are as many links as parts, not as pairs of them."""
    i = items(spark, sf_dir).select("class", "brand", F.col("size_mm").alias("size"), "item").dropna()
    heads = i.groupBy("class", "brand", "size").agg(F.min("item").alias("a"))
    same = i.join(heads.hint("merge"), ["class", "brand", "size"]).select("a", F.col("item").alias("b")).where("a < b")
    after = heads.withColumn("size", F.col("size") - 1).withColumnRenamed("a", "b")
    return same.unionByName(heads.join(after.hint("merge"), ["class", "brand", "size"]).select("a", "b"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(items(spark, sf_dir).select(F.col("item").alias("id")), size_links(spark, sf_dir)).select(F.col("id").alias("item"), "component")


KEYS = {"block_exact_key": ("class", "brand", "name"), "block_class_band": ("class", "size_mm"), "block_identity": ("class", "brand", "size_mm")}


def key_pairs(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    """All pairs of parts alike in the columns; a hot key is cut into blocks, and no key is left out."""
    rows = items(spark, sf_dir).select(F.lit("key").alias("pass"), F.to_json(F.struct(*columns)).alias("key"), F.col("item").alias("id"))
    return blocking.candidate_pairs(rows, None).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"))


def block_exact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_pairs(spark, sf_dir, KEYS["block_exact_key"])


def block_class_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_pairs(spark, sf_dir, KEYS["block_class_band"])


def block_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_pairs(spark, sf_dir, KEYS["block_identity"])


def refine_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components split until no part holds two prices of which one is less than half the other. What decides is a member's price, so a
    component is folded into its distinct prices; a part is known by the least and the largest of its own. Prices are positive."""
    found = connected_components(spark, sf_dir).select("component", F.col("item").alias("id"))
    return split_by_price(found, items(spark, sf_dir).select(F.col("item").alias("id"), "price"))


def split_by_price(members: DataFrame, prices: DataFrame) -> DataFrame:
    """(component, id, part) of members (component, id) with prices (id, price); an unknown price refuses nobody."""
    price = F.col("price")
    value = F.struct(F.lit("price").alias("attr"), F.lit(50.0).alias("percent"), F.lit(None).cast("string").alias("text"), price.alias("low"), price.alias("high"), price.alias("value"), F.lit(False).alias("ranged"), F.lit(None).cast("string").alias("fit"))
    values = F.when(price.isNull(), F.array().cast(refining.VALUE)).otherwise(F.array(value).cast(refining.VALUE))
    own = prices.select("id", F.lit("part").alias("class_code"), F.lit(None).cast("string").alias("brand"), values.alias("values"))
    return refining.refine_profiles(members.withColumn("degree", F.lit(0).cast("long")), own)


def scored(pairs: DataFrame) -> DataFrame:
    """Evidence score and verdict of pairs (text_a, text_b, matched, compared, vetoes, other_maker, anchor): 0.34 token-set ratio
    + 0.42 agreement, over the weights of the signals that a pair has. The semantic signal (0.24) is missing: no embeddings."""
    return evidence(pairs).select("item_a", "item_b", "fuzzy", "agreement", "score", "verdict")


def evidence(pairs: DataFrame) -> DataFrame:
    """What scored() tells, beside the other columns of the pairs or of groups of them."""
    p = pairs.withColumn("fuzzy", kernels.similarity(F.col("text_a"), F.col("text_b"))).withColumn("agreement", F.try_divide(F.col("matched").cast("double"), F.col("compared")))
    p = p.withColumn("score", F.when(F.col("agreement").isNull(), F.col("fuzzy")).otherwise((0.34 * F.col("fuzzy") + 0.42 * F.col("agreement")) / 0.76))
    conf = F.when(F.col("anchor"), F.least(F.lit(1.0), 0.74 + 0.26 * F.col("score"))).otherwise(F.col("score"))
    verdict = F.when((F.col("vetoes") > 0) & F.col("anchor"), "conflict").when((F.col("vetoes") > 0) | F.col("other_maker"), "distinct").when(conf >= 0.86, "duplicate").when(conf >= 0.45, "review").otherwise("distinct")
    return p.withColumn("verdict", verdict)


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", normal_text("text").alias("norm"))
    return docs.select("doc_id", F.sha2("norm", 256).alias("norm_hash"), F.length("norm").cast("long").alias("norm_length"))


def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, mixed fractions, ranges, tolerances and plain numbers, made from the parts' sizes."""
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 5 == 0, F.concat(s, F.lit(" 1/2"))).when(F.col("p_size") % 5 == 1, F.concat(s, F.lit(" to "), (F.col("p_size") + 3).cast("string"))).when(F.col("p_size") % 5 == 2, F.concat(F.lit("1,"), F.lpad(s, 3, "0"))).when(F.col("p_size") % 5 == 3, F.concat(s, F.lit("/4"))).otherwise(F.concat(s, F.lit(" +/- 0.5")))
    read = table(spark, sf_dir, "part").select("p_partkey", numbers.parse_number(text).alias("n"))
    kind = F.when(F.col("n.is_range"), "range").when(F.col("n.tolerance").isNotNull(), "tolerance").otherwise("point")
    return read.select("p_partkey", F.col("n.value").alias("value"), F.col("n.low").alias("low"), F.col("n.high").alias("high"), kind.alias("kind"))


def ext_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf_dir, "events"), "2 hours", "1 hour")


def queries():
    return {f.__name__: f for f in (block_exact_key, block_class_band, block_identity, connected_components, refine_components, normalize_text, parse_number, ext_sliding)}


def oracle_sql():
    components = with_roles("""WITH RECURSIVE e AS (SELECT a.item AS x, b.item AS y FROM items a JOIN items b ON a.class = b.class AND a.brand = b.brand AND a.item <> b.item AND abs(a.size_mm - b.size_mm) <= 1),
        c AS (SELECT item AS x, item AS y FROM items UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x) SELECT x AS item, MIN(y) AS component FROM c GROUP BY x""")
    alike = lambda columns: with_roles(f"SELECT a.item AS item_a, b.item AS item_b FROM items a JOIN items b ON {' AND '.join(f'a.{c} = b.{c}' for c in columns)} AND a.item < b.item")
    return {name: alike(columns) for name, columns in KEYS.items()} | {
        "connected_components": components.replace("WITH items AS", "WITH RECURSIVE items AS").replace(", RECURSIVE e AS", ", e AS"),
        "parse_number": """SELECT p_partkey, v AS value, CASE k WHEN 1 THEN v - 1.5E0 WHEN 4 THEN v - 0.5E0 ELSE v END AS low, CASE k WHEN 1 THEN v + 1.5E0 WHEN 4 THEN v + 0.5E0 ELSE v END AS high, CASE k WHEN 1 THEN 'range' WHEN 4 THEN 'tolerance' ELSE 'point' END AS kind
            FROM (SELECT p_partkey, p_size % 5 AS k, CASE p_size % 5 WHEN 0 THEN p_size + 0.5E0 WHEN 1 THEN (2 * p_size + 3) / 2.0E0 WHEN 2 THEN 1000.0E0 + p_size WHEN 3 THEN p_size / 4.0E0 ELSE CAST(p_size AS DOUBLE) END AS v FROM part)""",
        "ext_sliding": """WITH e AS (SELECT ts, event_type FROM events WHERE ts IS NOT NULL), w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS s, event_type FROM e, (VALUES (0), (1)) t(k))
            SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n FROM w GROUP BY s, event_type""",
    }
