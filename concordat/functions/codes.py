"""Check digits and codes: GTIN, part numbers, material codes with a Damm digit. Column expressions and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import col, group

# The totally anti-symmetric quasigroup of order 10 that Damm published in 2004, row by row.
DAMM = "0317598642 7092154863 4206871359 1750983426 6123045978 3674209581 5869720134 8945362017 9438617205 2581436790".split()
CODE = r"^([A-Z]{4})-(\d{3})-(\d{6})-(\d)$"
SERIALS = 999_999


def digits_of(text: Column) -> Column:
    """Digits, and letters as their place in the alphabet mod 10; nothing else counts."""
    kept = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    one = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.pmod(F.ascii(c) - 65, F.lit(10)))
    return F.transform(F.filter(F.split(kept, ""), lambda c: c != ""), one)


def damm(text: Column | str) -> Column:
    """The check digit of a code's body; 0 for a body that ends in its own check digit."""
    table = F.lit("".join(DAMM))
    step = lambda state, d: F.substring(table, state * 10 + d + 1, F.lit(1)).cast("int")
    return F.aggregate(digits_of(col(text)), F.lit(0), step)


def material_code(family: Column, segment: Column, serial: Column) -> Column:
    """LLLL-DDD-DDDDDD-D; null where a part is out of form or range."""
    f, n = F.upper(family), F.lpad(serial.cast("string"), 6, "0")
    ok = f.rlike("^[A-Z]{4}$") & segment.rlike(r"^\d{3}$") & serial.between(0, SERIALS)
    return F.when(ok, F.concat_ws("-", f, segment, n, damm(F.concat(f, segment, n)).cast("string")))


def code_parts(code: Column | str) -> Column:
    """struct<family, segment, serial, valid>; null parts for what is no code."""
    c = F.upper(F.trim(col(code)))
    body = F.concat(*(group(c, CODE, k) for k in (1, 2, 3)))
    valid = F.coalesce(damm(body).cast("string") == group(c, CODE, 4), F.lit(False))
    return F.struct(group(c, CODE, 1).alias("family"), group(c, CODE, 2).alias("segment"), group(c, CODE, 3).cast("int").alias("serial"), valid.alias("valid"))


def gtin(text: Column | str) -> Column:
    """The digits of a valid GTIN-8, -12, -13 or -14, else null."""
    d = F.regexp_replace(col(text), r"\D", "")
    right = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    weighed = F.aggregate(F.transform(right, lambda c, i: c.cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d).isin(8, 12, 13, 14) & (weighed % 10 == 0), d)


def part_number(text: Column | str) -> Column:
    """Capitals and digits only; null if fewer than four, which tell nothing apart."""
    t = F.regexp_replace(F.upper(col(text)), "[^A-Z0-9]", "")
    return F.when(F.length(t) >= 4, t)


def issue_serials(wanted: DataFrame, issued: DataFrame) -> DataFrame:
    """(family, request, serial): the lowest unused serials of each family, in the order of the requests.

    wanted: family, request; issued: family, serial. Free serials are the gaps between issued ones and what follows the last;
    only as many are made as a family asks for.
    """
    asks = wanted.withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy("request")))
    need = asks.groupBy("family").agg(F.max("k").cast("int").alias("need"))
    by_serial = Window.partitionBy("family").orderBy("serial")
    used = issued.where(F.col("serial") > 0).select("family", F.col("serial").cast("int").alias("serial")).distinct()
    edges = used.unionByName(need.select("family", F.lit(0).alias("serial"))).withColumn("next", F.lead("serial").over(by_serial)).join(need, "family")
    free = edges.select("family", "need", (F.col("serial") + 1).alias("low"), F.least(F.coalesce(F.col("next") - 1, F.lit(SERIALS)), F.col("serial") + F.col("need")).alias("high")).where("low <= high")
    # a gap starts after as many free serials as the gaps before it hold
    before = Window.partitionBy("family").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    free = free.withColumn("before", F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(before), F.lit(0))).where("before < need")
    found = free.select("family", F.posexplode(F.sequence("low", "high")).alias("i", "serial"), "before").withColumn("k", (F.col("before") + F.col("i") + 1).cast("int"))
    return asks.join(found, ["family", "k"], "left").select("family", "request", "serial")


def issue_codes(wanted: DataFrame, issued: DataFrame) -> DataFrame:
    """(request, family, segment, code) for requests (family, segment, request) that have no code yet; codes are never given
    again. issued: request, family, serial. A family whose serials are used up gives null."""
    fresh = wanted.join(issued.select("request"), "request", "left_anti")
    serials = issue_serials(fresh, issued)
    return fresh.join(serials, ["family", "request"]).select("request", "family", "segment", material_code(F.col("family"), F.col("segment"), F.col("serial")).alias("code"))
