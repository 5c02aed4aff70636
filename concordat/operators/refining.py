"""Components split until no part holds two members that the matcher would refuse, whether or not a pass has met them.

What decides is a member's profile: class, brand, and the values of the attributes that can refuse. Members of one profile refuse the same
others and never each other, so first-fit placing puts them all where the first of them goes; a component is therefore folded into its
distinct profiles before a task sees it, and the parts come back to the members by a join. The task keeps, for each class and attribute,
an index of the parts' values: a text attribute has one value per part, a number the least and the largest. A profile is compared with all
parts at once, an attribute at a time; what a task holds grows with the profiles of one component, not with its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import COSMETIC, SCHEMA, UNCLASSIFIED, MaterialClass
from ..functions.columns import let
from ..functions.numbers import EXACT, parse_number
from .matching import specs

#: A value that can refuse: texts have ``text``; plain numbers low = high; ranges low < high; fit classes ``fit``.
VALUE = "array<struct<attr:string,percent:double,text:string,low:double,high:double,value:double,ranged:boolean,fit:string>>"


def values(class_code: Column, attrs: Column, schema: dict[str, MaterialClass] = SCHEMA) -> Column:
    """The values of a row that can refuse another of its class, in the order of the class's attributes."""
    def one(s: Column) -> Column:
        v = F.try_element_at(attrs, s["name"])
        read = lambda x: F.struct(
            s["name"].alias("attr"), s["percent"].alias("percent"), F.when(~s["numeric"], F.upper(F.trim(v))).alias("text"), x["low"].alias("low"), x["high"].alias("high"), x["value"].alias("value"),
            F.coalesce(x["is_range"], F.lit(False)).alias("ranged"), x["fit_class"].alias("fit"),
        )
        return let(parse_number(F.when(s["numeric"], v)), read)

    listed = F.transform(F.filter(F.try_element_at(specs(schema), class_code), lambda s: s["role"] != COSMETIC), one)
    known = F.filter(listed, lambda x: x["text"].isNotNull() | x["value"].isNotNull())
    return F.when(class_code != UNCLASSIFIED, F.coalesce(known, F.array().cast(VALUE))).otherwise(F.array().cast(VALUE))


class Bounds:
    """Of one number attribute: the least and the largest plain number of each part, and the parts that hold others."""

    def __init__(self) -> None:
        self.low, self.high = np.zeros(0), np.zeros(0)
        self.odd: dict[int, list] = {}

    def refused(self, v: dict, n: int, out: np.ndarray) -> None:
        """Marks the parts that hold a number which v refuses."""
        k = min(n, len(self.low))
        if v["fit"] is None and not v["ranged"]:
            x, share = v["value"], v["percent"] / 100
            for bound in (self.low[:k], self.high[:k]):
                with np.errstate(invalid="ignore"):
                    apart = np.abs(bound - x)
                    out[:k] |= (apart > EXACT) & (apart > share * np.maximum(np.abs(bound), abs(x)))  # nan refuses nothing
        elif v["fit"] is None:  # a range refuses the plain numbers outside it
            with np.errstate(invalid="ignore"):
                out[:k] |= (self.low[:k] < v["low"]) | (self.high[:k] > v["high"])
        for p, held in self.odd.items():
            if not out[p]:
                out[p] = any(refuse(v, w) for w in held)

    def add(self, v: dict, p: int) -> None:
        if v["fit"] is not None or v["ranged"]:
            held = self.odd.setdefault(p, [])
            if v not in held:
                held.append(v)
            return
        if p >= len(self.low):
            more = np.full(max(p + 1, 2 * len(self.low)) - len(self.low), np.nan)
            self.low, self.high = np.append(self.low, more), np.append(self.high, more)
        self.low[p], self.high[p] = np.fmin(self.low[p], v["value"]), np.fmax(self.high[p], v["value"])


def refuse(v: dict, w: dict) -> bool:
    """Two numbers of one attribute of which at least one is a range or a fit class."""
    if (v["fit"] is None) != (w["fit"] is None):
        return False
    if v["fit"] is not None:
        return v["fit"] != w["fit"]
    return not (v["low"] <= w["high"] and w["low"] <= v["high"])


class Parts:
    """The parts of one component, profile after profile."""

    def __init__(self) -> None:
        self.n = 0
        self.codes: dict[tuple, dict[str, int]] = {}
        self.texts: dict[tuple, np.ndarray] = {}  # -1: a part without a value
        self.numbers: dict[tuple, Bounds] = {}

    def place(self, class_code: str, brand: str | None, values: list[dict]) -> int:
        """The first part that holds nothing which the profile refuses; else a new one."""
        out = np.zeros(self.n, bool)
        texts = [(("brand",), brand)] if brand else []
        texts += [((class_code, v["attr"]), v["text"]) for v in values if v["text"] is not None]
        numbers = [((class_code, v["attr"]), v) for v in values if v["text"] is None]
        for key, text in texts:
            held = self.texts.get(key, np.zeros(0, np.int32))[: self.n]
            out[: len(held)] |= (held >= 0) & (held != self.codes.get(key, {}).get(text, -2))
        for key, v in numbers:
            if key in self.numbers:
                self.numbers[key].refused(v, self.n, out)
        p = int(np.argmin(out)) if self.n and not out.all() else self.n
        self.n = max(self.n, p + 1)
        for key, text in texts:
            codes, held = self.codes.setdefault(key, {}), self.texts.get(key, np.zeros(0, np.int32))
            if p >= len(held):
                held = self.texts[key] = np.append(held, np.full(max(p + 1, 2 * len(held)) - len(held), -1, np.int32))
            held[p] = codes.setdefault(text, len(codes))
        for key, v in numbers:
            self.numbers.setdefault(key, Bounds()).add(v, p)
        return p


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree) of distinct links (a, b), either way round."""
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def refine_items(members: DataFrame, items: DataFrame, links: DataFrame | None, schema: dict[str, MaterialClass] = SCHEMA) -> DataFrame:
    """(component, id, part): complete linkage on the whole refusal relation.

    Two members refuse each other if their brands are known and differ, or if they are of one class and an identity attribute
    mismatches or a rating is out of its band; a low score refuses nobody. Members are placed by their links, most first, then by id;
    each joins the first part that holds nobody it refuses. Components of fewer than three stay whole, as do those of one profile.

    members: component, id; items: id, class_code, attrs; links (a, b): the accepted pairs, or None if members have their ``degree``, which
    may then differ between components. Ids and components of any type; members without an item refuse nobody, repeated members count once.
    """
    ranked = members.select("component", "id", *(["degree"] if links is None else [])).distinct()
    brand = F.nullif(F.try_element_at("attrs", F.lit("brand")), F.lit(""))
    own = items.select("id", F.coalesce("class_code", F.lit(UNCLASSIFIED)).alias("class_code"), brand.alias("brand"), values(F.col("class_code"), F.col("attrs"), schema).alias("values"))
    ranked = ranked if links is None else ranked.join(degrees(links).hint("merge"), "id", "left")
    return refine_profiles(ranked, own)


def refine_profiles(ranked: DataFrame, own: DataFrame) -> DataFrame:
    """refine_items() of members (component, id, degree) by profiles (id, class_code, brand, values) that are known: VALUE tells what values hold."""
    members = ranked.select("component", "id")
    sized = members.groupBy("component").agg(F.count("*").alias("n")).where("n >= 3").select("component")
    known = ranked.join(sized.hint("merge"), "component", "left_semi").join(own.hint("merge"), "id", "left")
    known = known.withColumn("order", F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "id")).withColumn("profile", F.to_json(F.struct("class_code", "brand", "values")))
    folded = known.groupBy("component", "profile").agg(F.first("class_code").alias("class_code"), F.first("brand").alias("brand"), F.first("values").alias("values"), F.min("order").alias("order"))
    several = folded.groupBy("component").agg(F.count("*").alias("profiles")).where("profiles > 1").select("component")
    kind = T.StructType([members.schema["component"], folded.schema["profile"], T.StructField("part", T.IntegerType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, Parts()
        for rows in batches:  # in the order of components and places; a component may go on in the next batch
            out = []
            for component, class_code, brand, values in zip(rows["component"], rows["class_code"], rows["brand"], rows["values"], strict=True):
                if component != now:
                    now, parts = component, Parts()
                listed = [] if values is None else [v if isinstance(v, dict) else v.asDict() for v in values]
                out.append(parts.place(class_code or UNCLASSIFIED, brand or None, listed))
            yield pd.DataFrame({"component": rows["component"], "profile": rows["profile"], "part": out})

    dealt = folded.join(several.hint("merge"), "component", "left_semi").repartition("component").sortWithinPartitions("component", "order.d", "order.id")
    placed = dealt.select("component", "profile", "class_code", "brand", "values").mapInPandas(place, kind)
    torn = known.select("component", "id", "profile").join(placed.hint("merge"), ["component", "profile"]).select("component", "id", "part")
    return members.join(torn.hint("merge"), ["component", "id"], "left").select("component", "id", F.coalesce("part", F.lit(0)).alias("part"))
