"""Column helpers that the function modules share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(texts: Sequence[str]) -> Column:
    """A constant array of strings."""
    return F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>")


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """table[key], null where it has none. Large tables are searched by first character, then within it."""
    if not table:
        return F.lit(None).cast("string")
    by_first: dict[str, dict] = {}
    for k, v in table.items():
        by_first.setdefault(k[:1], {})[k] = v
    inner = {c: F.create_map(*(F.lit(x) for kv in t.items() for x in kv)) for c, t in by_first.items()}
    if len(table) <= 32:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    nested = F.create_map(*(x for c, t in inner.items() for x in (F.lit(c), t)))
    return F.try_element_at(F.try_element_at(nested, F.substring(key, 1, 1)), key)


def quoted(text: str) -> str:
    """A literal text within a Java pattern."""
    return "".join(f"\\{c}" if not c.isalnum() and c not in " _" and ord(c) < 128 else c for c in text)


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"\b{quoted(word)}\b")


def group(text: Column, pattern: str, k: int = 1) -> Column:
    """A group of the first match; null where nothing, or an empty group, matches."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def first_group(text: Column, pattern: str, groups: int) -> Column:
    """The first group of an alternation that matched."""
    return F.coalesce(*(group(text, pattern, k) for k in range(1, groups + 1)))


def plain_number(x: Column) -> Column:
    """A double as catalogues print it: whole numbers without a point, at most four decimals, no trailing zeros."""
    fixed = F.regexp_replace(F.format_string("%.4f", F.round(x, 4)), r"\.?0+$", "")
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x == F.floor(x), F.floor(x).cast("string")).otherwise(fixed)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions read instead of computing them again: a generator of one row keeps the optimizer from
    putting the expressions where the names stand."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    kept = [c for c in df.columns if c not in columns]
    out = df.select(*kept, F.explode(F.array(made)).alias("_held"))
    return out.select(*kept, *(F.col(f"_held.{n}").alias(n) for n in columns))
