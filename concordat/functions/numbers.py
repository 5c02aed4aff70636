"""Numbers as catalogues write them, units, tolerances and value keys, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W
from .columns import col, group, let, lookup

#: One number, signed, with thousands commas or a bare fraction part.
NUMBER = r"(?:[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|[-+]?\.\d+)"
FIT, PLAIN = r"^[A-Za-z]{1,2}\d{1,2}$", rf"^({NUMBER})$"
TOLERANCE = rf"^({NUMBER})\s*(?:±|\+/-|\+-)\s*({NUMBER})$"
RANGE = rf"(?i)^({NUMBER})\s*(?:to|\.\.|~|—|–)\s*({NUMBER})$"
MIXED, FRACTION = rf"^({NUMBER})[\s-](\d+)\s*/\s*(\d+)$", r"^(\d+)\s*/\s*(\d+)$"
#: Number forms within a text, the longest first.
WITHIN = (rf"{NUMBER}\s*(?:±|\+/-|\+-)\s*{NUMBER}", rf"(?i){NUMBER}\s*(?:to|\.\.|~)\s*{NUMBER}", rf"{NUMBER}[\s-]\d+\s*/\s*\d+", r"\d+\s*/\s*\d+", NUMBER)
EXACT = 1e-6


def read(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def span(value: Column, low: Column, high: Column, ranged: bool = False, tolerance: Column | None = None, fit: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(value.alias("value"), low.alias("low"), high.alias("high"), F.lit(ranged).alias("is_range"), (none.cast("double") if tolerance is None else tolerance).alias("tolerance"), (none.cast("string") if fit is None else fit).alias("fit_class"))


def parse_number(text: Column | str) -> Column:
    """struct<value, low, high, is_range, tolerance, fit_class>, null if the text is no number: a fit class, a tolerance, a range
    (its middle is the value), a mixed fraction, a fraction, or a plain number; a zero denominator makes no number."""
    return let(F.trim(col(text)), parse_trimmed)


def parse_trimmed(s: Column) -> Column:
    part = lambda p, k: read(group(s, p, k))
    a, b, t = part(RANGE, 1), part(RANGE, 2), F.abs(part(TOLERANCE, 2))
    whole, share = part(MIXED, 1), F.try_divide(part(MIXED, 2), part(MIXED, 3))
    mixed = whole + F.when(whole < 0, -share).otherwise(share)
    ratio, plain, mid = F.try_divide(part(FRACTION, 1), part(FRACTION, 2)), part(PLAIN, 1), part(TOLERANCE, 1)
    zero = F.lit(0.0)
    point = lambda x: F.when(x.isNotNull(), span(x, x, x))
    return (
        F.when(s.rlike(FIT), span(zero, zero, zero, fit=F.upper(s)))
        .when(s.rlike(TOLERANCE), span(mid, mid - t, mid + t, tolerance=t))
        .when(s.rlike(RANGE), span((a + b) / 2, F.least(a, b), F.greatest(a, b), ranged=True))
        .when(s.rlike(MIXED), point(mixed)).when(s.rlike(FRACTION), point(ratio)).when(s.rlike(PLAIN), point(plain))
    )


def find_number(text: Column | str) -> Column:
    """The first number in a text, of the longest form it has (a fraction over zero is none)."""
    found = [group(col(text), p, 0) for p in WITHIN]
    return parse_number(F.coalesce(*(F.when(~f.rlike(r"/\s*0+$"), f) for f in found)))


def unit_name(unit: Column | str, names: Mapping[str, str] = W.UNIT_NAMES) -> Column:
    return lookup(F.replace(F.lower(F.trim(col(unit))), F.lit("."), F.lit("")), names)


def convert(value: Column, source: Column, target: Column) -> Column:
    """value in another unit; null if the units can't be compared. No unit on either side changes nothing."""
    src, dst = F.coalesce(unit_name(source), source), F.coalesce(unit_name(target), target)
    base = lambda u: lookup(u, {k: b for k, (b, _) in W.TO_BASE.items()})
    factor = lambda u: lookup(u, {k: f for k, (_, f) in W.TO_BASE.items()})
    same = source.isNull() | target.isNull() | (src == dst)
    return (
        F.when(same, value).when(base(src) == base(dst), value * factor(src) / factor(dst))
        .when((src == "degC") & (dst == "degF"), value * 9 / 5 + 32).when((src == "degF") & (dst == "degC"), (value - 32) * 5 / 9)
    )


def in_unit(number: Column, source: Column, target: Column) -> Column:
    """A parse_number() struct in another unit; a tolerance is a width, so an offset scale shifts it not."""
    to = lambda x: convert(x, source, target)
    width = F.abs(to(number["tolerance"]) - to(F.lit(0.0)))
    return F.struct(to(number["value"]).alias("value"), to(number["low"]).alias("low"), to(number["high"]).alias("high"), number["is_range"].alias("is_range"), width.alias("tolerance"), number["fit_class"].alias("fit_class"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["low"] <= b["high"]) & (b["low"] <= a["high"])


def base_price(price: Column, pack: Column) -> Column:
    return price / F.greatest(F.coalesce(pack, F.lit(1.0)), F.lit(1.0))


def base_quantity(quantity: Column, pack: Column) -> Column:
    return quantity * F.greatest(F.coalesce(pack, F.lit(1.0)), F.lit(1.0))


def value_key(value: Column) -> Column:
    """A value as one text whatever its spelling: truth in capitals, numbers whole or rounded to six places, else upper case."""
    t = F.trim(value.cast("string"))
    x = t.try_cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    number = F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""))
    return F.when(finite, number).otherwise(F.upper(t))


def values_equal(a: Column, b: Column) -> Column:
    """Equal as numbers, fit classes or texts; null equals null."""
    def judge(v: Column) -> Column:
        x, y = v["x"], v["y"]
        fits = F.coalesce(x["fit_class"], F.lit("")) == F.coalesce(y["fit_class"], F.lit(""))
        numbers = fits & (F.abs(x["value"] - y["value"]) <= EXACT)
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNotNull() & y.isNotNull(), numbers).otherwise(F.upper(F.trim(a)) == F.upper(F.trim(b)))

    return let(F.struct(parse_number(a).alias("x"), parse_number(b).alias("y")), judge)


def allowed(a: Column, b: Column, tolerance: Column, percent: Column) -> Column:
    """The difference two values may have: a share of the larger magnitude, else the absolute tolerance, else none."""
    return F.coalesce(percent / 100 * F.greatest(F.abs(a), F.abs(b)), tolerance, F.lit(0.0))


def rating(value: Column, mean: Column, spread: Column) -> Column:
    """(value - mean) / spread, 0 where the value is missing."""
    return F.coalesce(F.try_divide(value - mean, spread), F.lit(0.0))


def logistic(z: Column) -> Column:
    z = F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))
    return 1 / (1 + F.exp(-z))


def figures(text: Column | str) -> Column:
    """Numbers of a sentence, without commas and a closing dot."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))
