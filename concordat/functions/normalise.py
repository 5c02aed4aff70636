"""Normalised catalogue texts, units and pack sizes as Column expressions.

Order of a row: compatibility form, Hindi words, transliteration, upper case, pack phrase out, separators, abbreviations. Only
the compatibility form and the transliteration leave the JVM, in one Arrow kernel that receives the rows with characters
beyond ASCII and nulls for all others.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordlists as W
from .columns import col, group, let, lookup, words

SEPARATORS, DASHES, SPACES = r"[,;:|()\[\]{}\"'`~]+", r"(?<=\s)-+(?=\s)|(?<=\s)-+$|^-+(?=\s)", r"\s+"
BOX = "(?:" + "|".join(sorted(W.CONTAINERS, key=lambda w: (-len(w), w))) + ")"
HOLDS = "(?:" + "|".join(sorted(W.COUNTED, key=lambda w: (-len(w), w))) + ")"
PACKS = (rf"\b{BOX}\s*(?:OF|-|:)?\s*(\d{{1,6}})\b", rf"\b(\d{{1,6}})\s*{HOLDS}?\s*(?:/|PER)\s*{BOX}\b")


def romanised(text: str) -> str:
    """Devanagari in Latin letters, by one pass that holds back the vowel a consonant carries."""
    out, pending = [], False  # pending: the last letter is a consonant whose own vowel isn't settled
    chars = unicodedata.normalize("NFC", text)
    for k, c in enumerate(chars):
        if c == W.NUKTA:
            continue
        if c == W.HALANT or c in W.VOWEL_SIGNS:
            if pending and c != W.HALANT:
                out.append(W.VOWEL_SIGNS[c])
            pending = False
            continue
        if pending:
            out.append("A")
        dotted = chars[k + 1 : k + 2] == W.NUKTA and c in W.WITH_NUKTA
        pending = c in W.CONSONANTS
        if pending:
            out.append(W.WITH_NUKTA[c] if dotted else W.CONSONANTS[c])
        elif 0 <= ord(c) - W.FIRST_DIGIT < 10:
            out.append(str(ord(c) - W.FIRST_DIGIT))
        else:
            out.append(W.VOWELS.get(c) or W.NASALS.get(c) or c)
    return "".join(out) + ("A" if pending else "")


def latin(text: str, hindi: Mapping[str, str] = W.HINDI) -> str:
    s = unicodedata.normalize("NFKC", text)
    if any("ऀ" <= c <= "ॿ" for c in s):
        for word in sorted(hindi, key=len, reverse=True):
            s = s.replace(unicodedata.normalize("NFKC", word), f" {hindi[word]} ")
        s = romanised(s)
    return s


def latin_text(text: Column | str, hindi: Mapping[str, str] = W.HINDI) -> Column:
    """Compatibility form in Latin letters. ASCII rows never leave the JVM."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if t is None else latin(t, hindi) for t in a.to_pylist()], pa.string())

    text = col(text)
    return F.coalesce(F.arrow_udf(run, T.StringType())(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def has_devanagari(text: Column | str) -> Column:
    return col(text).rlike("[\\u0900-\\u097f]")


def language(text: Column | str) -> Column:
    """hi or en, by script."""
    return F.when(has_devanagari(text), "hi").otherwise("en")


def pack_quantity(text: Column | str) -> tuple[Column, Column]:
    """(quantity or null, the text without the phrase): a container and a number, else a number per container."""
    t = col(text)
    n = [group(t, p).cast("double") for p in PACKS]
    rest = [F.regexp_replace(t, rf"(?s)^(.*?){p}(.*)$", "$1 $3") for p in PACKS]
    return F.when(n[0] > 0, n[0]).when(n[1] > 0, n[1]), F.when(n[0] > 0, rest[0]).when(n[1] > 0, rest[1]).otherwise(t)


def base_unit(uom: Column | str, pack: Column) -> tuple[Column, Column]:
    """(base unit, units per pack). A container whose content is known counts in pieces; else it stays what it is."""
    word = F.upper(F.trim(col(uom)))
    known, boxed = lookup(word, W.UOM), word.isin(W.CONTAINERS)
    unit = F.when(word.isNull() | (word == ""), F.lit(None)).when(known.isNotNull(), known).when(boxed & pack.isNotNull(), "EA").otherwise(word)
    return unit, F.when(boxed & known.isNull() & pack.isNull(), 1.0).otherwise(F.coalesce(pack, F.lit(1.0)))


def flattened(text: Column) -> Column:
    """Separators and lone dashes out, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SEPARATORS, " "), DASHES, " "), SPACES, " "))


def expanded(text: Column, house: Column | None = None, table: Mapping[str, str] = W.ABBREVIATIONS) -> Column:
    """Whole words replaced by what they stand for: the house's word (a map column) before the table's. A closing dot does not
    count, unless the word is a number."""

    def one(w: Column) -> Column:
        key = F.when(w.rlike(r"^[\d.]*\.$") & w.rlike(r"\d"), w).otherwise(F.regexp_replace(w, r"\.+$", ""))
        found = lookup(key, table)
        return F.coalesce(*([F.try_element_at(house, key)] if house is not None else []), found, w)

    return F.trim(F.regexp_replace(F.array_join(F.transform(F.split(text, " "), one), " "), SPACES, " "))


def normal_text(text: Column | str, house: Column | None = None) -> Column:
    """A description without its pack phrase taken out, as displays and tests use it."""
    return expanded(flattened(F.upper(latin_text(F.coalesce(col(text), F.lit(""))))), house)


def normalise_rows(rows: DataFrame, text_col: str = "description", uom_col: str | None = "uom", house: DataFrame | None = None, company_col: str = "company") -> DataFrame:
    """``rows`` with norm_text, norm_hash, lang, uom_base and pack_qty. house: company and its words, from house_words()."""
    upper = rows.withColumn("_upper", F.upper(latin_text(F.coalesce(F.col(text_col), F.lit("")))))
    pack, rest = pack_quantity("_upper")
    unit, qty = base_unit(uom_col, pack) if uom_col else (F.lit(None).cast("string"), F.coalesce(pack, F.lit(1.0)))
    if house is not None:
        own = house.where("company is not null").select(F.col("company").alias("_company"), F.col("words").alias("_own"))
        shared = house.where("company is null").select(F.col("words").alias("_shared"))  # one row at most
        upper = upper.join(own, F.col(company_col) == F.col("_company"), "left").join(F.broadcast(shared), how="left").withColumn("_words", F.coalesce("_own", "_shared"))
    flat = upper.select(*rows.columns, *(["_words"] if house is not None else []), flattened(rest).alias("_flat"), language(F.coalesce(F.col(text_col), F.lit(""))).alias("lang"), unit.alias("uom_base"), qty.alias("pack_qty"))
    norm = flat.withColumn("norm_text", expanded(F.col("_flat"), F.col("_words") if house is not None else None))
    return norm.select(*rows.columns, "norm_text", F.sha2("norm_text", 256).alias("norm_hash"), "lang", "uom_base", "pack_qty")


def house_words(entries: DataFrame) -> DataFrame:
    """(company, words) of active entries (company or null for all, word, meaning, active): a company's own words on top of those that
    all share. The row of no company has the shared words, which hold for every company that has none of its own, and for rows without
    a company."""
    live = entries.where("active").select("company", F.upper("word").alias("word"), "meaning")
    companies = live.where("company is not null").select("company").distinct()
    every = live.where("company is not null").withColumn("rank", F.lit(1)).unionByName(live.where("company is null").drop("company").crossJoin(F.broadcast(companies)).withColumn("rank", F.lit(0)))
    every = every.unionByName(live.where("company is null").withColumn("rank", F.lit(0)))
    best = every.groupBy("company", "word").agg(F.max_by("meaning", F.struct("rank", "meaning")).alias("meaning"))
    return best.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("word", "meaning"))).alias("words"))


def content_tokens(text: Column | str, stop: list[str] = W.BLOCK_STOPWORDS, least: int = 3) -> Column:
    """Distinct words worth blocking on."""
    found = F.regexp_extract_all(F.upper(col(text)), F.lit(r"[A-Z0-9][A-Z0-9./-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~F.array_contains(words(stop), w)))


def vendor_key(name: Column | str) -> Column:
    """What groups a vendor's spellings: upper case, no punctuation, no legal forms, one spelling a word, one name a group."""
    t = F.replace(F.upper(F.coalesce(col(name), F.lit(""))), F.lit("&"), F.lit(" & "))
    t = F.regexp_replace(F.regexp_replace(t, r"^\s*M/S\.?\s+", " "), r"(?U)[^\w& ]+", " ")
    tokens = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    folded = F.transform(tokens, lambda w: F.coalesce(lookup(w, W.VENDOR_WORDS), w))
    key = F.array_join(F.filter(folded, lambda w: ~F.array_contains(words(W.LEGAL_FORMS), w)), " ")
    return F.coalesce(lookup(key, W.VENDOR_GROUPS), key)


def vendor_names(vendors: DataFrame, name_col: str = "name") -> DataFrame:
    """(vendor_key, display): the spelling met most often, of equals the first in order."""
    counts = vendors.select(vendor_key(name_col).alias("vendor_key"), F.trim(F.col(name_col)).alias("name")).where("vendor_key <> ''").groupBy("vendor_key", "name").agg(F.count("*").alias("n"))
    return counts.groupBy("vendor_key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("display"))


#: Pieces this short are joined to a neighbouring numeral; letters of a run before digits that are a word of their own (fixed values).
FRAGMENT, RUN = 2, 5


def repaired(text: Column | str, vocabulary: list[str]) -> Column:
    """A marking as a reader of plates damages it, mended: halves of a numeral joined, O, I and l beside a digit read as digits, long
    words parted from digits that follow, run-together words of the vocabulary parted."""
    tokens = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")

    def join(state: Column, w: Column) -> Column:
        last = F.element_at(state["done"], -1)
        halves = (F.size(state["done"]) > 0) & state["open"] & F.coalesce(last, F.lit("")).rlike(r"\d$") & w.rlike(r"^\d") & ((F.length(last) <= FRAGMENT) | (F.length(w) <= FRAGMENT))
        whole = F.concat(F.slice(state["done"], 1, F.greatest(F.size(state["done"]) - 1, F.lit(0))), F.array(F.concat(last, w)))
        return F.struct(F.when(halves, whole).otherwise(F.concat(state["done"], F.array(w))).alias("done"), (~halves).alias("open"))

    joined = F.aggregate(tokens, F.struct(F.array().cast("array<string>").alias("done"), F.lit(True).alias("open")), join, lambda s: s["done"])

    def read(w: Column) -> Column:
        def step(out: Column, i: Column) -> Column:
            c = F.substring(w, i, F.lit(1))
            beside = out.rlike(r"\d$") | F.substring(w, i + 1, F.lit(1)).rlike(r"\d")
            return F.concat(out, F.when(beside & (c == "O"), "0").when(beside & c.isin("I", "l"), "1").otherwise(c))

        return F.when(w.rlike(r"\d"), F.aggregate(F.sequence(F.lit(1), F.length(w)), F.lit(""), step)).otherwise(w)

    def part(w: Column) -> Column:
        edges = r"^([^A-Za-z]*)(.*?)([^A-Za-z]*)$"
        core, known = F.regexp_extract(w, edges, 2), words(vocabulary)
        cuts = F.filter(F.sequence(F.lit(3), F.length(core) - 3), lambda k: F.array_contains(known, F.substring(core, F.lit(1), k)) & F.array_contains(known, F.substring(core, k + 1, F.length(core))))
        may = (F.length(core) >= 6) & core.rlike("^[A-Za-z]+$") & ~F.array_contains(known, core)
        two = let(F.get(cuts, F.lit(0)), lambda k: F.concat(F.regexp_extract(w, edges, 1), F.substring(core, F.lit(1), k), F.lit(" "), F.substring(core, k + 1, F.length(core)), F.regexp_extract(w, edges, 3)))
        return F.when(may, F.coalesce(two, w)).otherwise(w)

    clear = F.split(F.array_join(F.transform(joined, lambda w: F.regexp_replace(read(w), rf"(?<=[A-Z]{{{RUN}}})(?=\d)", " ")), " "), " ")
    return F.array_join(F.transform(clear, part), " ")
