"""Catalogue files in and out: CSV and spreadsheets, header mapping, long texts, validation with rejects, load files, stores."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalise import normalise_rows
from ..operators.extraction import extract_rows
from ..storage import open_fs

#: Bytes that a single uploaded file may have (fixed value).
MOST_BYTES = 64 << 20
#: Spark reads no windows-1252, but its near relative; the 32 characters in which they differ are put right after.
WINDOWS, NEAR = "windows-1252", "ISO-8859-1"
HIGH = "".join(map(chr, range(0x80, 0xA0))), bytes(range(0x80, 0xA0)).decode("cp1252", "replace")

# Header spellings per field, in the order in which they are tried; case, "-" and "_" don't count.
HEADERS = """
code: legacy_code, material_code, material, matnr, code, item_code, material number, material no, sap code, part code
description: description, material_description, desc, maktx, item_description, long text, short text, material text
uom: uom, unit, unit_of_measure, meins, base uom, uom_code
plant: plant, werks, location, site, store
price: price, unit_price, rate, value, moving average price, map
qty_on_hand: qty_on_hand, qty, quantity, stock, on_hand, labst
"""
LONG_TEXT = "long text, ltext, tdline, text, purchase order text"


def folded(header: str) -> str:
    return re.sub(r"[-_]", " ", header.strip().lower())


def spellings(text: str = HEADERS) -> dict[str, list[str]]:
    lines = (line.split(":", 1) for line in text.strip().splitlines())
    return {field.strip(): [folded(a) for a in names.split(",")] for field, names in lines}


def bounded(path: str, most: int = MOST_BYTES) -> bytes:
    """A file's bytes, read in pieces; a larger file is refused before it is held."""
    store, name = open_fs(path)
    out = bytearray()
    with store.open_input_stream(name) as f:
        while piece := f.read(1 << 20):
            out += piece
            if len(out) > most:
                raise ValueError(f"{path} has more than {most} bytes")
    return bytes(out)


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8, or windows-1252 if any line of the file, or of the folder's files, is no UTF-8. Lines are looked at where they lie."""
    return WINDOWS if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """All columns as strings, header first, quoted line breaks allowed; the encoding is told from the whole file unless given."""
    found = encoding or encoding_of(spark, path)
    df = spark.read.csv(path, header=True, inferSchema=False, encoding=NEAR if found == WINDOWS else found, multiLine=True, escape='"')
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    if found == WINDOWS:
        df = df.select(*(F.translate(F.col(f"`{c}`"), *HIGH).alias(c) for c in df.columns))
        names = [c.translate(str.maketrans(*HIGH)) for c in names]
    return df.toDF(*names)


def sheet_rows(data: bytes, sheet: int = 0) -> list[list[str | None]]:
    """Cells of one sheet of an .xlsx file as texts; whole numbers without a point, blank rows left out."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
        root = ElementTree.fromstring(z.read(names[sheet]))
    out = []
    for row in root.iter(f"{{{space['m']}}}row"):
        cells: dict[int, str | None] = {}
        for k, c in enumerate(row.findall("m:c", space)):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = k if letters is None else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
            cells[at] = cell_text(c, shared, space)
        line = [cells.get(k) for k in range(max(cells, default=-1) + 1)]
        if any(v not in (None, "") for v in line):
            out.append(line)
    return out


def cell_text(cell, shared: list[str], space: dict) -> str | None:
    kind, value = cell.get("t"), cell.find("m:v", space)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{space['m']}}}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind in (None, "n"):
        x = float(value.text)
        return str(int(x)) if x.is_integer() else repr(x)
    return value.text


def read_sheet(spark: SparkSession, path: str, sheet: int = 0, most: int = MOST_BYTES) -> DataFrame:
    """One sheet of an .xlsx file, told by its first bytes: header row first, all strings, row_no from 2. Bounded by the file's size."""
    data = bounded(path, most)
    if not data.startswith(b"PK"):
        raise ValueError(f"{path} is no .xlsx file")
    rows = sheet_rows(data, sheet)
    header = [(h or f"column {k + 1}").strip() for k, h in enumerate(rows[0])] if rows else []
    body = [(n, *((r + [None] * len(header))[: len(header)])) for n, r in enumerate(rows[1:], 2)]
    kind = ", ".join(["row_no int", *(f"`{h}` string" for h in header)])
    return spark.createDataFrame(body, kind)


def mapping(headers: list[str], override: dict[str, str] | None = None, table: str = HEADERS) -> tuple[dict[str, str], list[str]]:
    """(field -> header, headers left over). A field takes the first header, in the file's order, whose folded form it lists; no header
    serves two fields; ``override`` goes before."""
    taken = dict(override or {})
    for field, names in spellings(table).items():
        if field not in taken:
            free = next((h for h in headers if h not in taken.values() and folded(h) in names), None)
            if free is not None:
                taken[field] = free
    return taken, [h for h in headers if h not in taken.values()]


def map_headers(df: DataFrame, override: dict[str, str] | None = None, table: str = HEADERS) -> DataFrame:
    """Columns named by field, null where the file has none; price and quantity as numbers (thousands commas out, null if none); a
    column row_no goes along. The code and the description must be there."""
    found, _ = mapping([c for c in df.columns if c != "row_no"], override, table)
    if missing := [f for f in ("code", "description") if f in spellings(table) and f not in found]:
        raise ValueError(f"no column for {', '.join(missing)}")
    cell = lambda f: F.col(f"`{found[f]}`") if f in found else F.lit(None).cast("string")
    number = lambda x: F.trim(F.replace(x, F.lit(","), F.lit(""))).try_cast("double")
    out = [(number(cell(f)) if f in ("price", "qty_on_hand") else cell(f)).alias(f) for f in spellings(table)]
    return df.select(*(["row_no"] if "row_no" in df.columns else []), *out)


def with_long_text(items: DataFrame, lines: DataFrame) -> DataFrame:
    """lines: code, line_no, text. The lines of a code, in order, follow its description after single spaces."""
    joined = lines.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("_long"))
    return items.join(joined, "code", "left").withColumn("description", F.concat_ws(" ", "description", "_long")).drop("_long")


def long_text_sheet(sheet: DataFrame) -> DataFrame | None:
    """(code, line_no, text) of a sheet that has a code and a text column, else None."""
    found, left = mapping([c for c in sheet.columns if c != "row_no"])
    names = [folded(a) for a in LONG_TEXT.split(",")]
    text = next((h for h in [*left, *found.values()] if folded(h) in names and h != found.get("code")), None)
    if "code" not in found or text is None:
        return None
    return sheet.select(F.col(f"`{found['code']}`").alias("code"), F.col("row_no").alias("line_no"), F.col(f"`{text}`").alias("text"))


def validate(rows: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). rows: row_no, code, description, ... Rejects carry the first reason that holds: no code, no
    description, a code met before in the file, a code that is there already."""
    code, text = F.trim(F.coalesce("code", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    whole = (code != "") & (text != "")
    marked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(code, whole).orderBy("row_no")))
    reason = F.when(code == "", "missing code").when(text == "", "missing description").when(F.col("_k") > 1, "duplicate code in file")
    if existing is not None:
        known = existing.select(F.trim("code").alias("_code"), F.lit(True).alias("_known")).distinct()
        marked = marked.join(known, F.trim("code") == F.col("_code"), "left").drop("_code")
        reason = reason.when(F.col("_known"), "code already present")
    marked = marked.withColumn("reason", reason).drop("_k", "_known")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def preview(rows: DataFrame, existing: DataFrame | None = None, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(the first accepted rows normalised and read, counts by outcome): a dry run; nothing is written."""
    good, bad = validate(rows, existing)
    counts = bad.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("rows")).unionByName(good.agg(F.lit("accepted").alias("outcome"), F.count("*").alias("rows")))
    return extract_rows(normalise_rows(good.orderBy("row_no").limit(most))), counts


def write_load_files(plan: DataFrame, folder: str) -> None:
    """crossref, block and held rows of a change plan as CSV folders, with a readme that says what each holds."""
    parts = (("crossref", "impact = 'safe' and action = 'crossref'"), ("block", "impact = 'safe' and action = 'block'"), ("held", "impact <> 'safe'"))
    for name, where in parts:
        flat = [F.to_json(c).alias(c) if t.startswith("struct") else F.col(c) for c, t in plan.dtypes]
        plan.where(where).select(*flat).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    store, path = open_fs(folder)
    with store.open_output_stream(f"{path}/README.txt") as f:
        f.write(b"crossref: materials that get a code\nblock: materials that another one replaces\nheld: materials to decide by hand\n")


def write_corpus(labels: DataFrame, folder: str) -> None:
    """One JSON line per row, keys sorted."""
    labels.select(F.to_json(F.struct(*sorted(labels.columns))).alias("value")).write.mode("overwrite").text(folder)


class Attachments:
    """Files by their SHA-256 under a folder; equal contents are stored once. A void file stays where it is and is read no more."""

    def __init__(self, folder: str):
        self.store, self.path = open_fs(folder)
        self.store.create_dir(self.path, recursive=True)

    def _name(self, digest: str, kind: str = "bin") -> str:
        return f"{self.path}/{digest[:2]}/{digest}.{kind}"

    def _there(self, name: str) -> bool:
        return self.store.get_file_info(name).type.name == "File"

    def put(self, data: bytes) -> str:
        digest = hashlib.sha256(data).hexdigest()
        if not self._there(self._name(digest)):
            self.store.create_dir(f"{self.path}/{digest[:2]}", recursive=True)
            with self.store.open_output_stream(self._name(digest)) as f:
                f.write(data)
        return digest

    def get(self, digest: str) -> bytes | None:
        if not self._there(self._name(digest)) or self._there(self._name(digest, "void")):
            return None
        with self.store.open_input_stream(self._name(digest)) as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"{digest} was altered")
        return data

    def void(self, digest: str, reason: str) -> None:
        with self.store.open_output_stream(self._name(digest, "void")) as f:
            f.write(reason.encode())
