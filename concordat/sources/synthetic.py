"""A small catalogue made from the part table by rule, with the truth beside it: what any reader of its texts should find.

CATALOGUE is one statement that Spark and DuckDB both run: id, company, description, uom, and the true class, text, pack and
attributes of every row. Eight classes take turns; sizes, brands and styles follow from the part's key and size.
"""

from __future__ import annotations

_BRANDS = {0: ("SKF", "FAG", "NSK"), 1: ("KITZ", "AUDCO", "BDK"), 2: ("LEADER", "GARLOCK", "CHAMPION"), 3: ("JINDAL", "TATA", "ISMT"), 4: ("UNBRAKO", "TVS", "SUNDRAM"), 5: ("POLYCAB", "HAVELLS", "FINOLEX"), 6: ("MERCK", "RANKEM", "FISHER"), 7: ("KARAM", "VENUS", "HONEYWELL")}


def pick(expression: str, *values: object) -> str:
    """CASE over 0, 1, 2, ... of an integer expression."""
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"CASE {expression} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted[:-1])) + f" ELSE {quoted[-1]} END"


S = lambda x: f"CAST({x} AS VARCHAR(12))"
_KIND = "p_partkey % 8"
_NB = "(25 * (1 + p_size % 8))"
_BRAND = f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN {pick('p_size % 3', *b)}" for k, b in _BRANDS.items()) + " END"
_SERIES = pick("p_size % 3", "60", "62", "63")
_CODE = f"lpad({S('4 + p_size % 17')}, 2, '0')"
_RATING, _SCHEDULE, _THREAD = pick("p_size % 3", "150", "300", "600"), pick("p_size % 3", "20", "40", "80"), pick("p_size % 4", "8", "10", "12", "16")
_CSA, _SUBSTANCE = pick("p_size % 3", "25", "50", "95"), pick("p_size % 4", "TOLUENE", "XYLENE", "ACETONE", "METHANOL")
_SHELL, _HELMET = pick("p_size % 3", "HDPE", "ABS", "FRP"), pick("p_size % 2", "A", "B")

#: Text as the company writes it, and the text that its normal form must have.
_RAW = {
    0: f"'Brg Ball ' || {_SERIES} || {_CODE} || '-2Z, ' || {_BRAND}", 1: f"'GT VLV ' || {S(_NB)} || 'NB; CL ' || {_RATING} || ' WCB FLGD ' || {_BRAND}",
    2: f"'GSKT spiral wound ' || {S(_NB)} || 'NB CLASS ' || {_RATING} || ' SS316-GRAPHITE 3MM THK'", 3: f"'Pipe SMLS ' || {S(_NB)} || 'NB SCH' || {_SCHEDULE} || ' CS-A106B'",
    4: f"'HEX BLT M' || {_THREAD} || 'X1.5 ' || {S('10 * p_size')} || 'MM LG GRADE 8.8 SS304'", 5: f"'CBL ' || {S('1 + p_size % 4')} || 'C X ' || {_CSA} || ' SQMM CU XLPE 1.1 KV'",
    6: f"'Chemical ' || {_SUBSTANCE} || ', GRADE GR ' || {S('90 + p_size % 4')} || ' PCT'", 7: f"'SFTY HLMT CLASS ' || {_HELMET} || ' ' || {_SHELL} || ' RATCH IS2925'",
}
_NORMAL = {
    0: f"'BEARING BALL ' || {_SERIES} || {_CODE} || '-2Z ' || {_BRAND}", 1: f"'GATE VALVE ' || {S(_NB)} || 'NB CLASS ' || {_RATING} || ' WCB FLANGED ' || {_BRAND}",
    2: f"'GASKET SPIRAL WOUND ' || {S(_NB)} || 'NB CLASS ' || {_RATING} || ' SS316-GRAPHITE 3MM THICKNESS'", 3: f"'PIPE SEAMLESS ' || {S(_NB)} || 'NB SCH' || {_SCHEDULE} || ' CS-A106B'",
    4: f"'HEXAGON BOLT M' || {_THREAD} || 'X1.5 ' || {S('10 * p_size')} || 'MM LENGTH GRADE 8.8 SS304'", 5: f"'CABLE ' || {S('1 + p_size % 4')} || 'C X ' || {_CSA} || ' SQUARE MILLIMETRE COPPER XLPE 1.1 KILOVOLT'",
    6: f"'CHEMICAL ' || {_SUBSTANCE} || ' GRADE GR ' || {S('90 + p_size % 4')} || ' PCT'", 7: f"'SAFETY HELMET CLASS ' || {_HELMET} || ' ' || {_SHELL} || ' RATCHET IS2925'",
}
CODES = ("bearing.ball.deep_groove", "valve.gate", "gasket.spiral_wound", "pipe.seamless", "fastener.bolt.hex", "cable.power", "chemical.reagent", "ppe.helmet")
#: True identity values in the order of the schema's attributes; None where the text can't tell all of them.
_SIGNATURE = {
    0: f"{S('5 * (4 + p_size % 17)')} || '|' || {{od}} || '|' || {{width}} || '|ZZ'", 1: f"{S(_NB)} || '|' || {_RATING} || '|WCB|FLANGED'", 2: f"{S(_NB)} || '|' || {_RATING} || '|SS316-GRAPHITE|3'", 3: f"{S(_NB)} || '|SCH' || {_SCHEDULE} || '|CS-A106B'",
    4: f"'M' || {_THREAD} || 'X1.5|' || {S('10 * p_size')} || '|8.8|SS304'", 5: f"{S('1 + p_size % 4')} || '|' || {_CSA} || '|1100|CU|XLPE'", 6: f"{_SUBSTANCE} || '|GR'", 7: None,
}
_BLOCK = {0: S("5 * (4 + p_size % 17)"), 1: S(_NB), 2: S(_NB), 3: S(_NB), 4: S("10 * p_size"), 5: _CSA, 6: _SUBSTANCE, 7: "CAST(NULL AS VARCHAR(12))"}


#: What a golden record of the row's material reads.
_GOLDEN = {
    0: f"'BEARING, BALL DEEP GROOVE, ' || {S('5 * (4 + p_size % 17)')} || 'MM BORE, ' || {{od}} || 'MM OD, ' || {{width}} || 'MM W, ZZ, ' || {_BRAND} || ' ' || {_SERIES} || {_CODE} || '2Z'", 1: f"'VALVE, GATE, ' || {S(_NB)} || 'NB, CLASS ' || {_RATING} || ', WCB, FLANGED, ' || {_BRAND}",
    2: f"'GASKET, SPIRAL WOUND, ' || {S(_NB)} || 'NB, CLASS ' || {_RATING} || ', SS316-GRAPHITE, 3MM THK'", 3: f"'PIPE, SEAMLESS, ' || {S(_NB)} || 'NB, SCH' || {_SCHEDULE} || ', CS-A106B'", 4: f"'BOLT, HEX HEAD, M' || {_THREAD} || 'X1.5, ' || {S('10 * p_size')} || 'MM LG, GRADE 8.8, SS304'",
    5: f"'CABLE, POWER, ' || {S('1 + p_size % 4')} || 'C X ' || {_CSA} || 'SQMM, CU, XLPE, 1100V'", 6: f"'CHEMICAL, ' || {_SUBSTANCE} || ', GR GRADE, ' || {S('90 + p_size % 4')} || 'PCT'", 7: "'-'",
}


def by_kind(cases: dict[int, str]) -> str:
    return f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


def bearing_sizes(place: int) -> str:
    """CASE over series and bore code of the outer diameter (0) or the width (1)."""
    from ..operators.extraction import BEARINGS

    rows = [(("60", "62", "63").index(n[:2]), int(n[2:]), d[place + 1]) for n, d in BEARINGS.items() if int(n[2:]) >= 4]
    return "CASE (p_size % 3) * 100 + 4 + p_size % 17 " + " ".join(f"WHEN {k * 100 + c} THEN '{v}'" for k, c, v in rows) + " END"


def signature() -> str:
    cases = {k: f"'{CODES[k]}|' || " + v.format(od=bearing_sizes(0), width=bearing_sizes(1)) if v else "CAST(NULL AS VARCHAR(60))" for k, v in _SIGNATURE.items()}
    return by_kind(cases)


_BOXED = f"CASE WHEN p_partkey % 5 = 0 THEN ' BOX OF 10' WHEN p_partkey % 5 = 1 THEN ' 4 NOS/PKT' ELSE '' END"
RAW = f"""SELECT p_partkey AS id, {pick('p_partkey % 4', 'north', 'east', 'south', 'west')} AS company, ({by_kind(_RAW)}) || {_BOXED} AS description,
    CASE WHEN p_partkey % 5 < 2 THEN 'BOX' ELSE 'Nos.' END AS uom, CAST(NULL AS DATE) AS last_purchase FROM part"""
TRUTH = f"""SELECT p_partkey AS id, {by_kind(_NORMAL)} AS norm_text, {by_kind({k: f"'{c}'" for k, c in enumerate(CODES)})} AS class_code, 'EA' AS uom_base,
    CASE WHEN p_partkey % 5 = 0 THEN 10.0E0 WHEN p_partkey % 5 = 1 THEN 4.0E0 ELSE 1.0E0 END AS pack_qty, CASE WHEN {_KIND} IN (0, 1) THEN {_BRAND} END AS brand,
    {by_kind(_BLOCK)} AS block_value, {signature()} AS signature, {by_kind({k: v.format(od=bearing_sizes(0), width=bearing_sizes(1)) for k, v in _GOLDEN.items()})} AS golden FROM part"""
