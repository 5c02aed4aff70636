"""Class schemas: which attributes a class of materials has, what role each plays, and how texts show them.

A schema is data. ``parse`` reads the text form below; users may write their own and hand it to every operator that takes one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

IDENTITY, PERFORMANCE, COSMETIC = "identity", "performance", "cosmetic"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str  # numeric, enum, categorical
    role: str
    percent: float | None = None  # tolerance as a share of the larger value
    higher_ok: bool = False
    values: tuple[str, ...] = ()
    rule: str = ""  # how extraction finds it: "number:PATTERN", "choice:LIST", "group:PATTERN", or a name of its own


@dataclass(frozen=True)
class MaterialClass:
    code: str
    noun: str
    family: str
    segment: str
    block_on: str | None
    keywords: tuple[str, ...]
    template: str
    brands: tuple[str, ...]
    attributes: dict[str, Attribute] = field(default_factory=dict)

    def names(self, role: str) -> list[str]:
        return [a.name for a in self.attributes.values() if a.role == role]


UNCLASSIFIED = "unclassified"

# The classes, one block each. First line: code, noun, code family, code segment, blocking attribute. Then keywords,
# template, brands, and per attribute: name, kind, role, tolerance in per cent, whether more is better, values, extraction rule.
CLASSES = """
bearing.ball.deep_groove | BEARING | BRNG | 010 | bore_mm
keywords: bearing, brg, brng, bearng, ball bearing, deep groove, dgbb
template: {noun}, BALL DEEP GROOVE, {bore_mm}MM BORE, {outer_dia_mm}MM OD, {width_mm}MM W, {seal_type}, {brand} {mpn}
brands: SKF, FAG, NSK, NTN, TIMKEN, KOYO
bore_mm numeric identity rule=number:bore_mm
outer_dia_mm numeric identity rule=number:od_mm
width_mm numeric identity rule=number:width_mm
seal_type enum identity values=ZZ,2RS,OPEN rule=choice:seal_type
load_rating_kg numeric performance percent=5 higher rule=number:load_kg
temp_max_c numeric performance percent=10 higher rule=number:temp_max
brand categorical cosmetic rule=brand

valve.gate | VALVE | VALV | 020 | size_nb_mm
keywords: valve, vlv, vv, gate valve, gt valve
template: {noun}, GATE, {size_nb_mm}NB, CLASS {pressure_class}, {body_material}, {end_connection}, {brand} {mpn}
brands: KITZ, AUDCO, BDK, KSB, FLOWSERVE, LT
size_nb_mm numeric identity rule=number:size_nb
pressure_class enum identity values=150,300,600,900 rule=group:pressure_class
body_material enum identity values=WCB,CS,SS316,SS304,CI rule=choice:body_material
end_connection enum identity values=FLANGED,THREADED,BUTTWELD,SOCKETWELD rule=choice:end_connection
pressure_bar numeric performance percent=5 higher rule=number:pressure_bar
temp_max_c numeric performance percent=10 higher rule=number:temp_max
brand categorical cosmetic rule=brand

gasket.spiral_wound | GASKET | GSKT | 030 | size_nb_mm
keywords: gasket, gskt, gsk, spiral wound, swg
template: {noun}, SPIRAL WOUND, {size_nb_mm}NB, CLASS {pressure_class}, {material}, {thickness_mm}MM THK, {brand} {mpn}
brands: LEADER, CHAMPION, GARLOCK, FLEXITALLIC
size_nb_mm numeric identity rule=number:size_nb
pressure_class enum identity values=150,300,600,900 rule=group:pressure_class
material enum identity values=SS316-GRAPHITE,SS304-PTFE,SS316-PTFE,CAF rule=choice:material
thickness_mm numeric identity rule=number:thickness
temp_max_c numeric performance percent=10 higher rule=number:temp_max
brand categorical cosmetic rule=brand

pipe.seamless | PIPE | PIPE | 040 | nps_mm
keywords: pipe, ppe, seamless, smls, tube
template: {noun}, SEAMLESS, {nps_mm}NB, {schedule}, {material}, {brand} {mpn}
brands: JINDAL, TATA, MSL, ISMT
nps_mm numeric identity rule=number:size_nb
schedule enum identity values=SCH20,SCH40,SCH80,SCH160,XS rule=schedule
material enum identity values=CS-A106B,SS316,SS304,CS-A53 rule=choice:material
pressure_bar numeric performance percent=5 higher rule=number:pressure_bar
length_m numeric cosmetic rule=number:length_m
brand categorical cosmetic rule=brand

fastener.bolt.hex | BOLT | FAST | 050 | length_mm
keywords: bolt, blt, hex bolt, hexagon, screw, stud
template: {noun}, HEX HEAD, {thread}, {length_mm}MM LG, GRADE {grade}, {material}, {brand} {mpn}
brands: UNBRAKO, TVS, SUNDRAM, APL
thread enum identity rule=thread
length_mm numeric identity rule=number:length_mm
grade enum identity values=4.6,8.8,10.9,12.9 rule=group:grade
material enum identity values=CS,SS316,SS304 rule=choice:material
finish enum cosmetic values=ZINC,PLAIN,HDG rule=choice:finish
brand categorical cosmetic rule=brand

cable.power | CABLE | CABL | 060 | csa_mm2
keywords: cable, cbl, wire, armoured, unarmoured, conductor
template: {noun}, POWER, {cores}C X {csa_mm2}SQMM, {conductor}, {insulation}, {voltage_v}V, {brand} {mpn}
brands: POLYCAB, HAVELLS, FINOLEX, KEI
cores numeric identity rule=cores
csa_mm2 numeric identity rule=csa
voltage_v numeric identity rule=voltage
conductor enum identity values=CU,AL rule=choice:conductor
insulation enum identity values=PVC,XLPE rule=choice:insulation
temp_max_c numeric performance percent=10 higher rule=number:temp_max
brand categorical cosmetic rule=brand

chemical.reagent | CHEMICAL | CHEM | 070 | substance
keywords: chemical, acid, caustic, solvent, reagent, hydroxide, chloride, carbonate, sulphuric, nitric, phosphoric, acetic, methanol, ethanol, alcohol, isopropyl, acetone, sodium, potassium, calcium, toluene, xylene, hexane, ammonium, sulphate, permanganate, peroxide, citric, oxalic, boric
template: {noun}, {substance}, {grade} GRADE, {concentration_pct}PCT, {brand} {mpn}
brands: MERCK, RANKEM, FISHER, THERMO
substance enum identity rule=choice:substance
grade enum identity values=LR,AR,GR,TECH rule=reagent_grade
concentration_pct numeric performance percent=2 higher rule=number:concentration
brand categorical cosmetic rule=brand

ppe.helmet | HELMET | PPEQ | 080 |
keywords: helmet, hard hat, safety helmet, ppe, hat
template: {noun}, SAFETY, CLASS {helmet_class}, {shell_material}, {harness_type}, {chin_strap}, {ventilation}, {brim}, {standard}, {brand} {mpn}
brands: KARAM, VENUS, 3M, HONEYWELL
helmet_class enum identity values=A,B,C,E rule=choice:helmet_class
standard enum identity values=IS2925,EN397 rule=choice:standard
shell_material enum identity values=HDPE,ABS,FRP rule=choice:shell_material
harness_type enum identity values=RATCHET,PINLOCK rule=choice:harness_type
chin_strap enum identity values=2-POINT,4-POINT rule=choice:chin_strap
ventilation enum identity values=VENTED,NON-VENTED rule=choice:ventilation
brim enum identity values=FULL_BRIM,PEAK rule=choice:brim
colour categorical cosmetic
brand categorical cosmetic rule=brand

unclassified | ITEM | MISC | 999 |
template: {noun}, {brand} {mpn}
brand categorical cosmetic rule=brand
"""

# Brand spellings of one maker.
BRAND_ALIASES = {"SKF INDIA": "SKF", "FAG SCHAEFFLER": "FAG", "SCHAEFFLER": "FAG", "NSK LTD": "NSK", "L&T": "LT", "LARSEN": "LT", "MAHARASHTRA SEAMLESS": "MSL", "3M INDIA": "3M"}


def parse(text: str = CLASSES) -> dict[str, MaterialClass]:
    """Classes by code, in the order of the text."""
    out = {}
    for block in text.strip().split("\n\n"):
        head, *lines = block.strip().splitlines()
        code, noun, family, segment, block_on = (x.strip() for x in head.split("|"))
        keys = {k: v.strip() for k, v in (x.split(":", 1) for x in lines if x.split(":", 1)[0] in ("keywords", "template", "brands"))}
        listed = lambda k: tuple(x.strip() for x in keys.get(k, "").split(",") if x.strip())  # noqa: B023, E731
        attributes = {}
        for line in lines:
            if line.split(":", 1)[0] in ("keywords", "template", "brands"):
                continue
            name, kind, role, *rest = line.split()
            given = dict(x.split("=", 1) for x in rest if "=" in x)
            values = tuple(v.replace("_", " ") for v in given.get("values", "").split(",") if v)
            attributes[name] = Attribute(name, kind, role, float(given["percent"]) if "percent" in given else None, "higher" in rest, values, given.get("rule", ""))
        if block_on and block_on not in attributes:
            raise ValueError(f"{code}: {block_on} is none of its attributes")
        out[code] = MaterialClass(code, noun, family, segment, block_on or None, listed("keywords"), keys["template"], listed("brands"), attributes)
    return out


SCHEMA = parse()


def brands(schema: dict[str, MaterialClass]) -> list[str]:
    return sorted({b for c in schema.values() for b in c.brands})
