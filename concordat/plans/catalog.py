"""Every query by name: its callable and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import commerce, inventory, ledger, resolution, text
from .roles import TABLES, with_roles



def portable(sql: str) -> tuple[str, str]:
    """(Spark, DuckDB) of one statement; the few functions with other names are renamed."""
    whole = with_roles(sql)
    call = r"sha256_hex\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"
    return re.sub(call, r"sha2(\1, 256)", whole), re.sub(call, r"sha256(\1)", whole)


def two(spark_sql: str, duck_sql: str) -> tuple[str, str]:
    return with_roles(spark_sql), with_roles(duck_sql)


def statements() -> dict[str, tuple[str, str]]:
    out = {name: portable(sql) for area in (commerce, inventory, resolution, ledger, text) for name, sql in area.SQL.items()}
    return out | {name: two(*pair) for name, pair in text.PAIRS.items()}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Each table that the statement names is read where it is named; nothing is registered in the session."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql, re.IGNORECASE)}
    named = re.sub(r"[{}]", lambda m: m[0] * 2, sql)
    for t in tables:
        named = re.sub(rf"\b(FROM|JOIN)\s+{t}\b(?!\s*AS\s*\()", rf"\1 {{{t}}}", named, flags=re.IGNORECASE)
    return spark.sql(named, **tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import frames, materials, pairs

    out = {name: (lambda spark, sf_dir, sql=pair[0]: run_sql(spark, sf_dir, sql)) for name, pair in statements().items()}
    return out | frames.queries() | pairs.queries() | materials.queries()


def oracle_sql() -> dict[str, str]:
    from . import frames, materials

    return {name: pair[1] for name, pair in statements().items()} | frames.oracle_sql() | materials.oracle_sql()
