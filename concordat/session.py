"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "8", name: str = "concordat", memory: str = "8g") -> SparkSession:
    """A session for one machine: as many shuffle partitions as cores, adaptive execution, UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_concordat_shipped", False):
        return
    here = Path(__file__).parent
    file = os.path.join(tempfile.mkdtemp(prefix="concordat-"), "concordat_package.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(file)
    context._concordat_shipped = True
