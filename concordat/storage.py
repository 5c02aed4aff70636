"""Tables between steps: written to the shared folder and read again, so that lineage ends and lost executors cost nothing.

Paths are resolved once, by Hadoop's file systems, as Spark resolves them: a path without a scheme belongs to the default file
system of the session, wherever that is. What the driver lists or removes goes through Hadoop too. Tasks that write files of their own
format get whole URIs and open them with pyarrow's file systems.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Hadoop's names of stores that pyarrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
#: The folder of a local session without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}
#: Writes that hold the clean-up setting, and what it was before the first of them.
_HELD, _LOCK = {"writes": 0, "before": None}, threading.Lock()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (URI) under spark.checkpoint.dir, which driver and executors share. Unset: a temporary one on a local
    master, as in tests; an error on a cluster, whose machines share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='concordat-')}"
            spark.sparkContext.setCheckpointDir(_LOCAL[app])
        base = _LOCAL[app]
    return qualified(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path, as Spark would resolve it."""
    fs, at = hadoop(spark, path)
    return fs.makeQualified(at).toString()


def written(df: DataFrame, folder: str) -> DataFrame:
    """Write a table and read it again. The write's shuffle files go as soon as it is done; several threads may write at once."""
    spark = df.sparkSession
    with _LOCK:
        if not _HELD["writes"]:
            _HELD["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _HELD["writes"] += 1
    try:
        df.write.mode("overwrite").parquet(folder)
    finally:
        with _LOCK:
            _HELD["writes"] -= 1
            if not _HELD["writes"]:
                spark.conf.unset(CLEANUP) if _HELD["before"] is None else spark.conf.set(CLEANUP, _HELD["before"])
    return spark.read.schema(df.schema).parquet(folder)


def tasks(spark: SparkSession) -> int:
    """Into how many tasks work goes that does not follow bytes: at least the session's shuffle partitions, and three rounds of all cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all cores by a hash of the key: a file of few megabytes is read by one task, however much is made of its rows."""
    return df.repartition(tasks(df.sparkSession), key)


def once(rows: DataFrame, columns: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows beside what read() makes of the distinct values of the columns: copies are read once, in as many tasks as the session
    shuffles to. Nulls are values like others. Neither side is broadcast, since the size of a file tells little of its rows."""
    distinct = rows.select(*columns).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = read(distinct)
    made = [c for c in found.columns if c not in columns]
    keys = {c: fresh(f"_{c}", rows) for c in columns}
    found = found.select(*(F.col(c).alias(k) for c, k in keys.items()), *made)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return rows.join(found.hint("merge"), same).select(*(c for c in rows.columns if c not in made), *made)


def open_fs(uri: str):
    """(pyarrow's file system, path) of a URI. On the driver a path without a scheme is resolved by the session; elsewhere, and without
    one, it is local."""
    from pyarrow import fs

    spark = SparkSession.getActiveSession()
    if spark is not None:
        uri = qualified(spark, uri)
    scheme, colon, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def drop(*folders: str) -> None:
    """Remove tables that no later step reads."""
    for folder in folders:
        fs, at = hadoop(SparkSession.active(), folder)
        fs.delete(at, True)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
