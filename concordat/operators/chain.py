"""Hash-chained ledgers: append, verify, void, statistics; versions of tables and memos of results.

An event's hash is the SHA-256 of "seq|prev_hash|payload"; payloads are JSON texts with sorted keys. Chains are independent, so
they are appended to and verified side by side; within a chain the fold is sequential.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import placed

GENESIS = "0" * 64
EVENTS = "chain string, seq long, prev_hash string, hash string, payload string"


def canonical(payload: Column) -> Column:
    """A struct or map as JSON; its fields should be sorted by name."""
    return F.to_json(payload)


def canonical_text(payload: object) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)


def event_hash(seq: Column, prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", seq.cast("string"), prev, payload), 256)


def append(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events (chain, seq, prev_hash, hash, payload) for new rows (chain, place, payload), after the head of each stored chain.

    Within a chain rows follow ``place``. The first event of a chain is number 0. Each hash needs the one before, so a chain's new rows
    are one task's work; they pass one by one, and none but the last hash is kept.
    """
    heads = None
    if stored is not None:
        heads = stored.groupBy("chain").agg(F.max_by(F.struct("seq", "hash"), "seq").alias("h")).select("chain", F.col("h.seq").alias("head_seq"), F.col("h.hash").alias("head_hash"))
    rows = new.select("chain", "place", "payload")
    rows = rows.join(heads, "chain", "left") if heads is not None else rows.withColumn("head_seq", F.lit(None).cast("long")).withColumn("head_hash", F.lit(None).cast("string"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, prev = (), 0, GENESIS
        for part in batches:  # sorted by chain and place; a chain may go on in the next batch
            out = []
            for chain, payload, first, head in zip(part["chain"], part["payload"], part["head_seq"], part["head_hash"], strict=True):
                if now != (chain,):
                    now = (chain,)
                    seq, prev = (0, GENESIS) if pd.isna(first) else (int(first) + 1, head)
                made = hashlib.sha256(f"{seq}|{prev}|{payload}".encode()).hexdigest()
                out.append((chain, seq, prev, made, payload))
                seq, prev = seq + 1, made
            yield pd.DataFrame(out, columns=["chain", "seq", "prev_hash", "hash", "payload"])

    return rows.repartition("chain").sortWithinPartitions("chain", "place", "payload").mapInPandas(fold, EVENTS)


def verify(events: DataFrame) -> DataFrame:
    """Per chain: events, head_seq, head_hash, valid, first_break (its seq) and reason.

    An event breaks its chain if its number isn't its place (one was removed, added or moved), if its prev_hash isn't the hash of
    the event before it, or if its own hash doesn't follow from what it holds (it was altered). A chain is checked in ranges of its
    events, each in a task of its own; the ranges' counts and last hashes meet in a frame of one row per range. That its newest events
    were cut off shows only against a head that was kept elsewhere: see anchored().
    """
    rows = placed(events.select("chain", "seq", "prev_hash", "hash", "payload"), ["chain"], ["seq", "hash"], {"before": "hash"})
    rows = rows.withColumnRenamed("place", "expected").withColumn("before", F.when(F.col("expected") == 0, GENESIS).otherwise(F.col("before")))
    reason = F.when(F.col("seq") != F.col("expected"), "sequence").when(F.col("prev_hash") != F.col("before"), "link").when(F.col("hash") != event_hash(F.col("seq"), F.col("prev_hash"), F.col("payload")), "payload")
    rows = rows.withColumn("reason", F.when(F.col("prev_hash").isNull() | F.col("hash").isNull() | F.col("payload").isNull(), "payload").otherwise(reason))
    broken = F.when(F.col("reason").isNotNull(), F.struct("expected", "seq", "reason"))
    out = rows.groupBy("chain").agg(F.count("*").alias("events"), F.max(F.struct("seq", "hash")).alias("head"), F.min(broken).alias("b"))
    return out.select("chain", "events", F.col("head.seq").alias("head_seq"), F.col("head.hash").alias("head_hash"), F.col("b").isNull().alias("valid"), F.col("b.seq").cast("long").alias("first_break"), F.col("b.reason").alias("reason"))


def anchored(verified: DataFrame, anchors: DataFrame) -> DataFrame:
    """verify()'s rows with ``cut_off``: whether the chain ends before, or elsewhere than at, a head (chain, seq, hash) that was kept apart,
    or is gone altogether. A chain that went on since has to hold the kept head at its place, so pass that event's hash with it."""
    kept = anchors.select("chain", F.col("seq").alias("_s"), F.col("hash").alias("_h"))
    cut = F.col("_s").isNotNull() & (F.col("head_seq").isNull() | (F.col("head_seq") < F.col("_s")) | ((F.col("head_seq") == F.col("_s")) & (F.col("head_hash") != F.col("_h"))))
    return verified.join(kept, "chain", "full").withColumn("cut_off", cut).drop("_s", "_h")


def voided(events: DataFrame) -> DataFrame:
    """(chain, seq) of the events that a later event voids; an event is voided by naming it, never removed."""
    return events.select("chain", F.get_json_object("payload", "$.voids_seq").try_cast("long").alias("seq")).where("seq is not null").distinct()


def action_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce(F.get_json_object("payload", "$.action"), F.lit("")).alias("action")).agg(F.count("*").alias("n"))


def version(tables: dict[str, DataFrame], as_of: str | None = None) -> str:
    """A text that changes when a table does: rows and an order-free sum of row hashes, each table in one pass."""
    parts = [as_of or ""]
    for name, df in sorted(tables.items()):
        columns = [F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in sorted(df.dtypes)]
        n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        parts.append(f"{name}:{n}:{total or 0}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


class Memo:
    """Results kept as tables under a folder, one per name and version; another version makes it anew."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        from ..storage import exists, written

        path = f"{self.folder}/{name}-{key}"
        if exists(self.spark, f"{path}/_SUCCESS"):
            return self.spark.read.parquet(path)
        return written(make(), path)


def table_fingerprint(tables: dict[str, DataFrame]) -> str:
    """SHA-256 over the tables' names and contents, whatever the order of rows: any change of a value shows."""
    return version(tables)
