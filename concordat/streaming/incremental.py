"""Incremental runs as streams: each batch of new items is blocked against everything known; plus event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touching_pairs(items: DataFrame, fresh: DataFrame, keys: list[str], id_col: str = "item") -> DataFrame:
    """Candidate pairs (item_a < item_b) within equal keys of which at least one side is fresh."""
    a = fresh.select(F.col(id_col).alias("x"), *keys)
    b = items.select(F.col(id_col).alias("y"), *keys)
    return a.join(b, keys).where("x <> y").select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).distinct()


def run_incremental(stream: DataFrame, known: str, pairs: str, keys: list[str], checkpoint: str, id_col: str = "item"):
    """Start a stream: a batch's pairs are added to ``pairs``, then its rows to ``known``. A repeated batch replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{known}/batch={number}")
        everything = spark.read.parquet(known).drop("batch")
        touching_pairs(everything, batch, keys, id_col).write.mode("overwrite").parquet(f"{pairs}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and type; works on streams and tables."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("start"), "event_type", "n")
