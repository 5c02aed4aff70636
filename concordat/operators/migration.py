"""Change plans for material masters: plan, dry run, apply with a journal, roll back, verify, list batches. All are frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stock worth this much makes a block a conflict (fixed value); fields that a change touches.
DEAR, FIELDS = 5_000_000, ("code", "blocked", "survivor")
SHAPE = "struct<code:string,blocked:boolean,survivor:string>"


def read_masters(masters: DataFrame, orders: DataFrame | None = None, stock: DataFrame | None = None, valuation: DataFrame | None = None) -> DataFrame:
    """Masters (key, ...) with open_lines, on_hand and stock_value, 0 where a key has none. orders: key, open; stock: key,
    quantity; valuation: key, price. Each side is aggregated before it is joined."""
    out = masters
    sides = [] if orders is None else [orders.where("open").groupBy("key").agg(F.count("*").alias("open_lines"))]
    sides += [] if stock is None else [stock.groupBy("key").agg(F.sum("quantity").alias("on_hand"))]
    sides += [] if valuation is None else [valuation.groupBy("key").agg(F.max("price").alias("price"))]
    for s in sides:
        out = out.join(s, "key", "left")
    have = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t) if c in out.columns else F.lit(0).cast(t)
    own = [c for c in masters.columns if c not in ("open_lines", "on_hand", "stock_value")]
    return out.select(*own, have("open_lines", "long").alias("open_lines"), have("on_hand", "double").alias("on_hand"), (have("on_hand", "double") * have("price", "double")).alias("stock_value"))


def plan(masters: DataFrame, dear: float = DEAR) -> DataFrame:
    """(cluster, key, code, survivor, action, impact, will_apply, before, after).

    masters: cluster, code (issued), key, on_hand, stock_value, open_lines, and the present fields old_code, blocked,
    old_survivor. The member of most stock survives, of equals the smallest key; it gets a cross reference, the others are
    blocked. Open orders hold a change; blocking dear stock is a conflict; only safe changes apply.
    """
    best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("on_hand"), "key"))
    rows = masters.withColumn("_k", best).withColumn("survivor", F.first("key").over(Window.partitionBy("cluster").orderBy(F.desc("on_hand"), "key")))
    action = F.when(F.col("_k") == 1, "crossref").otherwise("block")
    rows = rows.withColumn("action", action)
    impact = F.when(F.col("open_lines") > 0, "hold").when((F.col("action") == "block") & (F.col("on_hand") > 0) & (F.col("stock_value") >= dear), "conflict").otherwise("safe")
    block = F.col("action") == "block"
    before = F.struct(F.col("old_code").alias("code"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.col("old_survivor").alias("survivor"))
    after = F.struct(F.when(block, F.col("old_code")).otherwise(F.col("code")).alias("code"), block.alias("blocked"), F.when(block, F.col("survivor")).otherwise(F.col("old_survivor")).alias("survivor"))
    out = rows.withColumn("impact", impact)
    return out.select("cluster", "key", "code", "survivor", "action", "impact", (F.col("impact") == "safe").alias("will_apply"), before.cast(SHAPE).alias("before"), after.cast(SHAPE).alias("after"))


def by_impact(changes: DataFrame) -> DataFrame:
    """Conflicts first, then holds, then safe ones; within, by key."""
    order = F.when(F.col("impact") == "conflict", 0).when(F.col("impact") == "hold", 1).otherwise(2)
    return changes.orderBy(order, "key")


def same(x: Column, y: Column) -> Column:
    out = F.lit(True)
    for f in FIELDS:
        out = out & x[f].eqNullSafe(y[f])
    return out


def diff(changes: DataFrame) -> DataFrame:
    """(key, field, before, after): one row per field that a change alters."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col("before")[f].cast("string").alias("before"), F.col("after")[f].cast("string").alias("after")) for f in FIELDS))
    return changes.select("key", F.explode(pairs).alias("d")).select("key", "d.*").where("not (before <=> after)")


def apply(masters: DataFrame, changes: DataFrame, batch: str, include_held: bool = False) -> tuple[DataFrame, DataFrame]:
    """(masters, journal). masters: key, code, blocked, survivor. The journal (batch, key, before, after, state) has every change:
    applied, skipped (the master is there already, so a repeated batch changes nothing) or held."""
    go = F.lit(True) if include_held else F.col("will_apply")
    now = F.struct("code", F.coalesce("blocked", F.lit(False)).alias("blocked"), "survivor").cast(SHAPE)
    live = masters.select("key", now.alias("now"))
    rows = changes.join(live, "key", "left")
    state = F.when(~go, "held").when(F.col("now").isNull(), "missing").when(same(F.col("now"), F.col("after")), "skipped").otherwise("applied")
    journal = rows.select(F.lit(batch).alias("batch"), "key", F.coalesce("now", "before").alias("before"), "after", state.alias("state"))
    return updated(masters, journal.where("state = 'applied'").select("key", F.col("after").alias("to"))), journal


def updated(masters: DataFrame, to: DataFrame) -> DataFrame:
    out = masters.join(to, "key", "left")
    return out.select(*(F.when(F.col("to").isNotNull(), F.col(f"to.{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in masters.columns))


def rollback(masters: DataFrame, journal: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(masters, journal): the batch's applied changes go back to what they found, if the master is still as they left it; others
    are told as drifted and stay. A second roll-back finds nothing to do."""
    mine = journal.where((F.col("batch") == batch) & (F.col("state") == "applied"))
    now = F.struct("code", F.coalesce("blocked", F.lit(False)).alias("blocked"), "survivor").cast(SHAPE)
    seen = mine.join(masters.select("key", now.alias("now")), "key", "left").select("key", F.when(F.coalesce(same(F.col("now"), F.col("after")), F.lit(False)), "rolled_back").otherwise("drifted").alias("to_state"), F.col("before").alias("to"))
    done = journal.join(seen.select("key", "to_state"), "key", "left")
    fresh = F.when((F.col("batch") == batch) & (F.col("state") == "applied"), F.coalesce("to_state", "state")).otherwise(F.col("state"))
    return updated(masters, seen.where("to_state = 'rolled_back'").select("key", "to")), done.select("batch", "key", "before", "after", fresh.alias("state"))


def verify(masters: DataFrame, journal: DataFrame) -> DataFrame:
    """(batch, key, field, expected, found): fields of applied changes that no longer hold."""
    now = F.struct("code", F.coalesce("blocked", F.lit(False)).alias("blocked"), "survivor").cast(SHAPE)
    rows = journal.where("state in ('applied', 'skipped')").join(masters.select("key", now.alias("now")), "key", "left")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col("after")[f].cast("string").alias("expected"), F.col("now")[f].cast("string").alias("found")) for f in FIELDS))
    return rows.select("batch", "key", F.explode(pairs).alias("d")).select("batch", "key", "d.*").where("not (expected <=> found)")


def batches(journal: DataFrame) -> DataFrame:
    """(batch, changes, applied, held, skipped, rolled_back, drifted)."""
    return journal.groupBy("batch").agg(F.count("*").alias("changes"), *(F.count_if(F.col("state") == s).alias(s) for s in ("applied", "held", "skipped", "rolled_back", "drifted")))
