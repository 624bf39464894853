"""Mixing sources to target weights by weighted fair queueing [native]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import column, materialize, small, word_count

#: Prefix buckets of a source's shuffled order and of the virtual time up to 1.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(source, source_size, target): shares of share * all words by weight, none above repeats * its size.

    `sizes` has (source, source_size). Sources in code point order, null last, take the
    weights in turn. A single ordered pass finds the water level at which the excess of
    full sources is spread over the others; one row per source goes through it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("ratio", "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.select("source", "source_size", F.row_number().over(by_name).alias("rank"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1))
    s = s.withColumn("cap", (F.col("source_size") * repeats).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    s = s.select("*", (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).cast("double").alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("used"), F.sum("w").over(rest).alias("w_rest"))
    s = s.withColumn("open", F.col("cap") * F.col("w_rest") > F.col("w") * (F.col("total") - F.col("used")))
    first = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "used", "w_rest"))).over(Window.partitionBy())
    s = s.withColumn("first", first)
    share_of = F.when(F.col("open"), F.col("w") * (F.col("total") - F.col("first.used")) / F.col("first.w_rest"))
    return s.select("source", "source_size", F.coalesce(share_of, F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, repeats: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs.

    Every source's documents are shuffled by a hash of seed and id and queued up to
    `repeats` times over. A copy's virtual finish time is the source's cumulative words
    up to its end, divided by the source's target. All copies in order of finish time,
    cut where their words reach the sum of the targets, are the mix; copies that finish
    at 2 or later, whose source would have twice its target, are never in it. Prefix sums run
    over fixed buckets of the hash, so that no source is ordered in one task; only the
    cut's place in virtual time (one row) reaches the driver.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Rows
    equal in id share one place in the queue and are taken alike. Null id: queued as an
    empty id. An empty table gives no rows. Other columns of docs are ignored.
    """
    key = F.coalesce(column(docs, id_col).cast("string"), F.lit(""))
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, source_col).alias("source"), word_count(column(docs, text_col)).alias("size"), F.md5(F.concat(F.lit(seed + ":"), key)).alias("h"))
    rows = materialize(rows.withColumn("slot", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")), "mix")
    # per source and slot, then per source: a hot source is summed before any shuffle
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    targets = materialize(source_targets(slots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats), "mix-targets")
    upto = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("source", "slot", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"))
    slots = _with_targets(slots, targets)
    inside = Window.partitionBy("source", "slot").orderBy("h", "doc_id")
    rows = rows.withColumn("within", F.sum("size").over(inside))
    s = slots.select(F.col("source").alias("s_source"), F.col("slot").alias("s_slot"), "start", "source_size", "target")
    rows = rows.join(s, rows.source.eqNullSafe(s.s_source) & (rows.slot == s.s_slot)).drop("s_source", "s_slot")
    finish = lambda e: (F.col("source_size") * e + F.col("start") + F.col("within")).cast("double") / F.col("target")
    live = (F.col("size") > 0) & (F.col("target") > 0)
    rows = materialize(rows.select("doc_id", "h", "size", "source_size", "target", F.when(live, F.array(*[finish(e) for e in range(repeats)])).alias("finish")), "mix-finish")
    copies = rows.select("doc_id", "h", "size", F.explode("finish").alias("at")).where("at < 2")
    copies = copies.withColumn("tick", F.floor(F.col("at") * BUCKETS))
    run = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    ticks = copies.groupBy("tick").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run))
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("b")).first()["b"]
    over = ticks.where(F.col("upto") > F.lit(budget)).orderBy("tick").limit(1).first()
    if over is None:
        taken = lambda at: at < 2
    else:
        cut = copies.where(F.col("tick") == over["tick"]).withColumn("upto", F.lit(over["upto"] - over["words"]) + F.sum("size").over(Window.orderBy("at", "h", "doc_id")))
        last = cut.where(F.col("upto") <= F.lit(budget)).agg(F.max(F.struct("at", "h")).alias("k")).first()["k"]
        if last is None:
            taken = lambda at: F.floor(at * BUCKETS) < over["tick"]
        else:
            taken = lambda at: (at < last["at"]) | ((at == last["at"]) & (F.col("h") <= last["h"]))
    times = F.coalesce(F.aggregate("finish", F.lit(0), lambda n, at: n + F.when(taken(at), 1).otherwise(0)), F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def _with_targets(slots: DataFrame, targets: DataFrame) -> DataFrame:
    t = small(targets.withColumnRenamed("source", "t_source"), 10_000)
    return slots.join(t, slots.source.eqNullSafe(F.col("t_source"))).drop("t_source")
