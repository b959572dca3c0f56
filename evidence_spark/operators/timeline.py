"""Paths along the whole timeline.

``then`` edges link each event to the next one, and sources and targets have arcs in one
direction only, so the path between two events runs through all events between them: its
length is the difference of their ranks and its risk the highest risk in that range. Ranges
are answered by an index, and no path is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.operators.ordered import event_rank
from evidence_spark.session import scratch_table

BLOCK = 1024


def ranked_events(events: DataFrame, order: list[str]) -> DataFrame:
    """(rank from 1, id, risk) by time; a missing risk counts as 0."""
    rows = events.select(*order, F.concat(F.lit("event-"), F.col("sequence").cast("string")).alias("id"), F.coalesce("risk", F.lit(0.0)).alias("risk"))
    return scratch_table(event_rank(rows, order).select("rank", "id", "risk"), "timeline")


@dataclass
class RiskIndex:
    """``blocks``: risks and running highest risk of ``BLOCK`` ranks each. ``jumps``: highest
    risk of the 2^level blocks from ``block`` on, made by doubling; it has one row per level
    for ``BLOCK`` events."""

    blocks: DataFrame
    jumps: DataFrame
    last: int


def risk_index(ranked: DataFrame) -> RiskIndex:
    numbered = ranked.withColumn("block", F.floor((F.col("rank") - 1) / F.lit(BLOCK)).cast("bigint"))
    upto = Window.partitionBy("block").orderBy("rank")
    lists = numbered.withColumn("_run", F.max("risk").over(upto)).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "risk", "_run"))).alias("_l")  # at most BLOCK entries
    )
    blocks = scratch_table(lists.select("block", F.col("_l.id").alias("ids"), F.col("_l.risk").alias("risks"), F.col("_l._run").alias("highest"), F.array_max("_l.risk").alias("top")), "risk-blocks")
    last = blocks.agg(F.max("block")).first()[0]
    level = scratch_table(blocks.select(F.lit(0).alias("level"), "block", "top"), "jumps")
    jumps, width = level, 1
    while last is not None and 2 * width <= last + 1:
        after = level.select((F.col("block") - width).alias("block"), F.col("top").alias("_top"))
        level = scratch_table(level.join(after, "block").select((F.col("level") + 1).alias("level"), "block", F.greatest("top", "_top").alias("top")), "jumps")
        jumps, width = jumps.unionByName(level), 2 * width
    return RiskIndex(blocks, scratch_table(jumps, "all-jumps"), -1 if last is None else last)


def paths_from(roots: DataFrame, index: RiskIndex) -> DataFrame:
    """(source, target, length, risk) of the paths from each root (``rank``, ``id``) to every
    later event. A root meets blocks, not events; two jumps cover the blocks between them."""
    own = roots.distinct().select(
        F.col("rank").alias("_rank"), F.col("id").alias("source"), F.floor((F.col("rank") - 1) / F.lit(BLOCK)).cast("bigint").alias("_own")
    )
    own = own.join(index.blocks.select(F.col("block").alias("_own"), F.col("risks").alias("_risks")), "_own")
    own = own.withColumn("_at", ((F.col("_rank") - 1) % BLOCK + 1).cast("int")).withColumn("_left", F.array_max(F.slice("_risks", F.col("_at"), BLOCK))).drop("_risks")
    met = own.withColumn("block", F.explode(F.sequence("_own", F.lit(index.last).cast("bigint"))))
    between = F.col("block") - F.col("_own") - 1
    met = met.withColumn("_level", F.when(between > 0, F.length(F.bin(between)) - 1))
    first = index.jumps.select(F.col("level").alias("_level"), (F.col("block") - 1).alias("_own"), F.col("top").alias("_a"))
    second = index.jumps.select(F.col("level").alias("_level"), (F.col("block") + F.expr("shiftleft(1L, level)")).alias("block"), F.col("top").alias("_b"))
    met = met.join(first, ["_level", "_own"], "left").join(second, ["_level", "block"], "left")
    met = met.withColumn("_before", F.greatest("_left", "_a", "_b")).join(index.blocks, "block")
    ends = met.select("source", "_rank", "_own", "block", "_at", "_before", "risks", F.posexplode(F.arrays_zip("ids", "highest")).alias("_pos", "_e"))
    same = F.col("block") == F.col("_own")
    inside = F.array_max(F.slice("risks", F.col("_at"), F.greatest(F.col("_pos") + 2 - F.col("_at"), F.lit(0))))
    length = F.col("block") * BLOCK + F.col("_pos") + 1 - F.col("_rank")
    return ends.filter(length > 0).select(
        "source", F.col("_e.ids").alias("target"), length.cast("bigint").alias("length"),
        F.when(same, inside).otherwise(F.greatest("_before", "_e.highest")).alias("risk"),
    )


def best_paths(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best of the paths between all events, by risk, length, source and target.

    An event of the highest risk lies on a path of every length, so with more than ``n``
    events the best ``n`` all have that risk and at most ``n`` steps. Lengths are taken one
    after another until there are enough paths. Fewer events have all their paths listed.
    """
    count, top = ranked.agg(F.count(F.lit(1)), F.max("risk")).first()
    if count <= n:
        found = paths_from(ranked.select("rank", "id"), risk_index(ranked))
        start = ranked.select(F.col("id").alias("source"), F.col("rank").alias("_start"))
        best = found.join(start, "source").orderBy(F.desc("risk"), "length", "source", "target").limit(n)
    else:
        hot = ranked.filter(F.col("risk") == F.lit(top)).select("rank")
        chosen, enough = None, 0
        for length in range(1, n + 1):
            starts = hot.select(F.explode(F.sequence(F.greatest(F.lit(1), F.col("rank") - length), F.least("rank", F.lit(count - length)))).alias("_start"))
            starts = scratch_table(starts.filter(F.col("_start").between(1, count - length)).distinct().withColumn("length", F.lit(length).cast("bigint")), "best-starts")
            chosen = starts if chosen is None else chosen.unionByName(starts)
            enough += starts.count()
            if enough >= n:
                break
        source = ranked.select(F.col("rank").alias("_start"), F.col("id").alias("source"))
        target = ranked.select(F.col("rank").alias("_end"), F.col("id").alias("target"))
        named = chosen.join(source, "_start").withColumn("_end", F.col("_start") + F.col("length")).join(target, "_end")
        best = named.withColumn("risk", F.lit(top)).orderBy("length", "source", "target").limit(n)
    steps = best.withColumn("rank", F.explode(F.sequence("_start", F.col("_start") + F.col("length")))).join(ranked.select("rank", "id"), "rank")
    texts = steps.groupBy("source", "target", "length", "risk").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("_p"))
    return texts.select("source", "target", F.array_join("_p.id", " > ").alias("path"), "length", F.lit(True).alias("temporal"), "risk").orderBy(F.desc("risk"), "length", "source", "target")
