"""Arrival rates of a stream with keyed state in the state store.

State is kept for each key and time slot, not for each key: a key with a third of all rows
spreads over as many groups as it fills slots, and a group holds one slot of one micro-batch.
What a slot cannot know, the gap of its first row, is settled by ``complete_rates`` from one
row per slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from evidence_spark.operators.ordered import exact_percentile, ordered_lag, rate_of_gap
from evidence_spark.session import scratch_table, sized

# processing-time timers would ask for one empty batch after another; they fire with the next data instead
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings that keyed state needs, for queries started inside only."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class SlotGaps(StatefulProcessor):
    """Time since the row before, within one slot of one key.

    State is the last time of the slot. Rows behind it, from a later micro-batch, are late.
    A timer clears the state of a slot that got no row for ``expire_ms``.
    """

    def __init__(self, time_us: str, tie: str, expire_ms: int):
        self.time_us, self.tie, self.expire_ms = time_us, tie, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[1]):  # rows without a time have neither gap nor order
            for part in rows:
                yield part.assign(gap_us=None, late=False, head=False)
            return
        held = pd.concat(list(rows), ignore_index=True).sort_values([self.time_us, self.tie], ignore_index=True)
        times = held[self.time_us].to_numpy(np.int64)
        known = self.last.get()[0] if self.last.exists() else None
        late = np.zeros(len(times), bool) if known is None else times < known
        on_time = times[~late]
        if len(on_time):
            gaps = np.diff(on_time, prepend=on_time[0] if known is None else known)
            gap_us = pd.array([None] * len(times), dtype="Int64")
            gap_us[~late] = gaps
            head = np.zeros(len(times), bool)
            if known is None:
                gap_us[0], head[0] = pd.NA, True
            self.last.update((int(on_time[-1]),))
            yield held.assign(gap_us=gap_us, late=late, head=head)
        else:
            yield held.assign(gap_us=None, late=late, head=False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_gaps(stream: DataFrame, key: str, time_us: str, tie: str, slot_us: int = 1_000_000, expire_ms: int = 3_600_000) -> DataFrame:
    """The rows as (key, time, tie, slot, gap_us, late, head). ``head`` marks the first row
    that a slot received, whose gap reaches back into an earlier slot."""
    rows = stream.select(key, F.col(time_us).cast("bigint").alias(time_us), tie).withColumn("slot", F.floor(F.col(time_us) / F.lit(slot_us)).cast("bigint"))
    schema = StructType([*rows.schema.fields, StructField("gap_us", LongType()), StructField("late", BooleanType()), StructField("head", BooleanType())])
    return rows.groupBy(key, "slot").transformWithStateInPandas(
        SlotGaps(time_us, tie, expire_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime"
    )


def collect_gaps(gaps: DataFrame, path: str, checkpoint: str):
    """Append what is available now to the table at ``path``; a run after a stop or a failure
    goes on from the state, and each row is committed once."""
    with keyed_state(gaps.sparkSession):
        query = (
            gaps.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return query


def complete_rates(table: DataFrame, key: str, time_us: str, tie: str) -> DataFrame:
    """(key, time, tie, frequency, late) of the collected gaps.

    The first row of a slot is measured from the last row of the slot before it. A second
    head of a slot came after its state had expired and counts as late. Late rows have no
    rate; other rows without one, as the first of a key or rows without a time, get the
    median of their key (null where the key has no rate).
    """
    slots = table.filter(~F.col("late") & F.col("slot").isNotNull()).groupBy(key, "slot").agg(
        F.max(time_us).alias("_last"), F.min(F.when(F.col("head"), F.struct(time_us, tie))).alias("_first")
    )
    before = ordered_lag(slots, [key], ["slot"], ["_last"]).select(F.col(key).alias("_key"), F.col("slot").alias("_slot"), "_first", F.col("prev__last").alias("_before"))
    heads = table.filter("head").join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slot") == F.col("_slot")), "left")
    again = F.struct(time_us, tie) > F.col("_first")
    settled = heads.select(key, time_us, tie, F.when(~again, F.col(time_us) - F.col("_before")).alias("gap_us"), again.alias("late"))
    rows = table.filter(~F.col("head")).select(key, time_us, tie, "gap_us", "late").unionByName(settled)
    rated = rows.withColumn("_rate", rate_of_gap(F.col("gap_us") / F.lit(1e6))).withColumn("_group", F.to_json(F.struct(key)))
    rated = scratch_table(rated, "rates")  # the group is never null, so rows without a key have a median as well
    medians = sized(exact_percentile(rated, ["_group"], "_rate", 0.5, "_median"), "medians")
    filled = rated.join(medians, "_group", "left")
    return filled.select(key, time_us, tie, F.when(~F.col("late"), F.coalesce("_rate", "_median")).alias("frequency"), "late")
