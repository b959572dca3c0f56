"""Order-dependent operators that never put a whole log or a whole group in one task.

All of them place the rows by range over the full order (grouping columns first) and
write that placement once. A partition then holds one contiguous run of the order, so
work inside partitions plus one small row per partition gives the global answer, no
matter how the rows spread over the groups. The order columns must identify a row:
ties would all land in one partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from evidence_spark import policy
from evidence_spark.session import scratch_table, shuffle_partitions, sized

_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def place_by_range(
    df: DataFrame, order: list[str], label: str = "ordered", lags: list[str] | None = None, sums: list[str] | None = None,
) -> DataFrame:
    """``df`` in range partitions over ``order`` with ``_part`` and ``_pos`` (0-based
    position within the partition), materialised so that both stay fixed. While a partition
    still stands in order, ``lags`` gives ``_lag_<column>`` of the row before and ``sums``
    ``_in_<column>``, the running sum up to the row, both within the partition."""
    parts = shuffle_partitions(df.sparkSession)
    row_id = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", row_id)
        .withColumn("_part", F.shiftright("_row", _POS_BITS).cast("int"))
        .withColumn("_pos", F.col("_row").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop("_row")
    )
    if lags or sums:
        types = placed.schema
        carried = [StructField(f"_lag_{c}", types[c].dataType) for c in lags or []] + [StructField(f"_in_{c}", types[c].dataType) for c in sums or []]
        placed = placed.mapInArrow(_carrier(lags or [], sums or []), StructType([*types.fields, *carried]))
    return scratch_table(placed, label)


def _carrier(lags: list[str], sums: list[str]):
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, totals = {}, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, names = list(batch.columns), list(batch.schema.names)
            for c in lags:
                column = batch.column(c)
                before = last.get(c, pa.nulls(1, column.type))
                columns.append(pa.concat_arrays([before, column.slice(0, len(column) - 1)]))
                last[c] = column.slice(len(column) - 1)
            for c in sums:
                summed = pc.cumulative_sum(pc.fill_null(batch.column(c), 0), start=totals[c])
                columns.append(summed)
                totals[c] = summed[-1].as_py()
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f"_lag_{c}" for c in lags), *(f"_in_{c}" for c in sums)])

    return carry


def _part_offsets(placed: DataFrame, measures: list[str]) -> DataFrame:
    """Sum of each measure over all earlier partitions: one row per partition."""
    rows = placed.groupBy("_part").agg(*(F.sum(m).cast("bigint").alias(m) for m in measures)).orderBy("_part").collect()
    running = dict.fromkeys(measures, 0)
    offsets = []
    for row in rows:
        offsets.append((row["_part"], *(running[m] for m in measures)))
        for m in measures:
            running[m] += row[m]
    schema = "_part int, " + ", ".join(f"_before_{m} bigint" for m in measures)
    return placed.sparkSession.createDataFrame(offsets, schema)


def running_totals(df: DataFrame, order: list[str], measures: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of whole-number measures over the global order."""
    names = list(measures)
    placed = place_by_range(df.withColumns({m: c.cast("bigint") for m, c in measures.items()}), order, "totals", sums=names)
    offsets = _part_offsets(placed, names)
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.select(
        *(c for c in df.columns if c not in names),
        *((F.col(f"_in_{m}") + F.col(f"_before_{m}")).alias(m) for m in names),
    )


def global_sequence(df: DataFrame, order: list[str], name: str = "sequence", start: int = 1) -> DataFrame:
    """Gap-free numbers over the global order."""
    placed = place_by_range(df, order, "sequence")
    counted = placed.select("_part", F.lit(1).alias("_n"))
    offsets = _part_offsets(counted, ["_n"])
    return placed.join(F.broadcast(offsets), "_part").select(
        *(c for c in df.columns if c != name),
        (F.col("_before__n") + F.col("_pos") + F.lit(start)).cast("bigint").alias(name),
    )


@dataclass(frozen=True)
class Ranges:
    """Ranges of a global order: the number of rows before each and in each, and a column
    that tells the range of a row."""
    starts: list[int]
    sizes: list[int]
    column: Column


def whole_ranges(df: DataFrame, order: list[str], multiple: int, least_rows: int = 16384) -> Ranges:
    """Cut the order into ranges of about equal size, each a whole number of ``multiple``
    rows but the last. Only the order columns are moved for it; the rows themselves can then
    go to their range in one shuffle, and are numbered there. A cut that would part
    rows of equal order is left out. Order columns are of plain types (not binary)."""
    placed = place_by_range(df.select(*order), order, "keys")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    total = sum(row["n"] for row in counts)
    wanted_ranges = max(1, min(shuffle_partitions(df.sparkSession), -(-total // least_rows)))
    span = max(1, -(-total // (wanted_ranges * multiple))) * multiple
    wanted, before = [], 0
    for row in counts:
        upto = before + row["n"]
        for edge in range(span * max(1, before // span), min(total, upto + 1), span):
            wanted.extend((row["_part"], at - before, edge) for at in (edge - 1, edge) if before <= at < upto)
        before = upto
    types = placed.schema
    spark = df.sparkSession
    places = spark.createDataFrame(wanted, "_part int, _pos bigint, _edge bigint")
    keys, texts = F.struct(*order), F.struct(*(F.col(c).cast("string").alias(c) for c in order))
    cuts = placed.join(F.broadcast(places), ["_part", "_pos"]).groupBy("_edge").agg(
        F.max_by(texts, F.struct("_part", "_pos")).alias("_key"), (F.min(keys) < F.max(keys)).alias("_apart")
    ).filter("_apart").orderBy("_edge").collect()
    edges = [F.struct(*(F.lit(row["_key"][c]).cast(types[c].dataType).alias(c) for c in order)) for row in cuts]

    def number(low: int, high: int) -> Column:
        """Number of edges not above the key, which is between ``low`` and ``high``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(keys < edges[middle], number(low, middle)).otherwise(number(middle + 1, high))

    starts = [0, *(row["_edge"] for row in cuts)]
    sizes = [b - a for a, b in zip(starts, [*starts[1:], total])]
    return Ranges(starts, sizes, number(0, len(edges)))


def ordered_lag(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """``cols`` of the row before, per group, in the given order."""
    carried = list(dict.fromkeys([*keys, *cols]))
    placed = place_by_range(df, [*keys, *order], "lag", lags=carried)

    parts = [row["_part"] for row in placed.select("_part").distinct().orderBy("_part").collect()]
    following = placed.sparkSession.createDataFrame(list(zip(parts, parts[1:])), "_part int, _next int")
    last_rows = placed.groupBy("_part").agg(F.max_by(F.struct(*carried), "_pos").alias("_edge"))
    edges = last_rows.join(F.broadcast(following), "_part").select(F.col("_next").alias("_part"), "_edge")

    joined = placed.join(F.broadcast(edges), "_part", "left")
    inside = F.struct(*(F.col(f"_lag_{c}").alias(c) for c in carried))
    before = F.when(F.col("_pos") == 0, F.col("_edge")).otherwise(inside)
    joined = joined.withColumn("_before", before)
    same_group = F.col("_before").isNotNull()
    for key in keys:
        same_group = same_group & F.col(f"_before.{key}").eqNullSafe(F.col(key))
    return joined.select(
        *df.columns,
        *(F.when(same_group, F.col(f"_before.{c}")).alias(f"{prefix}{c}") for c in cols),
    )


def exact_percentile(df: DataFrame, keys: list[str], value: str, fraction: float | DataFrame, name: str = "percentile") -> DataFrame:
    """Exact percentile with linear interpolation, one row per group.

    Counts per distinct value are added up along the global order, so the largest
    group costs no single task more than any other. ``fraction`` is one number, or a
    table of ``keys`` and ``fraction``.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    summed = running_totals(counted.withColumn("_upto", F.col("_c")), [*keys, value], {"_upto": F.col("_c")})
    spans = summed.groupBy(*keys).agg(F.sum("_c").alias("_total"), F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    if isinstance(fraction, DataFrame):
        spans = spans.join(sized(fraction, "fractions"), keys)
    else:
        spans = spans.withColumn("fraction", F.lit(float(fraction)))
    spans = (
        spans.withColumn("_h", F.col("fraction") * (F.col("_total") - 1))
        .withColumn("_lo", F.floor("_h"))
        .withColumn("_hi", F.ceil("_h"))
    )
    index_from = F.col("_upto") - F.col("_c") - F.col("_start")
    index_to = F.col("_upto") - F.col("_start")
    at = lambda i: (index_from <= F.col(i)) & (F.col(i) < index_to)
    low, high = F.max(F.when(at("_lo"), F.col(value))), F.max(F.when(at("_hi"), F.col(value)))
    picked = summed.join(sized(spans, "spans"), keys).filter(at("_lo") | at("_hi"))
    weight = F.max(F.col("_h") - F.col("_lo"))
    return picked.groupBy(*keys).agg((low + (high - low) * weight).alias(name))


def rate_of_gap(gap: Column) -> Column:
    """Inverse of a gap in seconds, at most 10000; null where there is no gap."""
    return F.when(gap.isNotNull(), F.least(F.lit(1.0) / F.greatest(gap, F.lit(1e-4)), F.lit(10000.0)))


def arrival_rate(df: DataFrame, key: str, time_us: str, tie: str, name: str = "frequency") -> DataFrame:
    """Inverse gap to the row before, per key, at most 10000 per second. The first row
    of a key takes the median of the others; a key with a single row gets null."""
    lagged = ordered_lag(df, [key], [time_us, tie], [time_us])
    gap = (F.col(time_us) - F.col(f"prev_{time_us}")) / F.lit(1e6)
    rated = scratch_table(lagged.withColumn("_rate", rate_of_gap(gap)).drop(f"prev_{time_us}"), "rate")
    medians = exact_percentile(rated, [key], "_rate", 0.5, "_median")
    filled = rated.join(sized(medians, "medians"), key, "left").withColumn(name, F.coalesce("_rate", "_median"))
    return filled.drop("_rate", "_median")


def rolling_count(df: DataFrame, keys: list[str], time_us: str, tie: str, seconds: int = 1, name: str = "frequency") -> DataFrame:
    """Rows in ``(t - seconds, t]`` up to and including the row itself.

    Every row also sends a probe to ``t - seconds``. Running counts over rows and probes
    together give both ends of the window, so a burst in one second is no hot spot.
    """
    base = df.select(*keys, time_us, tie)
    rows = base.withColumn("_at", F.col(time_us)).withColumn("_probe", F.lit(0))
    probes = base.withColumn("_at", F.col(time_us) - F.lit(seconds * 1_000_000)).withColumn("_probe", F.lit(1))
    summed = running_totals(rows.unionByName(probes), [*keys, "_at", "_probe", tie], {"_seen_rows": 1 - F.col("_probe")})
    ends = summed.groupBy(*keys, tie).agg(
        F.max(F.when(F.col("_probe") == 0, F.col("_seen_rows"))).alias("_here"),
        F.max(F.when(F.col("_probe") == 1, F.col("_seen_rows"))).alias("_before"),
    )
    counts = ends.select(*keys, tie, (F.col("_here") - F.col("_before")).cast("bigint").alias(name))
    return df.drop(name).join(counts, [*keys, tie])


def source_window_rate(df: DataFrame, src: str, time_us: str, tie: str) -> DataFrame:
    """The other documented packet rate: rows of the same source in the last second."""
    return rolling_count(df, [src], time_us, tie, 1, "frequency")


def link_check(df: DataFrame, sequence: str = "sequence", entry_hash: str = "entry_hash", previous_hash: str = "previous_hash") -> DataFrame:
    """Add ``expected_previous_hash`` and whether the stored one equals it."""
    lagged = ordered_lag(df, [], [sequence, entry_hash], [entry_hash])
    expected = F.coalesce(F.col(f"prev_{entry_hash}"), F.lit(policy.GENESIS_HASH))
    return (
        lagged.withColumn("expected_previous_hash", expected)
        .drop(f"prev_{entry_hash}")
        .withColumn("previous_hash_matches", F.coalesce(F.col(previous_hash) == F.col("expected_previous_hash"), F.lit(False)))
    )


def sequence_gaps(df: DataFrame, sequence: str = "sequence", tie: str | None = None) -> DataFrame:
    """Rows whose number is not one above the number before; the first must be 1."""
    order = [sequence] if tie is None else [sequence, tie]
    lagged = ordered_lag(df.select(*order), [], order, [sequence])
    expected = F.coalesce(F.col(f"prev_{sequence}"), F.lit(0)) + 1
    return lagged.withColumn("expected_sequence", expected).filter(F.col(sequence) != F.col("expected_sequence")).select(*order, "expected_sequence")


def event_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    return global_sequence(df, order, name)


def temporal_edges(df: DataFrame, node: str, time: str, tie: str) -> DataFrame:
    """A ``then`` edge from every event to the next one in time."""
    lagged = ordered_lag(df.select(node, time, tie), [], [time, tie], [node])
    return lagged.filter(F.col(f"prev_{node}").isNotNull()).select(
        F.col(f"prev_{node}").alias("source"), F.col(node).alias("target"), F.lit("then").alias("label"), F.lit(True).alias("temporal")
    )
