"""What several operators share: document keys, joins by checked size, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many bytes; above, the join is shuffled.
BROADCAST_BYTES = 8 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """(row, k1, k2, doc_id, text, body): the whole row as a struct, so that no column of the
    caller can clash, a key that also tells rows with the same or no doc_id apart, the
    text (null: empty) and its UTF-8 bytes. Rows that are equal in both share the key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("k1"),
        F.xxhash64(F.lit(7), text).alias("k2"),
        F.col("doc_id"),
        text.alias("text"),
        text.cast("binary").alias("body"),
    )


def join_checked(big: DataFrame, stored: DataFrame, keys: list[str], how: str, size: Column | None = None) -> DataFrame:
    """Join with a stored table. Its size is measured; only below ``BROADCAST_BYTES`` is it
    broadcast, which spares the shuffle of the texts; a larger one is a shuffle join."""
    row = size if size is not None else F.lit(16 * len(stored.columns))
    total = stored.agg(F.sum(row.cast("long"))).first()[0] or 0
    return big.join(F.broadcast(stored) if total <= BROADCAST_BYTES else stored, keys, how)


def map_rows(df: DataFrame, schema: str, rows: Callable[[dict[str, list]], Iterable[tuple]], names: list[str], types: list[pa.DataType], at_once: int = 50_000) -> DataFrame:
    """Apply ``rows`` to the columns of each Arrow batch; its tuples become rows, sent on in
    batches of ``at_once``, so a long document cannot build one huge batch."""
    fields = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for row in rows(columns):
                held.append(row)
                if len(held) >= at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=fields)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=fields)

    return df.mapInArrow(run, schema)
