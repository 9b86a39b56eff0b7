"""Streams into tables, by key or by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.sources import tables


def upsert_stream(stream: DataFrame, name: str, keys: list[str], checkpoint: str, once: bool = False, latest: str | None = None) -> StreamingQuery:
    """Each micro-batch replaces the rows of its keys, as an incremental model with a unique key does.

    Of several rows of a key in a batch the one with the greatest `latest` counts, then that with the greatest
    columns, so a batch that runs again after a failure gives the same table.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        order = F.struct(*[F.col(f"`{c}`") for c in (rest if not latest else [latest, *(c for c in rest if c != latest)])]) if rest else F.lit(0)
        last = batch.groupBy(*keys).agg(F.max(order).alias("_last")).select(*[F.col(f"`{c}`") if c in keys else F.col(f"_last.`{c}`").alias(c) for c in batch.columns])
        tables.upsert(spark, last, name, keys) if tables.exists(spark, name) else tables.write_table(spark, last, name)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, *by: str) -> DataFrame:
    """Counts by tumbling window and columns; rows later than `lateness` behind the newest are dropped, which bounds the state."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("window"), *by).count()
