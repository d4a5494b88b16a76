"""Incremental ingest: a stream of coordinates appended to a table, with running per-group aggregates.

The analogue of shard-at-a-time appends: every micro-batch is canonicalised and written once (by its batch id), so a
restarted stream doesn't write a batch twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.plans.dataset import canonical


def append_stream(coo: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of (cell_ix, gene_ix, value) to path, one folder a micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        canonical(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = coo.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def read_appended(spark, path: str) -> DataFrame:
    """All appended values; entries of several batches add up."""
    return canonical(spark.read.parquet(path).select("cell_ix", "gene_ix", "value"))


def windowed_totals(events: DataFrame, ts: str, value: str, by: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sums and counts per tumbling event-time window; batch or streaming (late rows beyond the watermark are left out)."""
    w = F.window(F.col(ts), window)
    return events.withWatermark(ts, late).groupBy(w, *by).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "total", "n")
