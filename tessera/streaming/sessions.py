"""Event sessions over unbounded input; beyond the batch operators' parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def gap_sessions(events: DataFrame, time: str, by: list[str], gap: str = "90 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end when nothing comes for gap; rows later than the watermark are dropped, as the watermark says."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(*by, F.session_window("_t", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def index_stream(events: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's unseen keys to target; a batch that runs again adds nothing."""
    from tessera.sources.tables import append_unique

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_unique(batch, target, keys)).trigger(availableNow=True).start()
