"""Streaming forms, an extension: running winners per group, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_winners(candidates: DataFrame) -> DataFrame:
    """case_id, field, cand_id, rank of the best record so far; state holds one record per group. Output mode update."""
    order = F.struct(F.coalesce("authority_rank", F.lit(-1)), F.coalesce("confidence", F.lit(-1.0)), -F.col("sequence").cast("long"), -F.col("cand_id"))
    valid = candidates.filter("field IS NOT NULL AND normalized_value IS NOT NULL AND confidence BETWEEN 0 AND 1")
    return valid.groupBy("case_id", "field").agg(F.max_by(F.struct("cand_id", "authority_rank"), order).alias("r")).select("case_id", "field", F.col("r.cand_id").alias("cand_id"), F.col("r.authority_rank").alias("rank"))


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """begin, kind, events, value per tumbling window; records later than the watermark are left out. Output mode append."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, size), kind)
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("begin"), kind, "events", "value")
    )


def upsert_winners(candidates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the running winners as a table that each batch writes anew under its number: restarts repeat a batch safely."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return running_winners(candidates).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
