"""Claims as a stream: monthly sums kept up to date, late lines included until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Count and sum of values by type and window; works on a stream and on a table alike."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def refresh_months(claims: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of claim lines keeps its own sums of the months it touches in a folder of its own, written anew if the batch is played again."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("member_id", "month_index").agg(F.sum(F.col("paid_amount").cast("decimal(18,2)")).alias("paid_amount"), F.count("*").alias("total_lines"))
        sums.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return claims.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly(spark: SparkSession, path: str) -> DataFrame:
    """The sums so far: batches add up, so that a month is read as the sum of its parts."""
    return spark.read.parquet(path).groupBy("member_id", "month_index").agg(F.sum("paid_amount").cast("double").alias("paid_amount"), F.sum("total_lines").alias("total_lines"))
