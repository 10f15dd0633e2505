"""Structured Streaming over growing folders of run rows: each question once, with resumable progress, and live KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Run rows as they are written (Parquet)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_rows(stream: DataFrame, key: str = "qid", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_kpis(stream: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 hour", slide: str | None = None, rank: str = "rank") -> DataFrame:
    """Per (sliding) window: rows, found, top-4 and mean rank; a window is final when the watermark passes it."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w")).agg(F.count("*").alias("rows"), F.count(rank).alias("found"), F.count_if(F.col(rank) <= 4).alias("top4"), F.avg(rank).alias("mean_rank")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "found", "top4", "mean_rank")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there, then stop; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
