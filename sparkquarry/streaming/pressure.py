"""Pressure levels over a stream: watermark and tumbling windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.store import shared_dir


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events(ts, event_type, value), a stream or a table -> window_start, event_type, n, mean."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean")


def run_available(spark: SparkSession, path: str) -> DataFrame:
    """All events of a parquet table through the stream, to a written table. Windows still open when the input ends are not emitted in append mode, so updates are written and the last one of each window counts."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))

    def sink(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{root}/out/batch={k}")

    windowed(events).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(lambda b, k: sink(b.drop("batch"), k)).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("mean", "batch").alias("mean"))
