"""Streaming twins of the log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import scratch_path


def progress(spark: SparkSession, path: str, width: str, late: str = "10 minutes", failed: str = "error") -> DataFrame:
    """(hour, n, failed, per_second, tokens): events (ts, event_type, value) counted in tumbling windows by a stream.

    The stream reads all files there are and ends. It appends each window to Parquet files in the shared folder once the
    watermark has passed it, so neither state nor driver holds all windows; rows later than `late` are left out, as in a
    stream that goes on. So that rows of the files read here aren't late by the order of files, they are read in one batch.
    The last windows are closed by a row of the far future, which is not counted.
    """
    source = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/[{name[0]}]{name[1:]}")
    end, out, seen = scratch_path(spark, "stream-end"), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-log")
    source.limit(1).withColumn("ts", F.lit("9999-01-01").cast(source.schema["ts"].dataType)).write.parquet(end)
    closing = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(end)
    at = F.col("ts").cast("timestamp")
    every = stream.unionByName(closing).withColumn("at", at).withWatermark("at", late)
    windows = every.groupBy(F.window("at", width)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == failed).alias("failed"), F.sum("value").alias("tokens"))
    rows = windows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "failed", (F.col("n") / (F.unix_timestamp("window.end") - F.unix_timestamp("window.start"))).alias("per_second"), "tokens")
    run = rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(rows.schema).parquet(out).where(F.year("hour") < 9999)
    return got.select("hour", "n", "failed", F.round("per_second", 6).alias("per_second"), F.round("tokens", 2).alias("tokens"))
