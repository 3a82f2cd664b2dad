"""The audit log: JSON lines appended by the service, read as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("type", T.StringType()), T.StructField("client", T.StringType()), T.StructField("cmd", T.StringType()),
    T.StructField("exit", T.IntegerType()), T.StructField("dur_s", T.LongType()), T.StructField("cached", T.BooleanType()),
])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's events; lines that aren't JSON are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append_log(events: DataFrame, path: str) -> None:
    events.select([f.name for f in SCHEMA.fields]).write.mode("append").json(path)


def summarise(events: DataFrame) -> DataFrame:
    """Events, clients and first and last time of each type."""
    return events.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("client").alias("n_clients"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and time window, and how many came from the cache; for streams, events later than `late` are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("cached", F.lit(False))).alias("n_cached"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "n", "n_cached")


def start_windows(spark: SparkSession, path: str, out: str, checkpoint: str, **options):
    """Write the windows of a growing log folder as Parquet, each once it is complete."""
    rows = windows(stream_log(spark, path), **options)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
