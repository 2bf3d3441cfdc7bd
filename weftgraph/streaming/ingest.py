"""Streams into the graph. The graph's own source has none; this lets it follow events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counts of a window stay open for so long.
LATENESS = "2 hours"


def events(spark: SparkSession, path: str, schema: str, files_each: int = 16) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def new_mentions(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event once, even if it arrives again within the lateness."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def mention_counts(stream: DataFrame, size: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Mentions by type and tumbling window; late ones count until the watermark passes."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type").agg(
        F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")
    ).select("window.start", "window.end", "event_type", "n", "users")


def append_graph(stream: DataFrame, path: str, checkpoint: str):
    """Write new mentions as nodes of the graph, exactly once by the sink's log."""
    nodes = new_mentions(stream).select(
        F.col("event_id").alias("ord"), F.concat(F.lit("U:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("type"), "ts"
    )
    return nodes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
