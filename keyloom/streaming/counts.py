"""The word count and a windowed event count as streams: optional, the reference is batch only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_word_totals(docs: DataFrame, text: str) -> DataFrame:
    """Running totals of words; for output modes complete and update."""
    return docs.select(F.explode(F.split(text, r"\s+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): events of each tumbling window; those later than the watermark are dropped, and windows behind it leave the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
