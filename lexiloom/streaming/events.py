"""Structured Streaming: what of the text operators works on streams, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import lower_words


def stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(df: DataFrame, width: str, late: str | None = "10 minutes") -> DataFrame:
    """(window, event_type, n, total); on streams late rows count within the watermark (None: one is set before)."""
    if df.isStreaming and late:
        df = df.withWatermark("ts", late)
    return df.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, width: str, step: str, late: str | None = "10 minutes") -> DataFrame:
    if df.isStreaming and late:
        df = df.withWatermark("ts", late)
    return df.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))


def keep_first(df: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state is dropped with the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def word_counts(df: DataFrame, text: str, width: str, late: str | None = "10 minutes") -> DataFrame:
    if df.isStreaming and late:
        df = df.withWatermark("ts", late)
    return df.select("ts", F.explode(lower_words(text)).alias("word")).groupBy(F.window("ts", width), "word").agg(F.count("*").alias("n"))


def with_dimension(df: DataFrame, dimension: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """A stream joined with a static table."""
    return df.join(dimension.select(on, *columns), on, "left")
