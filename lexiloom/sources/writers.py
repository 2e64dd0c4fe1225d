"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def category_json(df: DataFrame, path: str, text: str, flags: list[str]) -> None:
    """JSON lines {text, cats: {flag: bool}}."""
    df.select(F.col(text).alias("text"), F.struct(*[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in flags]).alias("cats")).write.mode("overwrite").json(path)


def lines(df: DataFrame, path: str, text: str) -> None:
    """One row a line; line feeds and backslashes inside a text are escaped."""
    df.where(F.col(text).isNotNull()).select(F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))).write.mode("overwrite").text(path)


def documents(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Nested columns to Parquet, by a column if given."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


def metrics(spark: SparkSession, values: dict[str, float], path: str) -> None:
    spark.createDataFrame([tuple(values.values())], list(values)).coalesce(1).write.mode("overwrite").json(path)


def vocabulary(vocab: DataFrame, path: str) -> None:
    """(token, id) as JSON lines in the order of the id; ``readers.vocabulary`` reads it."""
    vocab.select("token", "id").orderBy("id").write.mode("overwrite").json(path)


def model(fitted, path: str) -> None:
    """A fitted Spark ML pipeline; ``readers.model`` reads it."""
    fitted.write().overwrite().save(path)
