"""Reading the test tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(column: str):
    """Trimmed and in lower case; blank becomes null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", ""))), F.lit(""))


def in_order(rows: DataFrame, key: str) -> Iterator[Row]:
    """All rows in the order of a hash of their key, a partition at a time."""
    return rows.orderBy(F.pmod(F.xxhash64(F.col(key)), F.lit(2**40)), key).toLocalIterator()


def drawn(rows: DataFrame, key: str, n: int) -> list:
    """At most ``n`` rows in the order of a hash of their key; a threshold of the hash keeps all but about three times as many from the driver."""
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(2**40))
    upto = int(2**40 * min(1.0, 3 * n / max(1, rows.count())))
    return rows.where(h < upto).orderBy(h, key).limit(n).collect()
