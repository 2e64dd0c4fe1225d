"""A retrieval index of vectors in cells: built, appended to, reloaded and queried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that the centres are fitted on at most; every row is indexed.
FIT_ROWS = 100_000


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class Index:
    """Vectors in cells around centres, as a table partitioned by cell under ``path``.

    Null vectors are left out. A query is compared with the vectors of its
    ``probes`` nearest cells; with as many probes as cells the search is exact.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # a row per cell
        self.centres = np.array([r["centre"] for r in rows], np.float64)

    @classmethod
    def build(cls, chunks: DataFrame, key: str, vector: str, path: str, cells: int = 64, seed: int = 1) -> Index:
        """Fits the centres on at most FIT_ROWS rows by hash order, and writes the index."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = chunks.sparkSession
        rows = chunks.where(F.col(vector).isNotNull())
        n = rows.count()
        share = min(1.0, FIT_ROWS / max(1, n))
        drawn = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(2**40)) < int(2**40 * share))
        unit = F.transform(vector, lambda x: x.cast("double"))
        if n:
            model = KMeans(k=max(1, min(cells, n)), seed=seed, distanceMeasure="cosine", featuresCol="_x").fit(drawn.select(array_to_vector(unit).alias("_x")))
            centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
        else:
            centres = []
        spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index = cls(spark, path)
        index._write(rows, key, vector, "overwrite")
        return index

    def append(self, chunks: DataFrame, key: str, vector: str) -> None:
        """Adds rows to the cells there are."""
        self._write(chunks.where(F.col(vector).isNotNull()), key, vector, "append")

    def _write(self, rows: DataFrame, key: str, vector: str, mode: str) -> None:
        placed = self._nearest(rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector")), 1)
        placed.repartition("cell").write.mode(mode).option("compression", "zstd").partitionBy("cell").parquet(f"{self.path}/rows")

    def _nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` (key, vector) once for each of their nearest cells."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(centres):
                    continue
                near = np.argsort(-(_unit(b.column(1)) @ centres.T / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)), axis=1)[:, :probes]
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["key", "vector", "cell"])

        return rows.mapInArrow(run, "key long, vector array<float>, cell int")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("key long, vector array<float>, cell int").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int = 8) -> DataFrame:
        """(query_id, key, cosine, rank): the k best of the probed cells for each query, itself left out; ties by key.

        Queries meet rows in their cells; ranks are limited in each task before
        the shuffle, so k rows a query and task are moved.
        """
        from lexiloom.functions.arrays import cosine

        q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
        q = self._nearest(q, probes).select(F.col("key").alias("query_id"), F.col("vector").alias("_q"), "cell")
        met = self.rows().join(q, "cell").where(F.col("key") != F.col("query_id")).select("query_id", "key", "cell", cosine("_q", "vector").alias("cosine"))
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "key")
        return met.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "key", "cosine", "rank")
