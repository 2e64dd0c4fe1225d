"""Vector similarity: search, joins, greedy deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries held in memory at once by ``nearest``; more are taken block by block. Pivots of ``angular_join`` and rows of a cell compared in one go.
QUERY_BLOCK, PIVOTS, CELL = 8_192, 64, 4_096
#: Open edges that ``keep_first_greedy`` goes through in one place rather than by joins.
FEW_EDGES = 100_000


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, same: bool = True) -> DataFrame:
    """(query_id, key, cosine, rank): the k nearest rows of the corpus for each query, exact; ties by key.

    Queries are counted first; up to QUERY_BLOCK of them are broadcast as one
    matrix, more are taken in blocks of that size. Each task keeps k rows a
    query, so k x queries x tasks rows are shuffled, never the corpus. With
    ``same`` a row does not find itself. Null vectors take no part.
    """
    spark = corpus.sparkSession
    queries = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("_q"))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = block.collect()  # at most about QUERY_BLOCK, by the count above
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), _unit([r["_q"] for r in rows]) if rows else np.zeros((0, 1))))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_k: list[pd.DataFrame] = []
            for pdf in frames:
                if not len(pdf) or not len(ids):
                    continue
                sim = q @ _unit(pdf[vector]).T
                keys = pdf[key].to_numpy(np.int64)
                if same:
                    sim[ids[:, None] == keys[None, :]] = -np.inf
                take = min(k, sim.shape[1])
                at = np.argpartition(-sim, take - 1, axis=1)[:, :take]
                kth = np.take_along_axis(sim, at, axis=1).min(axis=1)
                r, c = np.nonzero(sim >= kth[:, None])  # ties of the k-th too
                best_k.append(pd.DataFrame({"query_id": ids[r], key: keys[c], "cosine": sim[r, c]}))
                if len(best_k) > 8:
                    best_k = [_top(pd.concat(best_k), key, k)]
            if best_k:
                yield _top(pd.concat(best_k), key, k)

        part = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector).mapInPandas(scan, f"query_id long, {key} long, cosine double")
        out = part if out is None else out.unionAll(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), key)
    return out.where(F.col("cosine") > -2).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _top(df: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
    df = df.assign(_r=df["cosine"].round(12)).sort_values(["query_id", "_r", key], ascending=[True, False, True])
    return df[df.groupby("query_id").cumcount() < k].drop(columns="_r")


def angular_join(df: DataFrame, key: str, vector: str, threshold: float, other: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine): all pairs of at least ``threshold``, a < b; with ``other``, a of ``df`` and b of ``other``.

    Exact, by pivots in the metric of angles: PIVOTS rows, drawn by hash (a
    bounded sample), cut the space into cells; a row lies in the cell of its
    nearest pivot and is copied to every other cell whose border is within the
    threshold's angle (triangle inequality); pairs are compared in the cell of
    the smaller side's home only. The higher the threshold, the fewer copies.
    Crowded cells are cut into blocks that meet pairwise.
    """
    spark = df.sparkSession
    left = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(0).alias("side"))
    rows = left if other is None else left.unionAll(other.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector), F.lit(1)))
    n = rows.count()
    pivots = left.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, n // CELL))).collect()  # few rows need no cells
    if not pivots:
        return spark.createDataFrame([], "a long, b long, cosine double")
    p = spark.sparkContext.broadcast(_unit([r["v"] for r in pivots]))
    two = other is not None
    radius = float(np.arccos(np.clip(threshold, -1, 1)))
    crowd = max(1, -(-n // (4 * CELL * max(1, len(pivots) // 4))))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            angle = np.arccos(np.clip(_unit(pdf["v"]) @ p.value.T, -1, 1))
            home = angle.argmin(axis=1)
            r, c = np.nonzero(angle <= angle.min(axis=1)[:, None] + 2 * radius + 1e-9)
            block = (pdf["id"].to_numpy() * 2654435761 % 2**32) % crowd
            parts = []
            for j in range(crowd):
                parts.append(pd.DataFrame({"cell": c * crowd * crowd + np.minimum(block[r], j) * crowd + np.maximum(block[r], j), "id": pdf["id"].to_numpy()[r], "side": pdf["side"].to_numpy()[r], "home": home[r] == c, "block": block[r].astype(np.int64), "v": pdf["v"].to_numpy()[r]}))
            yield pd.concat(parts)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "side"]).sort_values(["side", "id"])
        ids, side, home, block = (pdf[c].to_numpy() for c in ("id", "side", "home", "block"))
        lo, hi = pdf["cell"].iloc[0] // crowd % crowd, pdf["cell"].iloc[0] % crowd
        v = _unit(pdf["v"])
        found = []
        for s in range(0, len(ids), CELL):
            sim = v[s : s + CELL] @ v.T
            r, c = np.nonzero(sim >= threshold - 1e-12)
            i = r + s
            ok = ((side[i] == 0) & (side[c] == 1) & home[i]) if two else ((ids[i] < ids[c]) & home[i])
            if lo != hi:
                ok &= block[i] != block[c]
            i, c, x = i[ok], c[ok], sim[r, c][ok]
            found.append(pd.DataFrame({"a": ids[i], "b": ids[c], "cosine": x}))
        return pd.concat(found)

    cells = rows.mapInPandas(place, "cell long, id long, side int, home boolean, block long, v array<float>")
    return cells.groupBy("cell").applyInPandas(compare, "a long, b long, cosine double").dropDuplicates(["a", "b"])


def keep_first_greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept, original): the result of going through the nodes in order and dropping each that is linked to one kept before.

    ``nodes`` (id), ``edges`` (a, b) with a < b, both of them nodes. A node
    whose smaller neighbours are all dropped is kept; one with a kept smaller
    neighbour is dropped; repeated until all are told, however long the chains
    are. Each round joins the edges still open with the nodes told last and
    writes both to the shared folder; FEW_EDGES or fewer are gone through in order.
    """
    from lexiloom.session import materialise

    spark = nodes.sparkSession
    edges = materialise(edges.select("a", "b").distinct(), "edges")
    fresh = materialise(nodes.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("kept")), "state")  # no smaller neighbour
    left, parts = edges, [fresh]
    while n := left.count():
        near = left.join(fresh.distinct().withColumnRenamed("id", "a"), "a", "left").select("a", "b", "kept")
        if n <= FEW_EDGES:
            parts.append(spark.createDataFrame(_in_order(near.collect()), parts[0].schema))  # at most FEW_EDGES
            break
        told = near.groupBy(F.col("b").alias("id")).agg(F.max("kept").alias("any"), F.count_if(F.col("kept").isNull()).alias("left"))
        told = materialise(told.withColumn("kept", F.when(F.coalesce("any", F.lit(False)), False).when(F.col("left") == 0, True)).select("id", "kept"), "told")
        still = told.where("kept is null").select(F.col("id").alias("b"))
        left = materialise(near.where("kept is null").join(still, "b", "left_semi").select("a", "b"), "left")
        fresh = told.where("kept is not null")
        if not fresh.take(1):
            raise ValueError("an edge starts at no node")
        parts.append(fresh)
        if len(parts) >= 20:
            parts = [materialise(reduce(DataFrame.unionAll, parts), "state")]
    state = reduce(DataFrame.unionAll, parts)
    first = edges.join(state.where("kept").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("original"))
    return state.join(first, "id", "left").select("id", "kept", F.when(~F.col("kept"), F.col("original")).alias("original"))


def _in_order(rows: list) -> list[tuple]:
    """(id, kept) of the larger ends of edges (a, b, whether a is kept if that is told), gone through in order."""
    kept: dict = {}
    for a, b, told in sorted(rows, key=lambda r: r[1]):
        if told is None and a not in kept:
            raise ValueError("an edge starts at no node")
        kept[b] = kept.get(b, True) and not (kept[a] if told is None else told)
    return list(kept.items())


def maxsim(queries: DataFrame, docs: DataFrame, query: str, doc: str, vector: str) -> DataFrame:
    """(query, doc, score): late interaction, the sum over query vectors of the best dot product with a vector of the document. For short candidate lists."""
    from lexiloom.functions.arrays import dot

    q = queries.select(query, F.monotonically_increasing_id().alias("_t"), F.col(vector).alias("_q"))
    pairs = q.join(docs.select(F.col(query), doc, F.col(vector).alias("_d")), query).withColumn("_s", dot("_q", "_d"))
    return pairs.groupBy(query, doc, "_t").agg(F.max("_s").alias("_m")).groupBy(query, doc).agg(F.sum("_m").alias("score"))
