"""Problem 8: filling containers of fixed capacity.

Hierarchical residual packing: groups of items are packed locally by best fit
in descending order, nearly full containers are final, and the underfull ones
climb a tree as items and are packed again by best fit, until one node is left.

What climbs is bounded without loss. Best fit leaves at most one container of a
node that is half full or less (a second one would have been put into the
first), and two that are more than half full never go together. So a node meets
at most FAN_IN containers that move, and of the hosts with the same fill no more
than FAN_IN a level can ever be wanted; further ones are final where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bpe import TOKENIZERS, load
from lexiloom.session import materialise

NEARLY_FULL = 0.98
FAN_IN = 8
ITEMS_A_GROUP = 100_000


@cache
def _counter(folder: str, name: str):
    if Path(folder, f"{name}.tiktoken").exists():
        encoder = load(folder, name)
        return lambda texts: [len(x) for x in encoder.encode_batch(texts)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder, f"{name}.model")))
    return lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]


def token_sizes(df: DataFrame, key: str, text: str, names: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokenizer, size) of each row; a null or empty text has size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = part.column(1).to_pylist()
                for name in names:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * len(texts)), pa.array(_counter(folder, name)(texts), pa.int64())], names=["key", "tokenizer", "size"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, tokenizer string, size long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item (items in the given order) and the fill of each bin; each goes where it leaves the least room."""
    rooms: dict[int, list[int]] = {}
    mask = 0  # bit r is set if a bin has r free
    where = np.empty(len(sizes), np.int64)
    free: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            r = (fits & -fits).bit_length() - 1 + s
            b = rooms[r].pop()
            if not rooms[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        r -= s
        free[b] = r
        rooms.setdefault(r, []).append(b)
        mask |= 1 << r
        where[i] = b
    return where, capacity - np.array(free, np.int64)


def pack(items: DataFrame, specs: list[tuple[int, str, int]]) -> DataFrame:
    """(spec_id, container_id, key, piece, size) for ``items`` (key, tokenizer, size) and specs (spec_id, tokenizer, capacity).

    An item above the capacity is cut into full pieces, each with a container
    of its own, and a rest; no other item is split. Items of size 0 lie in any
    container. Keys delivered several times count once (their largest size).
    A spec without items has no rows. Capacities must be positive.
    """
    spark = items.sparkSession
    table = spark.createDataFrame([(int(a), str(b), int(c)) for a, b, c in specs], "spec_id long, tokenizer string, capacity long")
    items = items.groupBy("key", "tokenizer").agg(F.max("size").alias("size"))
    items = materialise(items, "sizes")
    groups = max(1, -(-items.count() // ITEMS_A_GROUP))
    levels, nodes = 0, groups
    while nodes > 1:
        nodes, levels = -(-nodes // FAN_IN), levels + 1
    pieces = (
        items.join(F.broadcast(table), "tokenizer")  # one row per spec of the caller
        .withColumn("full", F.floor(F.col("size") / F.col("capacity")))
        .withColumn("last", F.col("size") % F.col("capacity"))
        .withColumn("piece", F.explode(F.expr("sequence(0, if(last > 0 or full = 0, full, full - 1))")))
        .withColumn("size", F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("last")))
        .select("spec_id", "capacity", F.col("key"), F.col("piece").cast("long").alias("piece"), "size", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("node"))
    )

    def climbs(fill: np.ndarray, capacity: int, left: int) -> np.ndarray:
        """Which containers go up, with so many levels left."""
        go = fill < NEARLY_FULL * capacity
        host = pd.Series(fill[go])
        go[go] = (host.groupby(host).cumcount() < FAN_IN * left) | (2 * host <= capacity)
        return go

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "piece"], ascending=[False, True, True])
        cap = int(pdf["capacity"].iloc[0])
        where, fill = best_fit(pdf["size"].to_numpy(), cap)
        out = pdf.assign(bin=(np.int64(pdf["node"].iloc[0]) << np.int64(32)) + where, fill=fill[where], up=climbs(fill, cap, levels)[where])
        return out[["spec_id", "capacity", "key", "piece", "size", "node", "bin", "fill", "up"]]

    packed = pieces.groupBy("node", "spec_id").applyInPandas(local, "spec_id long, capacity long, key long, piece long, size long, node long, bin long, fill long, up boolean")
    packed = materialise(packed, "packed")
    open_ = packed.where("up").select("spec_id", "capacity", "node", "bin", "fill").distinct()

    def merge(left: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True])
            cap = int(pdf["capacity"].iloc[0])
            where, fill = best_fit(pdf["fill"].to_numpy(), cap)
            first = pdf["bin"].to_numpy()[np.unique(where, return_index=True)[1]]
            return pdf.assign(parent=first[where], total=fill[where], up=climbs(fill, cap, left)[where])[["spec_id", "capacity", "node", "bin", "parent", "total", "up"]]

        return run

    maps = []
    for left in range(levels - 1, -1, -1):
        step = open_.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("node", "spec_id").applyInPandas(merge(left), "spec_id long, capacity long, node long, bin long, parent long, total long, up boolean")
        step = materialise(step, "climb")
        maps.append(step.where("bin <> parent").select("spec_id", "bin", "parent"))
        open_ = step.where("up").select("spec_id", "capacity", "node", F.col("parent").alias("bin"), F.col("total").alias("fill")).distinct()
    out = packed.select("spec_id", "bin", "key", "piece", "size")
    for m in maps:
        out = out.join(m, ["spec_id", "bin"], "left").withColumn("bin", F.coalesce("parent", "bin")).drop("parent")
    return out.select("spec_id", F.col("bin").alias("container_id"), "key", "piece", "size")


def report(packed: DataFrame, specs: list[tuple[int, str, int]]) -> DataFrame:
    """(spec_id, containers, tokens, least_containers, fill): what was reached, beside the least number that the tokens need."""
    table = packed.sparkSession.createDataFrame([(int(a), int(c)) for a, _, c in specs], "spec_id long, capacity long")
    sums = packed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens")).join(F.broadcast(table), "spec_id")
    return sums.select("spec_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
