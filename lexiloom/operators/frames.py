"""Operators on whole frames: filters, joins by position or dictionary, splits, samples, running totals, islands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.text import bucket

BUCKET = 65_536


def not_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is none of ``values``; null is none of them."""
    return df.where(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def keep_first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group; nulls form a group. Aggregates before it shuffles, so a crowded group costs one row per task."""
    first = df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_r"))
    return first.select("_r.*")


def repeated(df: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Rows of groups of at least ``least``; rows with a null key take no part."""
    return df.join(df.groupBy(*by).count().where(F.col("count") >= least).select(*by), by, "left_semi")


def running_total(df: DataFrame, key: str, value: Column, name: str = "offset") -> DataFrame:
    """The sum of ``value`` over all rows of a smaller key (unique integers): totals of key ranges first, then within each range. No task sees more than one range or one row per range."""
    b = F.floor(F.col(key) / BUCKET).alias("_b")
    df = df.withColumn("_v", value).withColumn("_b", b)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("_b").agg(F.sum("_v").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0))).join(base, "_b").withColumn(name, (F.col("_in") + F.col("_base")).cast("long")).drop("_b", "_v", "_in", "_base")


def row_numbers(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """Row numbers from 0 in the order of a unique integer key."""
    return running_total(df, key, F.lit(1), name)


def forward_fill(df: DataFrame, column: str, order: str, within: list[str]) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def islands(df: DataFrame, value: str, order: list[str], within: list[str]) -> DataFrame:
    """Runs of equal values: adds the number of the run within its group, from 1."""
    w = Window.partitionBy(*within).orderBy(*order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_f")


def part(key: str, shares: dict[str, int], seed: int = 0, buckets: int = 1000) -> Column:
    """A part by the hash of the key; ``shares`` in buckets, the last part takes the rest."""
    b = bucket(key, buckets, seed)
    out, upto, names = None, 0, list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(b < upto, name) if out is None else out.when(b < upto, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[0])


def hashed_order(key: str, seed: int = 0) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows in pseudo-random order (top-n by hash, no full sort)."""
    return df.orderBy(hashed_order(key, seed), key).limit(n)


def stratified(df: DataFrame, key: str, label: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``held``: the first floor(share x n) rows of each label in hash order; null is a label.

    Counts per label and cell of the hash (65536 cells) tell which cells are
    held whole; rows are ranked only within their cell, so a crowded label is
    never in one task.
    """
    h = hashed_order(key, seed)
    rows = df.withColumn("_h", h).withColumn("_c", F.conv(F.substring(h, 1, 4), 16, 10).cast("int"))
    cells = rows.groupBy(F.col(label).alias("_l"), F.col("_c").alias("_k")).count()
    w = Window.partitionBy("_l")
    upto = F.sum("count").over(w.orderBy("_k")) - F.col("count")
    cells = cells.select("_l", "_k", (F.floor(F.sum("count").over(w) * share) - upto).alias("_q"))
    rank = F.row_number().over(Window.partitionBy(label, "_c").orderBy("_h", key))
    return rows.join(cells, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_c") == F.col("_k"))).withColumn("held", rank <= F.col("_q")).drop("_h", "_c", "_l", "_k", "_q")


def group_rank(df: DataFrame, by: list[str], key: str, name: str, *ties: str) -> DataFrame:
    """Adds the number of each row within its group, from 0, in the order of an integer key; a crowded group is numbered by ranges of the key."""
    df = df.withColumn("_b", F.floor(F.col(key) / BUCKET))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "_b").count().select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_k"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    on = F.col("_b") == F.col("_k")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key, *ties))
    return df.join(base, on).withColumn(name, (F.col("_base") + rank - 1).cast("long")).drop("_b", "_k", "_base", *[f"_{c}" for c in by])


def few_shot(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each label, in hash order; ranks are limited before the shuffle."""
    w = Window.partitionBy(label).orderBy(hashed_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def random_category(df: DataFrame, category: str, key: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, category, key): categories uniformly, then a member; the frame of categories is small by nature."""
    spark = df.sparkSession
    cats = [r[0] for r in df.where(F.col(category).isNotNull()).select(category).distinct().orderBy(category).limit(100_000).collect()]
    if not cats:
        return df.select(F.lit(0).alias("draw"), F.col(category), F.col(key)).limit(0)
    picks = spark.range(draws).select(F.col("id").cast("int").alias("draw"), F.element_at(F.array(*map(F.lit, cats)), (bucket("id", len(cats), seed) + 1).cast("int")).alias(category))
    rank = F.row_number().over(Window.partitionBy("draw").orderBy(F.md5(F.concat_ws(":", "draw", key)), key))
    return picks.join(df.select(category, key), category).withColumn("_r", rank).where("_r = 1").select("draw", category, key)


def iterative_strata(df: DataFrame, key: str, labels: str, share: float, seed: int = 0) -> DataFrame:
    """(key, held) for rows of several labels: each row goes with its rarest label, and rows are held out within it."""
    one = df.select(key, F.explode(F.array_distinct(labels)).alias("_l")).where("_l is not null")
    rare = one.join(one.groupBy("_l").count(), "_l").groupBy(key).agg(F.min(F.struct("count", "_l")).alias("_m")).select(key, F.col("_m._l").alias("label"))
    return stratified(rare, key, "label", share, seed).select(key, "label", "held")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of frames of the same columns with their source's name."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("origin", F.lit(name)) for name, df in frames.items()])


def chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk, text): pieces of ``size`` characters, each starting ``size - overlap`` after the one before."""
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    return df.where(F.length(text) > 0).select(key, F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("_at"), F.col(text)).select(key, (F.col("_at") / step).cast("long").alias("chunk"), F.substring(F.col(text), F.col("_at") + 1, F.lit(size)).alias("piece"))


def blocks(tokens: DataFrame, key: str, size: int) -> DataFrame:
    """(block, ids) from (key, tokens): all sequences in the order of the key as one stream, cut into full blocks; the rest is dropped. Each task handles one block's worth of positions, never the stream."""
    at = running_total(tokens.select(key, "tokens"), key, F.size("tokens"), "start")
    flat = at.select(F.posexplode("tokens").alias("i", "token"), "start").select((F.col("start") + F.col("i")).alias("pos"), "token")
    full = flat.groupBy(F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x"))  # ``size`` tokens at most
    return full.where(F.size("x") == size).select("block", F.col("x.token").alias("ids"))


def early_stop(df: DataFrame, step: str, score: str, patience: int, within: list[str]) -> DataFrame:
    """Adds the best score so far and whether training has stopped: ``patience`` steps in a row without a new best."""
    w = Window.partitionBy(*within).orderBy(step)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_b", F.coalesce(F.col(score) > best, F.lit(True)).cast("int")).withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("_b") == 1, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stale = df.withColumn("best", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stale", (F.col("_n") - last).cast("long"))
    return stale.withColumn("stopped", F.max((F.col("stale") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("boolean")).drop("_b", "_n")


def permutation(df: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, in a pseudo-random order of a unique key; totals of cells of the hash first, then ranks within each."""
    h = hashed_order(key, seed)
    rows = df.withColumn("_h", h).withColumn("_c", F.conv(F.substring(h, 1, 4), 16, 10).cast("int"))
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(F.col("_c").alias("_k")).count().select("_k", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))  # 65536 rows at most
    rank = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key))
    return rows.join(base, F.col("_c") == F.col("_k")).withColumn(name, (F.col("_base") + rank - 1).cast("long")).drop("_h", "_c", "_k", "_base")


def shuffle_buffer(df: DataFrame, key: str, size: int, seed: int = 0, name: str = "place") -> DataFrame:
    """Adds the place of each row after a shuffle within buffers of ``size`` rows in the order of a unique integer key."""
    rows = row_numbers(df, key, "_n").withColumn("_b", F.floor(F.col("_n") / size))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(hashed_order(key, seed), key))  # one buffer
    return rows.withColumn(name, (F.col("_b") * size + rank - 1).cast("long")).drop("_n", "_b")
