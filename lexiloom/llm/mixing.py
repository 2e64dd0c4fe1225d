"""Problem 3: mixing sources to target weights.

Each source gets its share of the mix's total size. The expected number of
copies of a record is proportional to a measure of it (a power of its size) and
capped; its whole part is allotted for certain, the rest is an inclusion
probability. Of these remainders a sample of fixed size is taken by Pareto
order sampling: the records with the least U/(1-U) / (p/(1-p)) win.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.session import materialise

#: Power of the size to which the expected copies are proportional, and the steps in which that measure is rounded (bins a doubling of the size).
POWER, STEPS = 0.25, 4
FINE = 2**20


def copies(bins: pd.DataFrame, target: float, cap: int) -> pd.Series:
    """The expected copies for each bin (n records, size in all, measure w): min(cap, k w) with k so that the sizes add up to ``target``."""
    if target <= 0 or not len(bins):
        return bins["w"] * 0.0
    free, fixed = bins.index, 0.0
    result = pd.Series(float(cap), index=bins.index)
    while len(free):
        room = target - fixed
        base = (bins.loc[free, "w"] * bins.loc[free, "size"]).sum()
        if base <= 0 or room <= 0:
            result[free] = 0.0
            break
        k = room / base
        over = free[k * bins.loc[free, "w"] >= cap]
        if not len(over):
            result[free] = k * bins.loc[free, "w"]
            break
        fixed += cap * bins.loc[over, "size"].sum()
        free = free.difference(over)
    return result


class Mix:
    """Draws mixes of ``records`` (tab, id, source, size).

    Null ids take no part, a record delivered several times counts once (its
    largest size, least source); null sources belong to no mix; sources are
    taken as given (trim and lower-case them before). Sizes of 0 get no
    copies. ``weights``: (mix_name, tab, budget share, source, weight, most
    uses of a record). A listed source without records falls short if its
    target is above 0; an empty table gives targets of 0 and an empty mix.
    """

    def __init__(self, records: DataFrame, weights: list[tuple], seed: int = 11):
        one = records.where("id is not null").groupBy("tab", "id").agg(F.max("size").alias("size"), F.min("source").alias("source"))
        one = one.where("source is not null").withColumn("bin", F.when(F.col("size") > 0, F.floor(F.log2("size") * STEPS)).otherwise(-1).cast("int"))
        self.records = materialise(one, "records")
        self.seed = seed
        spark = records.sparkSession
        wanted = spark.createDataFrame([(t, s) for t, s in {(w[1], w[3]) for w in weights}], "tab string, source string")
        self.listed = self.records.join(F.broadcast(wanted), ["tab", "source"])  # the caller's sources
        # a bounded table: listed sources x doublings of the size x STEPS
        bins = self.listed.groupBy("tab", "source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("size")).toPandas()
        bins["w"] = 2.0 ** (bins["bin"] / STEPS * POWER)
        bins.loc[bins["bin"] < 0, "w"] = 0.0
        plans, rates = [], []
        for name in dict.fromkeys(w[0] for w in weights):
            mix = [w for w in weights if w[0] == name]
            sizes = {w[3]: float(bins[(bins["tab"] == w[1]) & (bins["source"] == w[3])]["size"].sum()) for w in mix}
            total, weight = mix[0][2] * sum(sizes.values()), math.fsum(w[4] for w in mix)
            for _, tab, _, source, share, cap in mix:
                goal = total * share / weight if weight else 0.0
                own = bins[(bins["tab"] == tab) & (bins["source"] == source) & (bins["bin"] >= 0)]
                plans.append((name, tab, source, sizes[source], goal, int(cap)))
                expected = copies(own, min(goal, cap * sizes[source]), int(cap))
                rates += [(name, tab, source, int(b), float(c)) for b, c in zip(own["bin"], expected, strict=True)]
        self.plan = spark.createDataFrame(plans, "mix_name string, tab string, source string, available double, target double, cap int")
        self.rates = spark.createDataFrame(rates, "mix_name string, tab string, source string, bin int, expected double")

    def draw(self) -> DataFrame:
        """(mix_name, tab, source, id, size, copies): the records of each mix and how often each is used."""
        u = (F.pmod(F.xxhash64("mix_name", "tab", "id", F.lit(self.seed)), F.lit(2**40)) + 0.5) / 2**40
        all_ = (
            self.listed.join(F.broadcast(self.rates), ["tab", "source", "bin"])  # a row per mix, source and bin
            .withColumn("whole", F.floor("expected"))
            .withColumn("p", F.col("expected") - F.col("whole"))
            .withColumn("u", u)
            .withColumn("odds", F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0)))
            .withColumn("fine", F.when(F.col("p") > 0, F.floor(F.col("odds") / (1 + F.col("odds")) * FINE)))
            .withColumn("coarse", F.floor(F.col("fine") / 1024))
        )
        group = ["mix_name", "tab", "source"]

        def cut(cells: DataFrame, level: str, need: DataFrame) -> DataFrame:
            """The cell in which the n-th least odds lie, and how many of it are taken."""
            w = Window.partitionBy(*group).orderBy(level)
            upto = cells.where(F.col(level).isNotNull()).withColumn("upto", F.sum("count").over(w)).join(need, group)
            return upto.where((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("count") < F.col("n"))).select(*group, F.col(level).alias(f"{level}_cut"), (F.col("n") - F.col("upto") + F.col("count")).alias("n"))

        # bounded tables: listed sources x 1024 cells, twice
        coarse = materialise(all_.groupBy(*group, "coarse").agg(F.count("*").alias("count"), F.sum("p").alias("p")), "coarse")
        first = cut(coarse, "coarse", coarse.groupBy(*group).agg(F.round(F.sum("p")).cast("long").alias("n")))
        fine = materialise(all_.join(F.broadcast(first), group).where("coarse = coarse_cut").groupBy(*group, "fine", "n").count(), "fine")
        second = cut(fine.drop("n"), "fine", fine.select(*group, "n").distinct())
        edge = all_.join(F.broadcast(second), group).where("fine = fine_cut")  # one cell in 2**20 of each source
        place = F.row_number().over(Window.partitionBy(*group).orderBy("odds", "id"))
        last = materialise(edge.withColumn("place", place).where("place <= n").groupBy(*group).agg(F.max(F.struct("odds", "id")).alias("last")), "last")
        won = F.coalesce((F.col("p") > 0) & (F.struct("odds", "id") <= F.col("last")), F.lit(False))
        out = all_.join(F.broadcast(last), group, "left").withColumn("copies", (F.col("whole") + won.cast("long")).cast("long"))
        return out.where("copies > 0").select(*group, "id", "size", "copies")

    def report(self) -> DataFrame:
        """(mix_name, tab, source, available, target, actual, actual_share, short) for each listed source.

        A source falls short if the mix uses each of its records as often as
        it may and their size is still under the target.
        """
        used = self.draw().groupBy("mix_name", "tab", "source").agg(F.sum(F.col("size") * F.col("copies")).cast("double").alias("actual"))
        out = self.plan.join(F.broadcast(used), ["mix_name", "tab", "source"], "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))  # a row per listed source
        share = F.col("actual") / F.nullif(F.sum("actual").over(Window.partitionBy("mix_name")), F.lit(0.0))
        short = (F.col("actual") >= F.col("cap") * F.col("available")) & (F.col("actual") < F.col("target") * (1 - 1e-12))
        return out.withColumn("actual_share", F.round(share, 9)).withColumn("short", short).select("mix_name", "tab", "source", "available", "target", "actual", "actual_share", "short")
