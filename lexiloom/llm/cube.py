"""Problem 1: a sample that matches target category proportions.

Cube method. The articles of a category share an inclusion probability, so
that the expected counts meet the allocation; flight phases walk the vector of
probabilities along directions that keep every balancing total until too few
undecided records are left, per group of records; undecided records merge
upward in a tree; at the root balancing totals are dropped one by one (landing).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialise

#: Records of a flight phase; more are walked in several groups, whose undecided records merge upward.
RECORDS_A_GROUP = 10_000
FAN_IN = 16
EPS = 1e-9


def allocate(counts: dict[str | None, int], targets: dict[str, tuple[float, int]], share: float) -> pd.DataFrame:
    """The allocation per category: (category, available, wanted, allotted, met).

    wanted is the larger of target share x sample size and the minimum; a
    category with fewer records gives all it has and its target is not met.
    Categories without a target share in proportion what the targets leave of
    the sample (nothing if they sum to 1 or more); they may be given as one
    entry None. An empty pool allots nothing.
    """
    pool = sum(counts.values())
    sample = share * pool
    rows = [(c, counts.get(c, 0), max(t * sample, float(m))) for c, (t, m) in targets.items()]
    left = max(0.0, sample * (1 - sum(t for t, _ in targets.values())))
    others = {c: n for c, n in counts.items() if c not in targets}
    total = sum(others.values())
    rows += [(c, n, left * n / total) for c, n in others.items()]
    out = pd.DataFrame(rows, columns=["category", "available", "wanted"])
    out["allotted"] = np.minimum(out["wanted"], out["available"])
    out["met"] = out["wanted"] <= out["available"] * (1 + EPS)
    return out


def fill(plan: pd.DataFrame, listed: set[str], sample: float) -> pd.DataFrame:
    """The allocation with what categories cannot give made up by others, until it sums to the sample.

    Categories without a target come first, in proportion to what they have
    left, so that the met ones keep their share of the sample; only what these
    cannot give goes to listed ones with records left, in proportion to what is
    wanted of them. wanted and met stay.
    """
    plan = plan.copy()
    out, room = plan["allotted"].to_numpy(float).copy(), plan["available"].to_numpy(float)
    own = plan["category"].isin(listed).to_numpy()
    for among in (~own, own):
        weight = plan["wanted"].to_numpy(float) if among is own else room - out
        while (short := sample - out.sum()) > EPS * max(1.0, sample):
            some = among & (room - out > EPS) & (weight > 0)
            if not some.any():
                break
            out[some] = np.minimum(out[some] + short * weight[some] / weight[some].sum(), room[some])
    plan["allotted"] = out
    return plan


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One flight phase: moves ``p`` (probabilities) while the totals of ``x`` (records x constraints) stay.

    Takes constraints + 1 undecided records at a time, a direction in the
    null space of their constraints, and one of the two longest steps along
    it, so drawn that the expectation stays. Ends with at most as many
    undecided records as there are constraints.
    """
    p = p.copy()
    undecided = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    q = x.shape[1]
    if q == 1 and len(undecided) and np.ptp(x[undecided]) == 0:  # one constant total: the direction is (1, -1)
        i = -1
        for j, draw in zip(undecided.tolist(), rng.random(len(undecided)).tolist(), strict=True):
            if i < 0:
                i = j
                continue
            s = p[i] + p[j]
            if s <= 1:
                stays, rest, other = draw * s < p[i], s, 0.0
            else:
                stays, rest, other = draw * (2 - s) < 1 - p[i], s - 1, 1.0
            keep, gone = (i, j) if stays else (j, i)
            p[gone], p[keep] = other, rest
            i = keep if EPS < rest < 1 - EPS else -1
            if i < 0:
                p[keep] = round(rest)
        return p
    block = list(undecided[: q + 1])
    nxt = q + 1
    while len(block) > q:
        b = np.array(block)
        u = np.linalg.svd(x[b].T)[2][-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-12, (1 - p[b]) / u, np.where(u < -1e-12, -p[b] / u, np.inf)).min()
            down = np.where(u > 1e-12, p[b] / u, np.where(u < -1e-12, (p[b] - 1) / u, np.inf)).min()
        p[b] = p[b] + up * u if rng.random() * (up + down) < down else p[b] - down * u
        p[b] = np.where(p[b] < EPS, 0.0, np.where(p[b] > 1 - EPS, 1.0, p[b]))
        block = [i for i in block if 0 < p[i] < 1]
        while len(block) <= q and nxt < len(undecided):
            block.append(undecided[nxt])
            nxt += 1
    return p


def _balance(pdf: pd.DataFrame, seed: int, landing: bool) -> pd.DataFrame:
    """Flight (and landing) within each category on the balancing columns of its records."""
    pdf = pdf.sort_values(["category", "order", "id"], na_position="first")
    extra = [c for c in pdf.columns if c.startswith("b_")]
    p = pdf["p"].to_numpy().copy()
    start = pdf["p0"].to_numpy()
    rng = np.random.default_rng([seed, int(pdf["node"].iloc[0])])
    for _, at in pdf.groupby("category", dropna=False, sort=False).indices.items():
        parts = [start[at]]  # sum of p over the category: x / p0 is 1 each
        for c in extra:
            codes, values = pd.factorize(pdf[c].iloc[at])
            parts += [np.where(codes == k, start[at], 0.0) for k in range(1, len(values))]
        x = np.stack(parts, axis=1) / start[at][:, None]
        p[at] = flight(p[at], x, rng)
        if landing:
            for q in range(x.shape[1] - 1, 0, -1):
                p[at] = flight(p[at], x[:, :q], rng)
            left = at[(p[at] > EPS) & (p[at] < 1 - EPS)]
            p[left] = rng.random(len(left)) < p[left]
    return pdf.assign(p=p)


def _phase(seed: int, landing: bool, names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _balance(pdf, seed, landing)[names]

    return run


class CategorySample:
    """Draws a balanced sample of ``records`` and reports what could not be met.

    ``records``: id and category columns and further balancing columns of few
    values (their totals are balanced within each category). Null ids take no
    part, null or blank categories are outside the pool; an id delivered
    several times counts once (the least category). ``targets``: category ->
    (share, minimum); ``share`` of the pool is drawn. Empty pools give an empty
    sample and report the targets as unmet where a minimum is above 0.
    """

    def __init__(self, records: DataFrame, key: str, category: str, targets: dict[str, tuple[float, int]], share: float, balance: tuple[str, ...] = (), seed: int = 7):
        one = records.select(F.col(key).cast("long").alias("id"), F.trim(F.col(category)).alias("category"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"b_{c}") for c in balance])
        one = one.where("id is not null and category <> ''").groupBy("id").agg(F.min_by(F.struct("*"), F.struct("*")).alias("r")).select("r.*")
        self.pool = materialise(one, "pool")
        self.seed = seed
        self.targets = targets
        listed = F.when(F.col("category").isin(list(targets)), F.col("category"))
        counts = {r["c"]: r["count"] for r in self.pool.groupBy(listed.alias("c")).count().collect()}  # a row per target, one for all else
        self.size = sum(counts.values())
        plan = fill(allocate(counts, targets, share), set(targets), share * self.size)
        self.plan = plan[plan["category"].isin(list(targets))]
        others = plan[~plan["category"].isin(list(targets))]
        #: What a record of no listed category stands for: its part of what is wanted, and its inclusion probability.
        self.other = tuple(float(others[c].sum() / max(1, others["available"].sum())) for c in ("wanted", "allotted"))

    def _plan(self) -> DataFrame:
        """(category, wanted, allotted) of the listed categories."""
        rows = [(str(r.category), float(r.wanted), float(r.allotted)) for r in self.plan.itertuples()]
        return self.pool.sparkSession.createDataFrame(rows, "category string, wanted double, allotted double")

    def sample(self) -> DataFrame:
        """(id, category) of the sample."""
        groups = max(1, -(-self.size // RECORDS_A_GROUP))
        have = self.plan[self.plan["available"] > 0]
        rates = self.pool.sparkSession.createDataFrame([(str(r.category), float(r.allotted / r.available)) for r in have.itertuples()], "category string, rate double")
        spread = F.xxhash64(F.col("id"), F.lit(self.seed))
        state = self.pool.join(F.broadcast(rates), "category", "left")  # a row per target
        state = state.withColumn("p0", F.coalesce("rate", F.lit(self.other[1]))).drop("rate").where("p0 > 0").withColumn("p", F.col("p0")).withColumn("order", spread).withColumn("node", F.pmod(spread, F.lit(groups)))
        schema, names, seed = state.schema, state.columns, self.seed
        decided, nodes = [], groups
        while True:
            last = nodes == 1
            step = materialise(state.groupBy("node").applyInPandas(_phase(seed, last, names), schema), "flight")
            decided.append(step.where(F.col("p") >= 1 - EPS).select("id", "category"))
            if last:
                return reduce(DataFrame.unionAll, decided)
            state = step.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
            nodes = -(-nodes // FAN_IN)

    def _drawn(self, plan: DataFrame, available: DataFrame) -> DataFrame:
        """``plan`` with the records there are and those in the sample, per category."""
        drawn = self.sample().groupBy("category").agg(F.count("*").alias("drawn"))
        out = plan.join(available, "category", "left").join(drawn, "category", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("available", "drawn")})
        # a category that is drawn whole and still falls behind cannot meet its target
        return out.withColumn("met", (F.col("drawn") < F.col("available")) | (F.col("wanted") <= F.col("drawn") * (1 + EPS)))

    def report(self) -> DataFrame:
        """(category, available, wanted, allotted, met, drawn, residual): residual = drawn - allotted."""
        available = self.pool.groupBy("category").agg(F.count("*").alias("available"))
        listed = self._plan()
        wanted, rate = self.other
        others = available.where(~F.col("category").isin(list(self.targets))).select("category", (F.col("available") * wanted).alias("wanted"), (F.col("available") * rate).alias("allotted"))
        out = self._drawn(listed.unionAll(others), available)
        return out.select("category", "available", "wanted", "allotted", "met", "drawn", (F.col("drawn") - F.col("allotted")).alias("residual"))

    def unmet(self) -> DataFrame:
        """(category) of the targets that the sample misses although it holds all there is."""
        available = self.pool.groupBy("category").agg(F.count("*").alias("available"))
        return self._drawn(self._plan(), available).where("not met").select("category")


def first_topic(column: str):
    """The first non-blank value of an array, trimmed, in lower case; null if there is none."""
    clean = F.transform(F.col(column), lambda v: F.lower(F.trim(F.regexp_replace(v, r"^\s+|\s+$", ""))))
    return F.get(F.filter(clean, lambda v: v.isNotNull() & (v != "")), F.lit(0))
