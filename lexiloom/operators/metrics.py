"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that values are ranked in.
RANGES = 4_096


def report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) for each class and the micro, macro and weighted averages; 0 where undefined. One shuffle on the pairs (gold, pred)."""
    pairs = df.groupBy(F.col(gold).cast("string").alias("g"), F.col(pred).cast("string").alias("p")).count()
    ones = pairs.select(F.col("g").alias("label"), "count", F.lit(1).alias("gold"), (F.col("g") == F.col("p")).cast("int").alias("hit"), F.lit(0).alias("said")).unionAll(pairs.select(F.col("p"), "count", F.lit(0), F.lit(0), F.lit(1)))
    s = ones.where("label is not null").groupBy("label").agg(*[F.sum(F.col("count") * F.coalesce(c, F.lit(0))).alias(c) for c in ("gold", "hit", "said")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("gold")))
    s = s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    each = s.select("label", "precision", "recall", "f1", F.col("gold").cast("long").alias("support"))
    macro = s.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("gold").cast("long").alias("support"))
    weighted = s.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("gold")) / F.sum("gold")).alias(c) for c in ("precision", "recall", "f1")], F.sum("gold").cast("long").alias("support"))
    one = s.agg(F.lit("micro avg").alias("label"), ratio(F.sum("hit"), F.sum("said")).alias("precision"), ratio(F.sum("hit"), F.sum("gold")).alias("recall"), ratio(2 * F.sum("hit"), F.sum("said") + F.sum("gold")).alias("f1"), F.sum("gold").cast("long").alias("support"))
    return each.unionAll(one).unionAll(macro).unionAll(weighted)


def micro(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(precision, recall, f1) of multi-label arrays by global counts; nulls are empty."""
    none = F.array().cast("array<string>")
    g, p = F.array_distinct(F.coalesce(gold, none)), F.array_distinct(F.coalesce(pred, none))
    c = df.agg(F.sum(F.size(F.array_intersect(g, p))).alias("hit"), F.sum(F.size(g)).alias("gold"), F.sum(F.size(p)).alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("gold")))
    return c.select("precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def average_ranks(df: DataFrame, value: str, *more) -> DataFrame:
    """(value, n, rank, *more): the average rank of each distinct number, from 1."""
    per = df.groupBy(F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"), *more)
    ends = per.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    per = per.crossJoin(F.broadcast(ends)).withColumn("_range", F.coalesce(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * RANGES), F.lit(0)))  # one row
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = per.groupBy("_range").agg(F.sum("n").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_base"))  # a row per range
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("_in", inner).join(F.broadcast(base), "_range").withColumn("rank", F.col("_base") + F.col("_in") + (F.col("n") + 1) / 2).drop("_range", "_lo", "_hi", "_in", "_base")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): area under the ROC curve by rank sums, ties at their average rank; null scores take no part.

    Ranks are running totals over distinct scores: totals of ranges of the
    score first, then within each range.
    """
    r = average_ranks(df.where(F.col(score).isNotNull()), score, F.count_if(F.col(label)).alias("pos"))
    return r.agg(((F.sum(F.col("rank") * F.col("pos")) - F.sum("pos") * (F.sum("pos") + 1) / 2) / (F.sum("pos") * (F.sum("n") - F.sum("pos")))).alias("auc"))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(gold, pred, n, share): counts, and shares of each gold class."""
    c = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold")))


def overlap_f1(df: DataFrame, key: str, gold: str, pred: str, n: int) -> DataFrame:
    """(key, precision, recall, f1): ROUGE-n without stemming, of arrays of words."""
    from lexiloom.functions.arrays import ngrams

    def counts(column: str, name: str) -> DataFrame:
        return df.select(key, F.explode(ngrams(column, n)).alias("g")).groupBy(key, "g").agg(F.count("*").alias(name))

    both = counts(gold, "a").join(counts(pred, "b"), [key, "g"], "full").groupBy(key).agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("hit"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(0.0)
    both = both.withColumn("precision", ratio(F.col("hit"), F.col("nb"))).withColumn("recall", ratio(F.col("hit"), F.col("na")))
    return both.select(key, "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def longest_common(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """(key, lcs): the length of the longest common subsequence of two word arrays (ROUGE-L), row by row in Arrow batches with bit-parallel integers."""

    @F.pandas_udf("long")
    def lcs(a, b):
        def one(x, y) -> int:
            if x is None or y is None:
                return 0
            place: dict = {}
            for i, w in enumerate(x):
                place[w] = place.get(w, 0) | 1 << i
            v = full = (1 << len(x)) - 1
            for w in y:
                m = place.get(w, 0) & v
                v = ((v + m) | (v - m)) & full
            return len(x) - v.bit_count()

        return a.combine(b, one)

    return df.select(key, lcs(F.col(gold), F.col(pred)).alias("lcs"))


def spans(tags: DataFrame, keys: list[str], pos: str, tag: str) -> DataFrame:
    """(keys, kind, start, stop) of entities in BIO tags: a B opens one, I of the same kind goes on; an I without one opens one too."""
    w = Window.partitionBy(*keys).orderBy(pos)
    kind, head = F.substring(F.col(tag), 3, 100), F.substring(F.col(tag), 1, 1)
    t = tags.withColumn("_k", F.when(F.col(tag) != "O", kind)).withColumn("_h", head)
    open_ = F.col("_k").isNotNull() & ((F.col("_h") == "B") | ~F.lag("_k").over(w).eqNullSafe(F.col("_k")))
    t = t.withColumn("_o", open_.cast("int")).withColumn("_r", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where("_k is not null").groupBy(*keys, "_r", F.col("_k").alias("kind")).agg(F.min(pos).cast("long").alias("start"), (F.max(pos) + 1).cast("long").alias("stop")).drop("_r")


def entity_report(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, precision, recall, f1, support) of exact spans per kind and overall."""
    on = [*keys, "kind", "start", "stop"]
    both = gold.select(*on).distinct().withColumn("g", F.lit(1)).join(pred.select(*on).distinct().withColumn("p", F.lit(1)), on, "full").fillna(0, ["g", "p"])
    s = both.rollup("kind").agg(F.sum("g").alias("gold"), F.sum("p").alias("said"), F.sum(F.col("g") * F.col("p")).alias("hit")).withColumn("kind", F.coalesce("kind", F.lit("overall")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("gold")))
    return s.select("kind", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.col("gold").cast("long").alias("support"))


def multi_label_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) of multi-label arrays per label, and the micro and macro averages; nulls are empty, 0 where undefined."""
    none = F.array().cast("array<string>")
    flat = lambda c, g, p: df.select(F.explode(F.array_distinct(F.coalesce(c, none))).alias("label"), F.lit(g).alias("g"), F.lit(p).alias("p"), F.lit(0).alias("b"))
    hit = df.select(F.explode(F.array_intersect(F.coalesce(gold, none), F.coalesce(pred, none))).alias("label"), F.lit(0).alias("g"), F.lit(0).alias("p"), F.lit(1).alias("b"))
    s = flat(gold, 1, 0).unionAll(flat(pred, 0, 1)).unionAll(hit).where("label is not null").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("g", "p", "b")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)

    def scored(x: DataFrame) -> DataFrame:
        x = x.withColumn("precision", ratio(F.col("b"), F.col("p"))).withColumn("recall", ratio(F.col("b"), F.col("g")))
        return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))

    each = scored(s)
    micro_ = scored(s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("g", "p", "b")]).withColumn("label", F.lit("micro avg")))
    macro = each.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.coalesce(F.sum("g"), F.lit(0)).alias("g"))
    out = ["label", "precision", "recall", "f1", F.col("g").cast("long").alias("support")]
    return each.select(*out).unionAll(micro_.select(*out)).unionAll(macro.select(*out))


def subset_accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(subset_accuracy): the share of rows whose sets of labels are equal."""
    none = F.array().cast("array<string>")
    s = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    return df.agg(F.avg(F.when(s(gold) == s(pred), 1.0).otherwise(0.0)).alias("subset_accuracy"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman): the correlation of average ranks; rows with a null take no part."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    ra, rb = (average_ranks(rows, c).select(c, F.col("rank").alias(f"{c}r")) for c in ("_a", "_b"))
    pairs = rows.groupBy("_a", "_b").count().join(ra, "_a").join(rb, "_b")
    n, x, y = F.col("count"), F.col("_ar"), F.col("_br")
    s = pairs.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    top = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    return s.select((top / F.nullif(F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))), F.lit(0.0))).alias("spearman"))


def combined(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(metric, value): accuracy and the macro and weighted averages of the report in one frame."""
    acc = df.agg(F.avg(F.when(F.col(gold) == F.col(pred), 1.0).otherwise(0.0)).alias("value")).select(F.lit("accuracy").alias("metric"), "value")
    r = report(df, gold, pred).where(F.col("label").isin("macro avg", "weighted avg"))
    pairs = F.explode(F.create_map(*[x for c in ("precision", "recall", "f1") for x in (F.lit(c), F.col(c))])).alias("m", "value")
    return acc.unionAll(r.select("label", pairs).select(F.concat_ws(" ", F.replace("label", F.lit(" avg"), F.lit("")), "m").alias("metric"), "value"))
