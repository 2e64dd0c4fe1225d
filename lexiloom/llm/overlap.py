"""Problem 6: the same or nearly the same records across splits.

Evaluation records are hashed by unordered word n-grams: the sub-bags that a
sub-space of the vocabulary cuts out of a text (``bags``), so that reordered
texts keep their n-grams. The hashes that matter are partitioned, training
records are scanned against them, and for every hit the containment of the
evaluation record in the training record and their likeness are counted
exactly. Ordered n-grams cannot find every pair of the wanted likeness, as
edits spread over a text leave none of them whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bags import Members, alike_bags, bag_table
from lexiloom.llm.tables import plain
from lexiloom.session import materialise

LEAST_WORDS = 30
LIKENESS = 0.75


class SplitOverlap:
    """Finds the records of evaluation splits that stand in the training split.

    ``fields``: (name, DataFrame, key, text, split column, source column or
    None) each. Splits are compared trimmed and in lower case; ``train``
    against ``test`` and ``validation``; other and null splits take no part,
    nor do null keys, null texts and texts under ``least`` words. Repeated rows
    count once. Empty tables give no rows; extra columns are not read.
    """

    def __init__(self, fields: list[tuple], likeness: float = LIKENESS, least: int = LEAST_WORDS):
        self.fields = fields
        parts = []
        for i, (_, df, key, text, split, _) in enumerate(fields):
            role = F.when(plain(split) == "train", 1).when(plain(split).isin("test", "validation"), 2)
            parts.append(bag_table(df.select(F.col(key).alias("k"), F.col(text).alias("t"), role.alias("r")).where("r is not null"), "k", "t", i, least, "r"))
        self.table = materialise(reduce(DataFrame.unionAll, parts), "bags")
        self.links = materialise(alike_bags(self.table, least, likeness, roles=True), "links")
        self.members = Members(self.table)

    def _name(self):
        return F.element_at(F.array(*[F.lit(f[0]) for f in self.fields]), F.col("tab") + 1)

    def hits(self) -> DataFrame:
        """(tab, train_id, eval_id, containment, likeness) of all overlaps."""
        m = self.members
        same = m.copies((1, 2)).select("tab", F.col("a_id").alias("train_id"), F.col("b_id").alias("eval_id"), F.lit(1.0).alias("containment"), F.lit(1.0).alias("likeness"))
        near = m.of(m.of(self._links(), "train", 1).drop("tab"), "eval", 2).where("train_id <> eval_id")
        both = same.unionAll(near.select("tab", "train_id", "eval_id", "containment", "likeness"))
        return both.groupBy("tab", "train_id", "eval_id").agg(F.max("containment").alias("containment"), F.max("likeness").alias("likeness")).withColumn("tab", self._name())

    def _links(self) -> DataFrame:
        """(train, eval, containment, likeness): alike bags in either direction; containment of the second in the first."""
        like = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
        ab = self.links.select(F.col("a").alias("train"), F.col("b").alias("eval"), (F.col("shared") / F.col("n_b")).alias("containment"), like.alias("likeness"))
        return ab.unionAll(self.links.select(F.col("b").alias("train"), F.col("a").alias("eval"), (F.col("shared") / F.col("n_a")).alias("containment"), like.alias("likeness")))

    def pairs(self) -> DataFrame:
        """(tab, id_a, id_b), the smaller key first."""
        return self.hits().select("tab", F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()

    def report(self) -> DataFrame:
        """(tab, split, source, records, overlapping): counts per evaluation split and source; the source is null where a table has none or it is blank."""
        rows = []
        for name, df, key, _, split, source in self.fields:
            rows.append(df.select(F.lit(name).alias("tab"), F.col(key).cast("long").alias("eval_id"), plain(split).alias("split"), (plain(source) if source else F.lit(None).cast("string")).alias("source")))
        every = reduce(DataFrame.unionAll, rows).where("eval_id is not null and split in ('test', 'validation')").distinct()
        # by bags, not by pairs of records: of each training bag the least and the greatest key are enough to tell another record from the same one
        m = self.members.rows
        bags_ = m.where("role = 1").groupBy("bag").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        near = self._links().select(F.col("train").alias("bag"), "eval").unionAll(bags_.select("bag", F.col("bag").alias("eval"))).join(bags_, "bag").groupBy(F.col("eval").alias("bag")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        hit = m.where("role = 2").join(near, "bag").where("low <> id or high <> id").select("tab", F.col("id").alias("eval_id")).distinct().withColumn("tab", self._name()).withColumn("hit", F.lit(1))
        return every.join(hit, ["tab", "eval_id"], "left").groupBy("tab", "split", "source").agg(F.countDistinct("eval_id").alias("records"), F.countDistinct(F.when(F.col("hit") == 1, F.col("eval_id"))).alias("overlapping"))
