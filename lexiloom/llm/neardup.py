"""Problem 2: near-duplicate records with small edits.

Named method: a metric-space join with pivots, Voronoi regions and
triangle-inequality windows. With whole texts as pivots it cannot prune here:
texts of one domain lie at nearly equal distances from any pivot (the distance
concentrates, see README), so every window holds nearly all texts. The regions
are therefore taken in sub-spaces of the vocabulary, where the pivots are the
distinct sub-bags, a text's home is the pivot at distance 0, and the triangle
inequality over the sub-spaces bounds in how many of them a pair must meet
(``bags``). Crowded regions are cut into blocks and join again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bags import Members, alike_bags, bag_table
from lexiloom.session import materialise

LEAST_WORDS = 30
LIKENESS = 0.75


class NearDuplicates:
    """Finds all pairs of records of one table that are at least ``likeness`` alike.

    ``fields``: (name of the table, DataFrame, key column, text column) each.
    Records with a null key or a null text, or with fewer than ``least`` words
    take no part. A key delivered several times with one text counts once;
    delivered with several texts, the likest count. Copies share one bag and
    are compared as one; an empty table gives no rows. Other columns are not
    read, so their names cannot clash.
    """

    def __init__(self, fields: list[tuple[str, DataFrame, str, str]], likeness: float = LIKENESS, least: int = LEAST_WORDS):
        self.names = [f[0] for f in fields]
        table = reduce(DataFrame.unionAll, [bag_table(df, key, text, i, least) for i, (_, df, key, text) in enumerate(fields)])
        self.table = materialise(table, "bags")
        self.links = materialise(alike_bags(self.table, least, likeness), "links")
        self.members = Members(self.table)

    def _name(self):
        return F.element_at(F.array(*[F.lit(x) for x in self.names]), F.col("tab") + 1).alias("tab")

    def pairs(self) -> DataFrame:
        """(tab, id_a, id_b) of all pairs, copies included."""
        near = self.members.of(self.members.of(self.links.select("a", "b"), "a").drop("tab"), "b").where("a_id <> b_id")
        near = near.select("tab", F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))
        return self.members.copies().toDF("tab", "id_a", "id_b").unionAll(near).distinct().select(self._name(), "id_a", "id_b")

    def classes(self) -> DataFrame:
        """(tab, id, class_id, copies, links): each record with its class of equal bags (the least key in it), the size of that class and the number of records elsewhere that are alike."""
        m = self.members.rows.select("tab", "bag", "id")
        size = m.groupBy("bag").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
        both = self.links.select("a", "b").unionAll(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(size.select(F.col("bag").alias("b"), F.col("copies").alias("more")), "b").groupBy(F.col("a").alias("bag")).agg(F.sum("more").alias("links"))
        return m.join(size, "bag").join(near, "bag", "left").select(self._name(), "id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
