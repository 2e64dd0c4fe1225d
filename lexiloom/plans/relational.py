"""Queries: relational and streaming operators that Spark adds to the above."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.sources.readers import table
from lexiloom.streaming import events as E

Q: dict = {}


def q(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = (lambda spark, d: fn(lambda n: table(spark, d, n)), sql)
        return fn

    return add


@q("SELECT r_name, n_name, o_orderpriority, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3")
def star_join_revenue(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # fixed dimensions
    return x.groupBy("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@q("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(t):
    return t("lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@q("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_quantities(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@q("SELECT p_brand, p_partkey, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def ranked_parts(t):
    return t("part").select("p_brand", "p_partkey", "p_retailprice", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("rank"))


@q("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    return E.tumbling(t("events"), "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@q("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    s = t("events").withColumn("f", gap).withColumn("s", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("s")


@q("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
