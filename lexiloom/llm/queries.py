"""The pN_ queries: each takes (spark, folder of tables) and gives a DataFrame.

The operators' modules are imported when a query is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.tables import table


def _sample(spark: SparkSession, d: str):
    from lexiloom.llm.cube import CategorySample, first_topic
    from lexiloom.llm.tables import plain

    targets = table(spark, d, "topic_targets").collect()  # the operator's parameters
    articles = table(spark, d, "reuters21578").select("new_id", first_topic("topics").alias("topic"), plain("split").alias("split"))
    return CategorySample(articles, "new_id", "topic", {r["topic"].strip().lower(): (r["target_share"], r["min_rows"]) for r in targets}, targets[0]["sample_share"] if targets else 0.0, ("split",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).unmet().withColumnRenamed("category", "topic")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).sample().toDF("new_id", "topic")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def _mix(spark: SparkSession, d: str):
    from pyspark.sql import functions as F

    from lexiloom.llm.mixing import Mix
    from lexiloom.llm.tables import plain

    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    a = table(spark, d, "summaries").select(F.lit("summaries").alias("tab"), F.col("sum_id").alias("id"), plain("source").alias("source"), (size("document") + size("summary")).alias("size"))
    b = table(spark, d, "wikitext").select(F.lit("wikitext").alias("tab"), F.col("line_id").alias("id"), plain("source").alias("source"), size("text").alias("size"))
    weights = [(r["mix_name"], r["tab"], r["budget_share"], r["source"].strip().lower(), r["weight"], r["max_repeats"]) for r in table(spark, d, "mix_targets").collect()]  # the operator's parameters
    return Mix(a.unionAll(b), weights)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().where("short").select("mix_name", "source")


def p3_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).draw()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def _near(spark: SparkSession, d: str):
    from lexiloom.llm.neardup import NearDuplicates

    return NearDuplicates([("reddit_finance", table(spark, d, "reddit_finance"), "id", "body"), ("reuters21578", table(spark, d, "reuters21578"), "new_id", "text"), ("news_finance", table(spark, d, "news_finance"), "news_id", "description")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).classes()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from lexiloom.llm.pairs import PairDefects

    found = PairDefects(table(spark, d, "finance_alpaca"), table(spark, d, "documents"), "pair_id", "instruction", "input", "output").defects()
    return found.withColumnRenamed("id", "pair_id")


def _abuse(spark: SparkSession, d: str):
    from pyspark.sql import functions as F

    from lexiloom.llm.abuse import AbusiveContent

    reddit, tweets = table(spark, d, "reddit_finance"), table(spark, d, "sem_eval")
    return AbusiveContent(
        [("reddit_finance", "selftext", reddit, "id", "selftext", "subreddit"), ("reddit_finance", "body", reddit, "id", "body", "subreddit"), ("sem_eval", "tweet", tweets, "id", "tweet", None)],
        table(spark, d, "toxic_comments").select("comment_id", "comment_text", F.greatest("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")),  # any flag; nulls are skipped
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).review()


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).scores()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).rates()


def _overlap(spark: SparkSession, d: str):
    from lexiloom.llm.overlap import SplitOverlap

    return SplitOverlap(
        [
            ("reuters21578", table(spark, d, "reuters21578"), "new_id", "text", "split", None),
            ("summaries", table(spark, d, "summaries"), "sum_id", "document", "split", "source"),
            ("wikitext", table(spark, d, "wikitext"), "line_id", "text", "split", "source"),
        ]
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).pairs()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).report()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from lexiloom.llm.bpe import encode

    return encode(table(spark, d, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, d: str):
    from lexiloom.llm.packing import pack, token_sizes

    specs = [tuple(r) for r in table(spark, d, "pack_specs").select("spec_id", "tokenizer", "capacity").collect()]  # the operator's parameters
    sizes = token_sizes(table(spark, d, "documents"), "doc_id", "text", sorted({s[1] for s in specs}))
    return pack(sizes, specs), specs


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    from lexiloom.llm.packing import report

    return report(*_packed(spark, d))


def _garbled(spark: SparkSession, d: str):
    from lexiloom.llm.mojibake import Mojibake

    return Mojibake(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).found().toDF("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).restored().toDF("doc_id", "text", "whole")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
