"""Queries: statistics, filters, counts, windows, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import text as T
from lexiloom.operators import frames as O
from lexiloom.sources.readers import row_range, split, table

W = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f]+'), lambda w: w <> '')"
LW = W.format("lower(text)")
BUCKET = "(('0x' || substr(md5({0}::VARCHAR || ':{1}'), 1, 8))::BIGINT % {2})"
Q: dict = {}


def q(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = (lambda spark, d: fn(lambda n: table(spark, d, n)), sql)
        return fn

    return add


# A01-A06 ------------------------------------------------------------------
@q(f"SELECT count(*) AS n_docs, round(avg(length(text)), 6) AS avg_length, (SELECT count(DISTINCT w) FROM (SELECT unnest({W.format('text')}) AS w FROM documents)) AS vocab_size FROM documents")
def basic_statistics(t):
    d = t("documents")
    v = d.select(F.explode(T.words("text")).alias("w")).agg(F.countDistinct("w").alias("vocab_size"))
    return d.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.length("text")), 6).alias("avg_length")).crossJoin(v)  # one row each


@q(f"SELECT w AS word, count(*) AS cnt FROM (SELECT unnest({LW}) AS w FROM documents) GROUP BY w ORDER BY cnt DESC, word LIMIT 10")
def word_frequency_top(t):
    return t("documents").select(F.explode(T.lower_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "word").limit(10)


@q(f"SELECT w AS word, count(*) AS cnt FROM (SELECT unnest({LW}) AS w FROM reuters21578) WHERE regexp_matches(w, '^[a-z]+$') GROUP BY w ORDER BY cnt, word LIMIT 10")
def word_frequency_bottom(t):
    return t("reuters21578").select(F.explode(T.lower_words("text")).alias("word")).where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count("*").alias("cnt")).orderBy("cnt", "word").limit(10)


def _ngram_sql(n: int, tab: str) -> str:
    return f"WITH t AS (SELECT {LW} AS w FROM {tab}) SELECT g AS gram, count(*) AS cnt FROM (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM t WHERE len(w) >= {n}) GROUP BY g ORDER BY cnt DESC, gram LIMIT 10"


def _ngram(t, n, tab):
    from lexiloom.functions.arrays import ngrams

    w = t(tab).select(T.lower_words("text").alias("w"))  # a column of its own: split once a text, not once an n-gram
    return w.select(F.explode(ngrams("w", n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "gram").limit(10)


@q(_ngram_sql(2, "reuters21578"))
def bigram_top(t):
    return _ngram(t, 2, "reuters21578")


@q(_ngram_sql(3, "reuters21578"))
def trigram_top(t):
    return _ngram(t, 3, "reuters21578")


# A07-A19 ------------------------------------------------------------------
@q("SELECT x AS topic, count(*) AS cnt FROM (SELECT unnest(topics) AS x FROM reuters21578) WHERE x IS NOT NULL GROUP BY x")
def label_counts(t):
    return t("reuters21578").select(F.explode("topics").alias("topic")).where("topic is not null").groupBy("topic").agg(F.count("*").alias("cnt"))


@q("SELECT round(avg(len(topics)), 6) AS cardinality, CASE WHEN n > 0 THEN round(avg(len(topics)) / n, 6) ELSE 0 END AS density FROM reuters21578, (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(topics) AS x FROM reuters21578)) GROUP BY n")
def label_cardinality_density(t):
    r = t("reuters21578")
    n = r.select(F.explode("topics").alias("x")).agg(F.countDistinct("x").alias("n"))
    m = r.agg(F.avg(F.when(F.col("topics").isNotNull(), F.size("topics"))).alias("m")).crossJoin(n)  # one row each
    return m.select(F.round("m", 6).alias("cardinality"), F.when(F.col("n") > 0, F.round(F.col("m") / F.col("n"), 6)).otherwise(0.0).alias("density"))


@q(f"SELECT count(*) AS singletons FROM (SELECT w FROM (SELECT unnest({LW}) AS w FROM documents) GROUP BY w HAVING count(*) = 1)")
def singleton_words(t):
    return t("documents").select(F.explode(T.lower_words("text")).alias("w")).groupBy("w").count().where("count = 1").agg(F.count("*").alias("singletons"))


@q("SELECT x AS topic FROM (SELECT unnest(topics) AS x FROM reuters21578 WHERE lower(trim(split)) = 'train') WHERE x IS NOT NULL GROUP BY x HAVING count(*) <= 2")
def rare_train_labels(t):
    return split(t("reuters21578"), "train").select(F.explode("topics").alias("topic")).where("topic is not null").groupBy("topic").count().where("count <= 2").select("topic")


@q("""WITH m AS (SELECT median(length(text)) AS m FROM reuters21578), b AS (SELECT CASE WHEN length(text) > m THEN 'above' WHEN length(text) < m THEN 'below' END AS band, topics FROM reuters21578, m),
c AS (SELECT band, x AS topic, count(*) AS cnt FROM (SELECT band, unnest(topics) AS x FROM b WHERE band IS NOT NULL) WHERE x IS NOT NULL GROUP BY band, x)
SELECT band, topic, cnt, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY cnt DESC, topic) AS rn FROM c) WHERE rn <= 5""")
def length_median_bands(t):
    r = t("reuters21578")
    m = r.agg(F.median(F.length("text")).alias("m"))
    n = F.length("text")
    b = r.crossJoin(F.broadcast(m)).select(F.when(n > F.col("m"), "above").when(n < F.col("m"), "below").alias("band"), "topics").where("band is not null")  # m is one row
    c = b.select("band", F.explode("topics").alias("topic")).where("topic is not null").groupBy("band", "topic").agg(F.count("*").alias("cnt"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("cnt"), "topic")).cast("long")).where("rank <= 5")


@q("SELECT count(*) FILTER (length(text) > m) AS above, count(*) FILTER (length(text) < m) AS below, any_value(m) AS median FROM reuters21578, (SELECT median(length(text)) AS m FROM reuters21578)")
def median_split_counts(t):
    r = t("reuters21578").select(F.length("text").alias("n"))
    return r.crossJoin(F.broadcast(r.agg(F.median("n").alias("m")))).agg(F.count_if(F.col("n") > F.col("m")).alias("above"), F.count_if(F.col("n") < F.col("m")).alias("below"), F.any_value("m").alias("median"))  # m is one row


@q("SELECT lang, count(*) AS cnt FROM documents GROUP BY lang")
def lang_value_counts(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("cnt"))


@q("SELECT count(*) AS singles FROM (SELECT title FROM reddit_finance WHERE title IS NOT NULL GROUP BY title HAVING count(*) = 1)")
def values_seen_once(t):
    return t("reddit_finance").where("title is not null").groupBy("title").count().where("count = 1").agg(F.count("*").alias("singles"))


@q("SELECT count(DISTINCT subreddit) AS subreddits, count(DISTINCT lower(trim(subreddit))) AS folded FROM reddit_finance")
def distinct_counts(t):
    return t("reddit_finance").agg(F.countDistinct("subreddit").alias("subreddits"), F.countDistinct(F.lower(F.trim("subreddit"))).alias("folded"))


@q("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT title FROM reuters21578)) AS duplicates FROM reuters21578")
def duplicate_titles(t):
    r = t("reuters21578")
    return r.groupBy("title").count().agg((F.sum("count") - F.count("*")).alias("duplicates"))


@q("SELECT count(*) - count(text) AS text, count(*) - count(lang) AS lang, count(*) - count(source) AS source FROM documents")
def null_counts(t):
    return t("documents").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("text", "lang", "source")])


@q("SELECT count(selftext) AS selftext, count(body) AS body, count(z_score) AS z_score FROM reddit_finance")
def non_null_counts(t):
    return t("reddit_finance").agg(*[F.count(c).alias(c) for c in ("selftext", "body", "z_score")])


@q(r"WITH n AS (SELECT len(string_split(document, ' '))::BIGINT AS n FROM summaries WHERE document IS NOT NULL) SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM n")
def describe_words(t):
    n = t("summaries").where("document is not null").select(F.size(T.blank_parts("document")).cast("long").alias("n"))
    return n.agg(F.count("*").alias("count"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("min"), *[F.percentile("n", F.lit(p)).alias(a) for p, a in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))], F.max("n").alias("max"))


@q(f"SELECT max(len({W.format('text')}))::BIGINT AS most_words FROM documents")
def max_words(t):
    return t("documents").agg(F.max(F.size(T.words("text"))).cast("long").alias("most_words"))


@q("SELECT substr(event_type, 1, 3) AS family, sum(n)::BIGINT AS total FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type) GROUP BY 1")
def prefix_totals(t):
    c = t("events").where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.groupBy(F.substring("event_type", 1, 3).alias("family")).agg(F.sum("n").alias("total"))


@q("SELECT page_title, string_agg(line_id::VARCHAR, ' ' ORDER BY line_id) AS joined FROM (SELECT DISTINCT page_title, line_id FROM wikitext WHERE page_title IS NOT NULL) GROUP BY page_title")
def group_concat(t):
    one = t("wikitext").where("page_title is not null").select("page_title", "line_id").distinct()
    return one.groupBy("page_title").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line_id")), lambda x: x.cast("string")), " ").alias("joined"))


@q("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def group_means(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@q("SELECT event_id // 100 AS step, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM events GROUP BY 1")
def batch_accuracy(t):
    return t("events").groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("step")).agg(F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("n"))


@q(r"SELECT round(avg(len(list_filter(string_split(tweet, ' '), lambda x: x <> ''))), 6) AS mean_len FROM sem_eval WHERE tweet IS NOT NULL")
def mean_generated_length(t):
    return t("sem_eval").where("tweet is not null").agg(F.round(F.avg(F.size(F.filter(T.blank_parts("tweet"), lambda x: x != ""))), 6).alias("mean_len"))


@q("SELECT label, i - 1 AS dim, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::BIGINT AS i FROM embeddings) GROUP BY label, i")
def vector_pooling(t):
    return t("embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.max(F.col("v").cast("double")), 6).alias("most"))


# P: projections and filters -----------------------------------------------
@q("SELECT new_id, title || ' ' || text AS full_text FROM reuters21578")
def add_full_text(t):
    return t("reuters21578").select("new_id", F.concat("title", F.lit(" "), "text").alias("full_text"))


@q("SELECT id, title || ' ' || selftext || ' ' || body AS text FROM reddit_finance WHERE title || ' ' || selftext || ' ' || body IS NOT NULL")
def concat_fields(t):
    return t("reddit_finance").select("id", F.concat("title", F.lit(" "), "selftext", F.lit(" "), "body").alias("text")).where("text is not null")


@q("SELECT sum_id AS record_id, document AS input, summary AS target FROM summaries")
def rename_drop(t):
    return t("summaries").withColumnsRenamed({"sum_id": "record_id", "document": "input", "summary": "target"}).drop("source", "split")


@q("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'fr')")
def filter_not_in_lang(t):
    return O.not_in(t("documents").select("doc_id", "lang"), "lang", ["en", "fr"])


RARE = "SELECT x FROM (SELECT unnest(topics) AS x FROM reuters21578) WHERE x IS NOT NULL GROUP BY x HAVING count(*) <= 3"


@q(f"SELECT new_id, count(*) AS n FROM reuters21578 WHERE topics IS NULL OR NOT EXISTS (SELECT 1 FROM (SELECT unnest(topics) AS y) WHERE y IN ({RARE})) GROUP BY new_id")
def drop_rare_label_docs(t):
    r = t("reuters21578").select("new_id", "topics")
    x = r.select("new_id", F.explode("topics").alias("x")).where("x is not null")
    bad = x.join(x.groupBy("x").count().where("count <= 3"), "x", "left_semi").select("new_id").distinct()
    return r.join(bad, "new_id", "left_anti").groupBy("new_id").agg(F.count("*").alias("n"))


@q("SELECT new_id FROM reuters21578 WHERE list_has_any(topics, ['crude', 'gold'])")
def any_label_in(t):
    return t("reuters21578").where(F.arrays_overlap("topics", F.array(F.lit("crude"), F.lit("gold")))).select("new_id")


@q("SELECT id, selftext FROM reddit_finance WHERE selftext <> '[removed]'")
def drop_sentinel(t):
    return t("reddit_finance").where("selftext <> '[removed]'").select("id", "selftext")


@q("SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('view', 'click') AND value >= 50")
def mask_rows(t):
    return t("events").where(~F.col("event_type").isin("view", "click") & (F.col("value") >= 50)).select("event_id", "event_type", "value")


@q("SELECT id FROM reddit_finance WHERE subreddit IN (SELECT subreddit FROM reddit_finance GROUP BY subreddit HAVING count(*) > 20)")
def having_filter(t):
    return O.repeated(t("reddit_finance").select("id", "subreddit"), ["subreddit"], 21).select("id")


@q("SELECT sum_id, document, summary FROM summaries WHERE document IS NOT NULL AND summary IS NOT NULL")
def drop_nulls(t):
    return t("summaries").select("sum_id", "document", "summary").na.drop("any")


@q("SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS code, count(*) AS n FROM orders GROUP BY 1, 2")
def category_codes(t):
    code = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("code")
    return t("orders").groupBy("o_orderpriority", code).agg(F.count("*").alias("n"))


@q("SELECT event_id, CASE WHEN value / 100 >= 0.5 THEN 1 ELSE 0 END AS inclusive, CASE WHEN value / 100 - 0.5 > 0 THEN 1 ELSE 0 END AS strict FROM events")
def thresholds(t):
    p = F.col("value") / 100
    return t("events").select("event_id", F.when(p >= 0.5, 1).otherwise(0).alias("inclusive"), F.when(p - 0.5 > 0, 1).otherwise(0).alias("strict"))


@q("SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 'EDITED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey <> 4")
def update_delete_rows(t):
    return t("customer").where("c_custkey <> 4").select("c_custkey", F.when(F.col("c_custkey") == 3, "EDITED").otherwise(F.col("c_mktsegment")).alias("segment"))


# J: joins ------------------------------------------------------------------
@q("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # dimension tables of fixed size
    return t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


HELD = BUCKET.format("doc_id", 0, 10)


@q(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE {HELD} < 2)")
def anti_join_holdout(t):
    d = t("documents").select("doc_id")
    return d.join(d.where(T.bucket("doc_id", 10) < 2), "doc_id", "left_anti")


@q("SELECT DISTINCT new_id FROM (SELECT new_id, unnest(topics) AS x FROM reuters21578 WHERE lower(trim(split)) = 'test') WHERE x IN (SELECT x FROM (SELECT unnest(topics) AS x FROM reuters21578 WHERE lower(trim(split)) = 'train') WHERE x IS NOT NULL GROUP BY x HAVING count(*) <= 8)")
def semi_join_labels(t):
    r = t("reuters21578")
    rare = split(r, "train").select(F.explode("topics").alias("x")).where("x is not null").groupBy("x").count().where("count <= 8")
    return split(r, "test").select("new_id", F.explode("topics").alias("x")).join(rare, "x", "left_semi").select("new_id").distinct()


@q("SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events")
def adjacent_rows(t):
    return t("events").select("event_id", "event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_type"))


@q("""WITH a AS (SELECT x AS topic, count(*) AS n FROM (SELECT unnest(topics) AS x FROM reuters21578 WHERE lower(trim(split)) = 'train') GROUP BY x), b AS (SELECT x AS topic, count(*) AS n FROM (SELECT unnest(topics) AS x FROM reuters21578 WHERE lower(trim(split)) = 'test') GROUP BY x)
SELECT b.topic, coalesce(a.n::VARCHAR, 'MISSING') AS train, b.n AS test FROM b LEFT JOIN a ON a.topic = b.topic WHERE b.topic IS NOT NULL""")
def label_ratio_table(t):
    r = t("reuters21578")
    n = lambda s, a: split(r, s).select(F.explode("topics").alias("topic")).where("topic is not null").groupBy("topic").agg(F.count("*").alias(a))
    return n("test", "test").join(n("train", "train"), "topic", "left").select("topic", F.coalesce(F.col("train").cast("string"), F.lit("MISSING")).alias("train"), "test")


@q(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), k AS (SELECT doc_id, w, CASE WHEN len(w) > 2 THEN 3 ELSE 1 END AS a FROM w)
SELECT doc_id, len(w)::BIGINT AS tokens, list_sum([length(x) FOR x IN w[:a]])::BIGINT AS chars FROM k WHERE len(w) > 0""")
def token_answer_span(t):
    w = t("documents").select("doc_id", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1).alias("w")).where(F.size("w") > 0)
    head = F.slice("w", 1, F.when(F.size("w") > 2, 3).otherwise(1))
    return w.select("doc_id", F.size("w").cast("long").alias("tokens"), F.aggregate(F.transform(head, lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"))


@q("SELECT d.doc_id, n.n_name, count(*)::BIGINT AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(upper(text), '[A-Z]+')) AS w FROM documents) d JOIN nation n ON n.n_name = d.w GROUP BY 1, 2")
def dictionary_linking(t):
    d = t("documents").select("doc_id", F.explode(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z]+)"), 1)).alias("w"))
    return d.join(F.broadcast(t("nation")), F.col("w") == F.col("n_name")).groupBy("doc_id", "n_name").agg(F.count("*").alias("hits"))  # fixed dictionary


# W: windows ----------------------------------------------------------------
@q("SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def ffill_last_value(t):
    e = t("events").withColumn("filled", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return O.forward_fill(e, "filled", "event_id", ["user_id"]).select("event_id", "filled")


@q("SELECT doc_id, n_chars, round(n_chars / avg(n_chars) OVER (PARTITION BY kind), 6) AS relative FROM documents")
def group_transform(t):
    d = t("documents")
    m = d.groupBy("kind").agg(F.avg("n_chars").alias("m"))
    return d.join(m, d["kind"].eqNullSafe(m["kind"])).select("doc_id", "n_chars", F.round(F.col("n_chars") / F.col("m"), 6).alias("relative"))


@q("SELECT doc_id, coalesce(sum(coalesce(length(text), 0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def offsets_cumsum(t):
    return O.running_total(t("documents"), "doc_id", F.coalesce(F.length("text"), F.lit(0)), "start").select("doc_id", "start")


@q("""WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f) SELECT user_id, run, event_type, count(*) AS length FROM r GROUP BY 1, 2, 3""")
def entity_islands(t):
    return O.islands(t("events"), "event_type", ["ts", "event_id"], ["user_id"]).groupBy("user_id", "run", "event_type").agg(F.count("*").alias("length"))


@q("SELECT new_id, title FROM (SELECT new_id, title, row_number() OVER (PARTITION BY title ORDER BY new_id) AS r FROM (SELECT DISTINCT new_id, title FROM reuters21578)) WHERE r = 1")
def keep_first_title(t):
    return O.keep_first(t("reuters21578").select("new_id", "title"), ["title"], "new_id")


@q("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup(t):
    d = t("documents").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    return d.groupBy("h", "m").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@q("SELECT user_id, event_id, value, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def top_k_per_group(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t("events").select("user_id", "event_id", "value", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@q("SELECT (r // 8)::BIGINT AS chunk, list(doc_id ORDER BY doc_id) AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) GROUP BY 1 HAVING count(*) = 8")
def fixed_batches(t):
    r = O.row_numbers(t("documents").select("doc_id"), "doc_id")
    return r.groupBy(F.floor(F.col("row") / 8).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") == 8)  # eight ids a group


@q("SELECT doc_id, (p // 412)::BIGINT AS chunk, substr(text, (p + 1)::BIGINT, 512) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) + 1, 412)) AS p FROM documents WHERE length(text) > 0)")
def chunk_overlap(t):
    return O.chunks(t("documents"), "doc_id", "text", 512, 100)


@q("""WITH s AS (SELECT user_id, row_number() OVER w AS n, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, n - max(CASE WHEN coalesce(value > b, true) THEN n END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stale FROM s)
SELECT event_id, stale::BIGINT AS stale, max(CASE WHEN stale >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM l""")
def early_stopping(t):
    return O.early_stop(t("events"), "event_id", "value", 3, ["user_id"]).select("event_id", "stale", "stopped")


# O: sorts, limits, samples, splits -----------------------------------------
@q("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 5")
def lowest_scores(t):
    return t("events").select("event_id", "value").orderBy("value", "event_id").limit(5)


@q("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def row_slice(t):
    return row_range(t("documents").select("doc_id"), "doc_id", 100, 150)


@q("SELECT DISTINCT c AS ch FROM (SELECT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> ''")
def distinct_characters(t):
    return t("part").select(F.explode(F.split("p_name", "")).alias("ch")).where("ch <> ''").distinct()


@q("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ''), lambda c: c <> ''))), '') AS chars FROM part")
def sorted_characters(t):
    return t("part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("p_name", ""), lambda c: c != ""))), "").alias("chars"))


@q("SELECT doc_id FROM documents WHERE doc_id IN (160, 148, 52)")
def positional_rows(t):
    return t("documents").where(F.col("doc_id").isin(160, 148, 52)).select("doc_id")


@q("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':21'), doc_id LIMIT 100")
def shuffled_head(t):
    return O.sample_rows(t("documents").select("doc_id"), "doc_id", 100, 21)


@q(f"SELECT CASE WHEN {BUCKET.format('doc_id', 0, 1000)} < 800 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM documents GROUP BY 1")
def split_md5(t):
    return t("documents").groupBy(O.part("doc_id", {"train": 800, "test": 200}).alias("part")).agg(F.count("*").alias("n"))


@q("SELECT count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.95)")
def exact_count_split(t):
    r = O.row_numbers(t("documents").select("doc_id"), "doc_id")
    n = r.agg(F.floor(F.count("*") * 0.95).alias("k"))
    return r.crossJoin(F.broadcast(n)).where(F.col("row") < F.col("k")).agg(F.count("*").alias("n"))  # k is one row


@q("SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)")
def ordered_split(t):
    r = O.row_numbers(t("documents").select("doc_id"), "doc_id")
    return r.crossJoin(F.broadcast(r.agg(F.floor(F.count("*") * 0.8).alias("k")))).select("doc_id", F.when(F.col("row") < F.col("k"), "train").otherwise("val").alias("part"))  # k is one row


@q(f"SELECT doc_id, CASE WHEN b < 600 THEN 'train' WHEN b < 800 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, {BUCKET.format('doc_id', 7, 1000)} AS b FROM documents)")
def three_way_split(t):
    return t("documents").select("doc_id", O.part("doc_id", {"train": 600, "val": 200, "test": 200}, 7).alias("part"))


@q("SELECT doc_id, r <= floor(n * 0.2) AS held FROM (SELECT doc_id, row_number() OVER (PARTITION BY kind ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id) AS r, count(*) OVER (PARTITION BY kind) AS n FROM documents)")
def stratified_split(t):
    return O.stratified(t("documents").select("doc_id", "kind"), "doc_id", "kind", 0.2).select("doc_id", "held")


@q("SELECT doc_id, kind FROM (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id) AS r FROM documents) WHERE r <= 8")
def few_shot_sample(t):
    return O.few_shot(t("documents").select("doc_id", "kind"), "doc_id", "kind", 8)


@q()
def random_category_members(t):
    return O.random_category(t("part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 20)


@q()
def multi_label_split(t):
    return O.iterative_strata(t("reuters21578").select("new_id", "topics").dropDuplicates(["new_id"]), "new_id", "topics", 0.2)


# U: set operations ----------------------------------------------------------
@q("SELECT text, 'wikitext' AS origin FROM wikitext UNION ALL SELECT document, 'summaries' FROM summaries UNION ALL SELECT text, 'documents' FROM documents")
def union_sources(t):
    return O.union_sources({"wikitext": t("wikitext").select("text"), "summaries": t("summaries").select(F.col("document").alias("text")), "documents": t("documents").select("text")})


@q("SELECT DISTINCT source, split FROM summaries")
def distinct_rows(t):
    return t("summaries").select("source", "split").distinct()


@q("SELECT DISTINCT new_id FROM reuters21578 EXCEPT SELECT new_id FROM reuters21578 WHERE lower(trim(split)) = 'test'")
def set_difference(t):
    r = t("reuters21578")
    return r.select("new_id").distinct().join(split(r, "test").select("new_id"), "new_id", "left_anti")


@q("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def unordered_pairs(t):
    return t("lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@q("SELECT doc_id % 10 AS k, count(*) AS n FROM documents WHERE lower(trim(lang)) = 'en' GROUP BY 1")
def one_split(t):
    return split(t("documents"), "en", "lang").groupBy((F.col("doc_id") % 10).alias("k")).agg(F.count("*").alias("n"))
