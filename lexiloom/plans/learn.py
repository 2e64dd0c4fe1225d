"""Queries: embeddings, similarity, deduplication, leakage, label quality, topics, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import arrays as A
from lexiloom.functions import text as T
from lexiloom.operators import corpus as C
from lexiloom.operators import frames as O
from lexiloom.operators import metrics as M
from lexiloom.operators import models as X
from lexiloom.operators import similarity as S
from lexiloom.plans.eda import LW
from lexiloom.plans.prepare import TAGS, tags
from lexiloom.sources.readers import table

Q: dict = {}
DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"


def q(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = (lambda spark, d: fn(lambda n: table(spark, d, n)), sql)
        return fn

    return add


# E: similarity ----------------------------------------------------------------
@q(f"SELECT x.vec_id AS a, y.vec_id AS b, round({COS.format('x.embedding', 'y.embedding')}, 5) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {COS.format('x.embedding', 'y.embedding')} >= 0.4")
def cosine_pairs(t):
    return S.angular_join(t("embeddings"), "vec_id", "embedding", 0.4).select("a", "b", F.round("cosine", 5).alias("cosine"))


KNN = f"(SELECT x.vec_id AS query_id, y.vec_id, {COS.format('x.embedding', 'y.embedding')} AS cosine, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({COS.format('x.embedding', 'y.embedding')}, 12) DESC, y.vec_id) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id{{0}})"


@q(f"SELECT query_id, vec_id, round(cosine, 5) AS cosine, rank FROM {KNN.format(' AND x.vec_id % 100 = 0')} WHERE rank <= 5")
def knn_topk(t):
    e = t("embeddings")
    return S.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@q(f"SELECT query_id AS vec_id, round(avg(1 - cosine), 5) AS outlier, round(min(1 - cosine), 5) AS nearest FROM {KNN.format(' AND x.vec_id % 100 = 0')} WHERE rank <= 10 GROUP BY 1")
def nn_outlier_score(t):
    e = t("embeddings")
    n = S.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)
    return n.groupBy(F.col("query_id").alias("vec_id")).agg(F.round(F.avg(1 - F.col("cosine")), 5).alias("outlier"), F.round(F.min(1 - F.col("cosine")), 5).alias("nearest"))


@q(f"SELECT query_id AS test_id, vec_id AS train_id, round(cosine, 5) AS cosine FROM (SELECT x.vec_id AS query_id, y.vec_id, {COS.format('x.embedding', 'y.embedding')} AS cosine, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({COS.format('x.embedding', 'y.embedding')}, 12) DESC, y.vec_id) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id % 5 = 0 AND y.vec_id % 5 <> 0) WHERE rank = 1 AND cosine >= 0.35")
def leakage_first_hit(t):
    e = t("embeddings")
    pairs = S.angular_join(e.where("vec_id % 5 = 0"), "vec_id", "embedding", 0.35, e.where("vec_id % 5 <> 0"))
    best = pairs.groupBy(F.col("a").alias("test_id")).agg(F.max_by(F.struct(F.col("b").alias("train_id"), "cosine"), F.struct(F.round("cosine", 12), -F.col("b"))).alias("x"))
    return best.select("test_id", "x.train_id", F.round("x.cosine", 5).alias("cosine"))


@q(f"""WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {COS.format('x.embedding', 'y.embedding')} >= 0.35),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT i.r, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = i.vec_id AND list_contains(g.kept, e.a)) THEN g.kept ELSE list_append(g.kept, i.vec_id) END FROM g JOIN ids i ON i.r = g.r + 1)
SELECT unnest(kept) AS vec_id FROM g WHERE r = (SELECT max(r) FROM ids)""")
def semantic_dedup_greedy(t):
    e = t("embeddings")
    edges = S.angular_join(e, "vec_id", "embedding", 0.35)
    return S.keep_first_greedy(e.select(F.col("vec_id").cast("long").alias("id")), edges).where("kept").select(F.col("id").alias("vec_id"))


@q()
def semantic_dedup_mapping(t):
    e = t("embeddings")
    out = S.keep_first_greedy(e.select(F.col("vec_id").cast("long").alias("id")), S.angular_join(e, "vec_id", "embedding", 0.35))
    return out.where("not kept").select("id", "original")


# sets of at least 4/5 likeness share one of their rarest n - ceil(4n/5) + 1 words
@q(f"""WITH w AS (SELECT doc_id, unnest(list_distinct({LW})) AS w FROM documents WHERE text IS NOT NULL), f AS (SELECT *, count(*) OVER (PARTITION BY w) AS df, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
g AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, w) AS place FROM f) WHERE place <= n - ceil(0.8 * n) + 1), c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.w = y.w AND x.doc_id < y.doc_id),
s AS (SELECT a, b, x.n AS na, y.n AS nb, count(*) AS s FROM c JOIN f x ON x.doc_id = a JOIN f y ON y.doc_id = b AND y.w = x.w GROUP BY ALL) SELECT a, b, round(s / (na + nb - s), 6) AS jaccard FROM s WHERE 5 * s >= 4 * (na + nb - s)""")
def jaccard_pairs(t):
    from lexiloom.operators.sets import jaccard_join

    d = t("documents").where("text is not null").select("doc_id", F.array_distinct(T.lower_words("text")).alias("w"))
    return jaccard_join(d, "doc_id", "w", 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@q()
def minhash_dedup(t):
    from lexiloom.operators.sets import minhash_pairs

    d = t("documents").where("text is not null").select("doc_id", F.array_distinct(T.lower_words("text")).alias("w"))
    edges = minhash_pairs(d, "doc_id", "w", 0.9)
    return S.keep_first_greedy(d.select(F.col("doc_id").alias("id")), edges).select(F.col("id").alias("doc_id"), "kept", "original")


@q("SELECT r.pair_id AS outer_id, n.pair_id AS inner_id FROM (SELECT DISTINCT pair_id, output FROM finance_alpaca WHERE output IS NOT NULL) r JOIN (SELECT DISTINCT pair_id, instruction FROM finance_alpaca WHERE instruction <> '') n ON contains(r.output, n.instruction)")
def contamination(t):
    from lexiloom.operators.sets import containing

    f = t("finance_alpaca")
    return containing(f, "pair_id", "output", f, "pair_id", "instruction").toDF("outer_id", "inner_id")


@q(f"""SELECT dims, round(avg({COS.format('x.embedding[:dims]', 'y.embedding[:dims]')}), 5) AS mean_cosine, round(corr({COS.format('x.embedding[:dims]', 'y.embedding[:dims]')}, CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 5) AS correlation FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1, (SELECT unnest([64, 32, 16]) AS dims) GROUP BY dims""")
def matryoshka_cosine(t):
    x = t("embeddings")
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("ol"))
    p = x.join(y, "vec_id").withColumn("dims", F.explode(F.array(F.lit(64), F.lit(32), F.lit(16))))
    p = p.withColumn("c", A.cosine(F.slice("embedding", F.lit(1), F.col("dims")), F.slice("other", F.lit(1), F.col("dims"))))
    return p.groupBy("dims").agg(F.round(F.avg("c"), 5).alias("mean_cosine"), F.round(F.corr("c", F.when(F.col("label") == F.col("ol"), 1.0).otherwise(0.0)), 5).alias("correlation"))


@q(f"SELECT round(avg(CASE WHEN {DOT.format('a.embedding', 'p.embedding')} > {DOT.format('a.embedding', 'n.embedding')} THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM embeddings a JOIN embeddings p ON p.vec_id = a.vec_id + 10 JOIN embeddings n ON n.vec_id = a.vec_id + 15")
def triplet_accuracy(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    p = t("embeddings").select((F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").alias("p"))
    n = t("embeddings").select((F.col("vec_id") - 15).alias("vec_id"), F.col("embedding").alias("n"))
    return a.join(p, "vec_id").join(n, "vec_id").agg(F.round(F.avg(F.when(A.dot("a", "p") > A.dot("a", "n"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("n"))


@q("SELECT vec_id, len(list_concat(embedding, embedding[:16]))::BIGINT AS width, round(list_concat(embedding, embedding[:16])[65]::DOUBLE, 5) AS first_again FROM embeddings")
def stacked_embeddings(t):
    s = F.concat("embedding", F.slice("embedding", 1, 16))
    return t("embeddings").select("vec_id", F.size(s).cast("long").alias("width"), F.round(F.element_at(s, 65).cast("double"), 5).alias("first_again"))


@q("SELECT id, z_score, row_number() OVER (PARTITION BY body ORDER BY id, z_score) - 1 AS batch FROM (SELECT DISTINCT id, body, z_score FROM reddit_finance WHERE body IS NOT NULL AND z_score IS NOT NULL)")
def no_duplicate_batches(t):
    d = t("reddit_finance").where("body is not null and z_score is not null").select("id", "body", "z_score").distinct()
    return O.group_rank(d, ["body"], "id", "batch", "z_score").select("id", "z_score", "batch")


@q("SELECT n_name AS head, 'IN' AS relation, r_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_edges(t):
    return t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("head"), F.lit("IN").alias("relation"), F.col("r_name").alias("tail"))  # fixed tables


@q("SELECT n_name AS node FROM nation UNION SELECT r_name FROM region")
def graph_nodes(t):
    return t("nation").select(F.col("n_name").alias("node")).unionAll(t("region").select("r_name")).distinct()


@q("SELECT sum_id, lower(trim(source)) AS source, CASE WHEN lower(trim(source)) IN ('xsum', 'cnn_dailymail') THEN 'news' WHEN lower(trim(source)) = 'samsum' THEN 'chat' ELSE 'other' END AS loss FROM summaries")
def routed_losses(t):
    s = F.lower(F.trim("source"))
    return t("summaries").select("sum_id", s.alias("source"), F.when(s.isin("xsum", "cnn_dailymail"), "news").when(s == "samsum", "chat").otherwise("other").alias("loss"))


@q()
def contrastive_pairs(t):
    e = t("embeddings").select("vec_id", "label")
    nxt = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    same = e.select("vec_id", nxt.alias("other"), F.lit(1).alias("target"))
    far = e.select("vec_id", F.lead("vec_id").over(Window.partitionBy((F.col("vec_id") / 50).cast("int")).orderBy(F.md5(F.col("vec_id").cast("string")))).alias("other"), F.lit(0).alias("target"))
    return same.unionAll(far.join(e.select(F.col("vec_id").alias("other"), F.col("label").alias("l2")), "other").join(e, "vec_id").where("label <> l2").select("vec_id", "other", "target")).where("other is not null")


# topics -------------------------------------------------------------------------
@q(f"""WITH f AS (SELECT topic, w AS term, count(*) AS tf FROM (SELECT coalesce(kind, '?') AS topic, unnest({LW}) AS w FROM documents) GROUP BY 1, 2), s AS (SELECT topic, sum(tf) AS words FROM f GROUP BY topic), m AS (SELECT avg(words) AS mean FROM s), g AS (SELECT term, sum(tf) AS f FROM f GROUP BY term),
x AS (SELECT f.topic, f.term, f.tf, f.tf / s.words * ln(1 + m.mean / g.f) AS weight FROM f JOIN s USING (topic) JOIN g USING (term), m), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM x) SELECT topic, term, tf, round(weight, 6) AS weight, rank FROM r WHERE rank <= 10""")
def class_tfidf(t):
    x = C.class_tf_idf(t("documents").select(F.coalesce("kind", F.lit("?")).alias("topic"), T.lower_words("text").alias("tokens")), "topic", "tokens")
    return C.top_terms(x, "topic", 10).select("topic", "term", "tf", F.round("weight", 6).alias("weight"), "rank")


@q()
def topic_clusters(t):
    return X.topics(t("embeddings"), "vec_id", "embedding", 10).groupBy("topic").agg(F.count("*").alias("n"))


@q("SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 4) AS cosine FROM (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label) a JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label) b ON a.label < b.label")
def topic_similarity(t):
    m = t("embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))  # one centre a label
    b = c.select(F.col("label").alias("b"), F.col("c").alias("d"))
    return c.withColumnRenamed("label", "a").join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(A.cosine("c", "d"), 4).alias("cosine"))  # a row per topic


# label quality -------------------------------------------------------------------
P = "(SELECT event_id, event_id % 3 AS label, list_transform([value + 1, 100 - value + 1, (event_id * 37) % 100 + 1], lambda x: x / (value + 1 + 100 - value + 1 + (event_id * 37) % 100 + 1)) AS p FROM events)"


def probabilities(t):
    v = [F.col("value") + 1, 100 - F.col("value") + 1, (F.col("event_id") * 37) % 100 + 1]
    total = F.col("value") + 1 + 100 - F.col("value") + 1 + (F.col("event_id") * 37) % 100 + 1
    return t("events").select("event_id", (F.col("event_id") % 3).cast("int").alias("label"), F.array(*[x / total for x in v]).alias("p"))


@q(f"""WITH x AS {P}, th AS (SELECT label, avg(p[label + 1]) AS t FROM x GROUP BY label), c AS (SELECT event_id, x.label, p, i.label AS cand, p[i.label + 1] AS v FROM x, th i WHERE p[i.label + 1] >= i.t), b AS (SELECT event_id, arg_max(cand, v * 1000 - cand * 1e-9) AS best FROM c GROUP BY event_id)
SELECT x.event_id, coalesce(best, label)::INT AS suggested, round(p[label + 1], 6) AS score, coalesce(best <> label, false) AS is_issue FROM x LEFT JOIN b USING (event_id)""")
def label_issues(t):
    return C.label_issues(probabilities(t), "event_id", "label", "p").select("event_id", "suggested", F.round("score", 6).alias("score"), "is_issue")


@q()
def out_of_fold_scores(t):
    def fit(train):
        return train.groupBy("label").agg(F.avg("value").alias("mean"))

    def predict(model, rows):
        return rows.join(F.broadcast(model), "label", "left").select("event_id", "mean")  # a row per class

    return C.cross_validated(t("events").select("event_id", (F.col("event_id") % 3).alias("label"), "value"), "event_id", 3, fit, predict)


# M: metrics -------------------------------------------------------------------
G = "(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a' WHEN event_id % 4 = 1 THEN 'b' ELSE 'c' END AS gold, CASE WHEN value < 30 THEN 'a' WHEN value < 60 THEN 'b' ELSE 'c' END AS pred FROM events)"


def scored(t):
    m, v = F.col("event_id") % 4, F.col("value")
    return t("events").select("event_id", F.when(m == 0, "a").when(m == 1, "b").otherwise("c").alias("gold"), F.when(v < 30, "a").when(v < 60, "b").otherwise("c").alias("pred"))


@q(f"SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {G}")
def accuracy(t):
    return scored(t).agg(F.round(F.avg(F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@q(f"SELECT gold, round(100 * avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {G} GROUP BY gold")
def per_class_accuracy(t):
    return scored(t).groupBy("gold").agg(F.round(100 * F.avg(F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@q(f"SELECT gold, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gold), 6) AS share FROM {G} GROUP BY gold, pred")
def confusion_normalised(t):
    return M.confusion(scored(t), "gold", "pred").withColumn("share", F.round("share", 6))


@q(f"""WITH c AS (SELECT l AS label, sum(CASE WHEN gold = l THEN 1 ELSE 0 END) AS g, sum(CASE WHEN pred = l THEN 1 ELSE 0 END) AS s, sum(CASE WHEN gold = l AND pred = l THEN 1 ELSE 0 END) AS h FROM {G}, (SELECT unnest(['a', 'b', 'c']) AS l) GROUP BY l),
m AS (SELECT label, CASE WHEN s > 0 THEN h / s ELSE 0 END AS precision, CASE WHEN g > 0 THEN h / g ELSE 0 END AS recall, g FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, g::BIGINT AS support FROM f UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(g)::BIGINT FROM f
UNION ALL SELECT 'micro avg', round(sum(h) / sum(s), 6), round(sum(h) / sum(g), 6), round(2 * sum(h) / (sum(s) + sum(g)), 6), sum(g)::BIGINT FROM c
UNION ALL SELECT 'weighted avg', round(sum(precision * g) / sum(g), 6), round(sum(recall * g) / sum(g), 6), round(sum(f1 * g) / sum(g), 6), sum(g)::BIGINT FROM f""")
def classification_report(t):
    r = M.report(scored(t), "gold", "pred")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@q("""WITH x AS (SELECT value AS s, event_id % 3 = 0 AS y FROM events), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x)
SELECT round((sum(CASE WHEN y THEN r END) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * (count(*) - sum(y::INT))), 6) AS auc FROM r""")
def micro_auc(t):
    return M.auc(t("events").select("value", (F.col("event_id") % 3 == 0).alias("y")), "value", "y").select(F.round("auc", 6).alias("auc"))


@q("""WITH x AS (SELECT coalesce(list_distinct(list_filter(topics, lambda x: x IS NOT NULL)), []) AS g, coalesce(list_distinct(list_filter(topics[:1], lambda x: x IS NOT NULL)), []) AS p FROM reuters21578), c AS (SELECT sum(len(list_intersect(g, p))) AS h, sum(len(g)) AS g, sum(len(p)) AS p FROM x)
SELECT round(h / p, 6) AS precision, round(h / g, 6) AS recall, round(2 * (h / p) * (h / g) / (h / p + h / g), 6) AS f1 FROM c""")
def multi_label_micro(t):
    clean = F.filter("topics", lambda x: x.isNotNull())
    r = t("reuters21578").select(clean.alias("g"), F.filter(F.slice("topics", 1, 1), lambda x: x.isNotNull()).alias("p"))
    return M.micro(r, "g", "p").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@q(f"""WITH g AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS r FROM {TAGS}), s AS (SELECT user_id, substr(tag, 3) AS kind, min(pos) AS start, max(pos) + 1 AS stop FROM g WHERE tag <> 'O' GROUP BY user_id, r, substr(tag, 3)), p AS (SELECT * FROM s WHERE start % 3 <> 0),
k AS (SELECT kind, count(*) AS gold, count(*) FILTER (start % 3 <> 0) AS said FROM s GROUP BY kind UNION ALL SELECT 'overall', count(*), count(*) FILTER (start % 3 <> 0) FROM s)
SELECT kind, CASE WHEN said > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision, round(said / gold, 6) AS recall, round(CASE WHEN said > 0 THEN 2 * (said / gold) / (1 + said / gold) ELSE 0 END, 6) AS f1, gold AS support FROM k""")
def entity_report(t):
    s = M.spans(tags(t), ["user_id"], "pos", "tag")
    r = M.entity_report(s, s.where("start % 3 <> 0"), ["user_id"])
    return r.select("kind", "precision", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@q("SELECT pair_id, lower(regexp_replace(coalesce(output, ''), '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(coalesce(instruction, ''), '[^A-Za-z0-9]', '', 'g')) AS exact FROM finance_alpaca")
def exact_match(t):
    n = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))
    return t("finance_alpaca").select("pair_id", (n("output") == n("instruction")).alias("exact"))


@q(f"""WITH w AS (SELECT sum_id, any_value({LW.replace('text', 'document')}) AS d, any_value({LW.replace('text', 'summary')}) AS s FROM summaries WHERE document IS NOT NULL AND summary IS NOT NULL GROUP BY sum_id HAVING any_value(len({LW.replace('text', 'document')})) > 0 AND any_value(len({LW.replace('text', 'summary')})) > 0),
a AS (SELECT sum_id, g, count(*) AS n FROM (SELECT sum_id, unnest(d) AS g FROM w) GROUP BY 1, 2), b AS (SELECT sum_id, g, count(*) AS n FROM (SELECT sum_id, unnest(s) AS g FROM w) GROUP BY 1, 2),
h AS (SELECT sum_id, sum(least(a.n, b.n)) AS h FROM a JOIN b USING (sum_id, g) GROUP BY 1) SELECT sum_id, round(coalesce(h, 0) / len(s), 6) AS precision, round(coalesce(h, 0) / len(d), 6) AS recall, round(CASE WHEN coalesce(h, 0) > 0 THEN 2 * (h / len(s)) * (h / len(d)) / (h / len(s) + h / len(d)) ELSE 0 END, 6) AS f1 FROM w LEFT JOIN h USING (sum_id)""")
def rouge_1(t):
    w = t("summaries").where("document is not null and summary is not null").groupBy("sum_id").agg(F.any_value("document").alias("d"), F.any_value("summary").alias("s"))
    w = w.select("sum_id", T.lower_words("d").alias("d"), T.lower_words("s").alias("s")).where((F.size("d") > 0) & (F.size("s") > 0))
    return M.overlap_f1(w, "sum_id", "d", "s", 1).select("sum_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@q()
def rouge_l(t):
    w = t("summaries").where("document is not null and summary is not null")
    return M.longest_common(w.select("sum_id", T.lower_words("document").alias("d"), T.lower_words("summary").alias("s")), "sum_id", "d", "s")


@q(f"""WITH w AS (SELECT generate_subscripts(w, 1) AS i, unnest(w) AS x, doc_id FROM (SELECT doc_id, {LW} AS w FROM documents)), u AS (SELECT x, count(*) AS n FROM w GROUP BY x), t AS (SELECT sum(n) AS t FROM u) SELECT round(exp(-sum(n * ln(n / t)) / sum(n)), 4) AS perplexity FROM u, t""")
def unigram_perplexity(t):
    u = t("documents").select(F.explode(T.lower_words("text")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    total = u.agg(F.sum("n").alias("t"))
    return u.crossJoin(F.broadcast(total)).agg(F.round(F.exp(-F.sum(F.col("n") * F.log(F.col("n") / F.col("t"))) / F.sum("n")), 4).alias("perplexity"))  # t is one row


@q(f"SELECT event_id, gold, pred FROM {G} WHERE gold <> pred")
def disagreements(t):
    return scored(t).where("gold <> pred")


# X: models -------------------------------------------------------------------
@q()
def text_classifier(t):
    d = t("documents").where("text is not null").select("doc_id", T.lower_words("text").alias("w"), F.when(F.col("kind") == "news", 1.0).otherwise(0.0).alias("y"))
    return X.text_pipeline("w", "y", 2000).fit(d).transform(d).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@q()
def bayes_classifier(t):
    d = t("documents").where("text is not null").select("doc_id", T.lower_words("text").alias("w"), F.when(F.col("kind") == "news", 1.0).otherwise(0.0).alias("y"))
    return X.text_pipeline("w", "y", 2000, "bayes").fit(d).transform(d).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@q()
def vector_classifier(t):
    from pyspark.ml.functions import array_to_vector

    e = t("embeddings").select("vec_id", array_to_vector("embedding").alias("x"), F.col("label").cast("double").alias("y"))
    return X.vector_classifier("x", "y", 16, 10).fit(e).transform(e).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@q()
def pluggable_scorer(t):
    return X.score(t("sem_eval").select("id", "tweet"), X.lexicon_scorer("id", "tweet", {"anxious": -1.0, "calm": 1.0, "grateful": 1.0}), "id long, score double")


@q()
def wordpiece_vocabulary(t):
    words = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).groupBy("w").count()
    vocab = X.train_wordpiece([(r["w"], r["count"]) for r in words.collect()], 600)  # a row per word of the alphabet a-z
    return t("documents").sparkSession.createDataFrame(list(enumerate(vocab)), "id long, token string")


@q()
def character_model_sample(t):
    c = t("part").select("p_name").where("length(p_name) > 3")
    g = c.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p_name") - 3), lambda i: F.substring(F.col("p_name"), i, F.lit(4)))).alias("g")).groupBy("g").count().orderBy("g").collect()  # a row per four characters in a row
    model: dict = {}
    for r in g:
        model.setdefault(r["g"][:3], {})[r["g"][3]] = r["count"]
    start = g[0]["g"][:3] if g else ""
    return c.sparkSession.createDataFrame([(k, X.generate(model, start, 20, seed=k)) for k in range(5)], "seed int, text string")
