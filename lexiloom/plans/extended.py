"""Queries: n-gram weights and topics, retrieval, spans and word pieces, multi-label metrics, orders, model selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiloom.functions import arrays as A
from lexiloom.functions import text as T
from lexiloom.operators import corpus as C
from lexiloom.operators import frames as O
from lexiloom.operators import metrics as M
from lexiloom.operators import models as X
from lexiloom.operators import similarity as S
from lexiloom.operators import spans as P
from lexiloom.plans.eda import LW
from lexiloom.plans.learn import G, scored
from lexiloom.sources.readers import split, table

Q: dict = {}
COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"


def q(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = (lambda spark, d: fn(lambda n: table(spark, d, n)), sql)
        return fn

    return add


# n-gram weights and topics --------------------------------------------------------
GRAMS = f"SELECT {{0}}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {{0}}, {LW} AS w FROM documents)"


@q(f"""WITH g AS ({GRAMS.format('doc_id')}), v AS (SELECT term FROM g GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000), f AS (SELECT doc_id, term, count(*) AS tf FROM g JOIN v USING (term) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM f JOIN d USING (term), n), y AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM y)
SELECT doc_id, term, tf, df, round(weight, 5) AS weight, rank FROM r WHERE rank <= 3""")
def tfidf_bigrams(t):
    x = C.capped_tf_idf(t("documents").select("doc_id", T.lower_words("text").alias("tokens")), "doc_id", "tokens", 1000)
    return C.top_terms(x, "doc_id", 3).select("doc_id", "term", "tf", "df", F.round("weight", 5).alias("weight"), "rank")


@q(f"""WITH f AS (SELECT topic, term, count(*) AS tf FROM ({GRAMS.format("coalesce(kind, '?') AS topic").replace("unnest(list_concat", "unnest(list_concat").replace("SELECT coalesce(kind, '?') AS topic, unnest", "SELECT topic, unnest", 1)}) GROUP BY ALL), s AS (SELECT topic, sum(tf) AS words FROM f GROUP BY topic), m AS (SELECT avg(words) AS mean FROM s), g AS (SELECT term, sum(tf) AS f FROM f GROUP BY term),
x AS (SELECT f.topic, f.term, f.tf, f.tf / s.words * ln(1 + m.mean / g.f) AS weight FROM f JOIN s USING (topic) JOIN g USING (term), m), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM x) SELECT topic, term, tf, round(weight, 6) AS weight, rank FROM r WHERE rank <= 10""")
def topic_bigrams(t):
    x = C.class_tf_idf(t("documents").select(F.coalesce("kind", F.lit("?")).alias("topic"), C.word_grams(T.lower_words("text"), 2).alias("tokens")), "topic", "tokens")
    return C.top_terms(x, "topic", 10).select("topic", "term", "tf", F.round("weight", 6).alias("weight"), "rank")


CENTRES = "(SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label)"


@q(f"SELECT c.label AS topic, round({COS.format('c.c', 'e.embedding')}, 5) AS cosine FROM {CENTRES} c, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) e ORDER BY round({COS.format('c.c', 'e.embedding')}, 12) DESC, topic LIMIT 3")
def topics_found(t):
    first = t("embeddings").where("embedding is not null").orderBy("vec_id").select("embedding").first()  # the search vector
    return C.find_topics(C.topic_centres(t("embeddings"), "label", "embedding"), first["embedding"] if first else [], 3).select("topic", F.round("cosine", 5).alias("cosine"))


@q("SELECT count(DISTINCT label) AS topics, least(count(DISTINCT label), 4) AS merged FROM embeddings")
def topics_merged(t):
    m = C.merge_topics(C.topic_centres(t("embeddings"), "label", "embedding"), 4)
    return m.agg(F.countDistinct("topic").alias("topics"), F.countDistinct("merged").alias("merged"))


# retrieval ------------------------------------------------------------------------
def _index(t):
    from lexiloom.operators.retrieval import Index
    from lexiloom.session import shared_dir

    e = t("embeddings")
    path = f"{shared_dir(e.sparkSession)}/index-{uuid.uuid4().hex}"
    even = (F.col("vec_id") % 2) == 0
    Index.build(e.where(even), "vec_id", "embedding", path, 16).append(e.where(~even), "vec_id", "embedding")  # in two loads
    return e, Index(e.sparkSession, path)


@q("SELECT count(*) AS rows, count(*) FILTER (vec_id % 100 = 0) AS queries, true AS enough FROM embeddings")
def retrieval_recall(t):
    """Of the index: its rows, the queries put to it, and whether they find 0.9 of what a search of all rows finds."""
    e, index = _index(t)
    asked = e.where("vec_id % 100 = 0")
    got = index.search(asked, "vec_id", "embedding", 5, 12).select("query_id", F.col("key").alias("vec_id"), F.lit(1).alias("hit"))
    want = S.nearest(asked, e, "vec_id", "embedding", 5).select("query_id", "vec_id")
    recall = want.join(got, ["query_id", "vec_id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))
    return index.rows().agg(F.count("*").alias("rows")).crossJoin(asked.agg(F.count("*").alias("queries"))).crossJoin(recall)  # one row each


@q(f"SELECT query_id, key, round(cosine, 5) AS cosine, rank FROM (SELECT x.vec_id AS query_id, y.vec_id AS key, {COS.format('x.embedding', 'y.embedding')} AS cosine, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({COS.format('x.embedding', 'y.embedding')}, 12) DESC, y.vec_id) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND x.vec_id % 100 = 0) WHERE rank <= 3")
def retrieval_exact(t):
    e, index = _index(t)
    return index.search(e.where("vec_id % 100 = 0"), "vec_id", "embedding", 3, 16).select("query_id", "key", F.round("cosine", 5).alias("cosine"), "rank")


@q("WITH q AS (SELECT label, vec_id AS t, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT label, vec_id // 50 AS doc, embedding AS e FROM embeddings), m AS (SELECT label, doc, t, max(list_dot_product(q.e::DOUBLE[], d.e::DOUBLE[])) AS m FROM q JOIN d USING (label) GROUP BY ALL) SELECT label, doc, round(sum(m), 4) AS score FROM m GROUP BY ALL")
def late_interaction(t):
    e = t("embeddings")
    docs = e.select("label", F.floor(F.col("vec_id") / 50).alias("doc"), "embedding")
    return S.maxsim(e.where("vec_id % 100 = 0").select("label", "embedding"), docs, "label", "doc", "embedding").select("label", "doc", F.round("score", 4).alias("score"))


@q("SELECT id, unnest(['anger', 'joy', 'fear']) AS label, 'This text expresses ' || unnest(['anger', 'joy', 'fear']) || '.' AS hypothesis FROM sem_eval")
def candidate_pairs(t):
    c = t("sem_eval").select("id", F.explode(F.array(*map(F.lit, ("anger", "joy", "fear")))).alias("label"))
    return c.withColumn("hypothesis", F.concat(F.lit("This text expresses "), "label", F.lit(".")))


# spans and word pieces --------------------------------------------------------------
SPANS = """x AS (SELECT news_id, any_value(description) AS text FROM news_finance WHERE description IS NOT NULL GROUP BY news_id), w AS (SELECT news_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS token FROM (SELECT news_id, string_split(text, ' ') AS w FROM x)),
k AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY news_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM w), a AS (SELECT news_id, strpos(text, '. ') + 1 AS start, strpos(text, '. ') + 21 AS stop FROM x WHERE contains(text, '. ')),
h AS (SELECT a.news_id, min(i)::BIGINT AS first, max(i)::BIGINT AS last FROM a JOIN k ON k.news_id = a.news_id AND k.start < a.stop AND k.start + length(token) > a.start AND length(token) > 0 GROUP BY a.news_id)"""


def _answers(t):
    x = t("news_finance").where("description is not null").groupBy("news_id").agg(F.any_value("description").alias("text"))
    at = F.instr("text", ". ").cast("long")
    a = x.where(F.contains("text", F.lit(". "))).select("news_id", F.lit("answer").alias("span"), (at + 1).alias("start"), (at + 21).alias("stop"))
    k = P.blank_tokens(x, "news_id", "text")
    return P.covering(a, k, "news_id", "span"), k


@q(f"WITH {SPANS} SELECT * FROM h")
def answer_tokens(t):
    return _answers(t)[0].select("news_id", "first", "last")


@q(f"""WITH {SPANS}, n AS (SELECT news_id, max(i) + 1 AS n FROM k GROUP BY news_id), f AS (SELECT news_id, unnest(range(greatest(ceil((n - 32) / 16), 0)::BIGINT + 1)) AS feature FROM n)
SELECT f.news_id, feature, feature * 16 AS begin, CASE WHEN h.first >= feature * 16 AND h.last < feature * 16 + 32 THEN h.first - feature * 16 + 1 ELSE 0 END AS first, CASE WHEN h.first >= feature * 16 AND h.last < feature * 16 + 32 THEN h.last - feature * 16 + 1 ELSE 0 END AS last FROM f LEFT JOIN h USING (news_id)""")
def answer_windows(t):
    return P.answer_features(*_answers(t), "news_id", 32, 16)


PIECES = r"""w AS (SELECT id, generate_subscripts(w, 1) AS word, unnest(w) AS w FROM (SELECT id, regexp_extract_all(tweet, '[A-Za-z]+') AS w FROM (SELECT DISTINCT id, tweet FROM sem_eval WHERE tweet IS NOT NULL))), p AS (SELECT id, word, w, unnest(range(ceil(length(w) / 4)::BIGINT)) * 4 AS start FROM w)"""


def _pieces(t):
    """Pieces of four letters with their offsets within the word."""
    w = t("sem_eval").where("tweet is not null").select("id", "tweet").distinct().select("id", F.posexplode(F.regexp_extract_all("tweet", F.lit("([A-Za-z]+)"), 1)).alias("i", "w"))
    p = w.select("id", (F.col("i") + 1).cast("long").alias("word"), F.length("w").cast("long").alias("size"), F.explode(F.sequence(F.lit(0), F.length("w") - 1, F.lit(4))).alias("start")).withColumn("start", F.col("start").cast("long"))
    return p.withColumn("stop", F.least(F.col("start") + 4, "size"))


@q(f"WITH {PIECES} SELECT id, word::BIGINT AS word, start, CASE WHEN start = 0 THEN length(w)::BIGINT ELSE -100 END AS piece_label FROM p")
def offset_labels(t):
    return P.piece_labels(_pieces(t), "size").select("id", "word", "start", "piece_label")


@q(f"WITH {PIECES} SELECT id, word::BIGINT AS word, length(w)::BIGINT % 3 AS predicted FROM p WHERE start = 0")
def word_predictions(t):
    return P.first_pieces(_pieces(t).withColumn("predicted", (F.col("size") + F.col("start")) % 3)).select("id", "word", "predicted")


@q("SELECT o_orderkey, c_name AS subject, 'placed' AS verb, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS modifier, 'order' AS object FROM orders JOIN customer ON c_custkey = o_custkey")
def dependency_triples(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    word = lambda i, w, relation, head: F.struct(F.lit(i).alias("i"), w.alias("word"), F.lit(relation).alias("relation"), F.lit(head).alias("head"))
    tree = F.array(word(1, F.col("c_name"), "nsubj", 2), word(2, F.lit("placed"), "ROOT", 2), word(3, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), "amod", 4), word(4, F.lit("order"), "dobj", 2))
    return P.triples(o.select("o_orderkey", F.inline(F.filter(tree, lambda x: x["word"].isNotNull()))), "o_orderkey")


# metrics ----------------------------------------------------------------------------
GP = "(SELECT coalesce(list_distinct(list_filter(topics, lambda x: x IS NOT NULL)), []) AS g, coalesce(list_distinct(list_filter(topics[:1], lambda x: x IS NOT NULL)), []) AS p FROM reuters21578)"


def _first_label(t):
    return t("reuters21578").select(F.filter("topics", lambda x: x.isNotNull()).alias("g"), F.filter(F.slice("topics", 1, 1), lambda x: x.isNotNull()).alias("p"))


@q(f"""WITH x AS {GP}, f AS (SELECT label, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p, sum(b)::BIGINT AS b FROM (SELECT unnest(g) AS label, 1 AS g, 0 AS p, 0 AS b FROM x UNION ALL SELECT unnest(p), 0, 1, 0 FROM x UNION ALL SELECT unnest(list_intersect(g, p)), 0, 0, 1 FROM x) GROUP BY label UNION ALL SELECT 'micro avg', sum(len(g)), sum(len(p)), sum(len(list_intersect(g, p))) FROM x),
s AS (SELECT label, CASE WHEN p > 0 THEN b / p ELSE 0 END AS precision, CASE WHEN g > 0 THEN b / g ELSE 0 END AS recall, g AS support FROM f), r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r WHERE label <> 'micro avg'""")
def multi_label_report(t):
    r = M.multi_label_report(_first_label(t), "g", "p")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@q(f"SELECT round(avg(CASE WHEN list_sort(g) = list_sort(p) THEN 1.0 ELSE 0.0 END), 6) AS subset_accuracy FROM {GP}")
def subset_accuracy(t):
    return M.subset_accuracy(_first_label(t), "g", "p").select(F.round("subset_accuracy", 6).alias("subset_accuracy"))


@q("WITH x AS (SELECT z_score AS a, normalized_score AS b FROM reddit_finance WHERE z_score IS NOT NULL AND normalized_score IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM x) SELECT round(corr(x, y), 6) AS spearman FROM r")
def spearman(t):
    return M.spearman(t("reddit_finance"), "z_score", "normalized_score").select(F.round("spearman", 6).alias("spearman"))


@q(f"""WITH c AS (SELECT l AS label, sum(CASE WHEN gold = l THEN 1 ELSE 0 END) AS g, sum(CASE WHEN pred = l THEN 1 ELSE 0 END) AS s, sum(CASE WHEN gold = l AND pred = l THEN 1 ELSE 0 END) AS h FROM {G}, (SELECT unnest(['a', 'b', 'c']) AS l) GROUP BY l), m AS (SELECT label, CASE WHEN s > 0 THEN h / s ELSE 0 END AS precision, CASE WHEN g > 0 THEN h / g ELSE 0 END AS recall, g FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT 'accuracy' AS metric, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS value FROM {G} UNION ALL SELECT 'macro precision', round(avg(precision), 6) FROM f UNION ALL SELECT 'macro recall', round(avg(recall), 6) FROM f UNION ALL SELECT 'macro f1', round(avg(f1), 6) FROM f
UNION ALL SELECT 'weighted precision', round(sum(precision * g) / sum(g), 6) FROM f UNION ALL SELECT 'weighted recall', round(sum(recall * g) / sum(g), 6) FROM f UNION ALL SELECT 'weighted f1', round(sum(f1 * g) / sum(g), 6) FROM f""")
def combined_evaluation(t):
    return M.combined(scored(t), "gold", "pred").select("metric", F.round("value", 6).alias("value"))


@q(f"""WITH w AS (SELECT sum_id, any_value({LW.replace('text', 'document')}) AS d, any_value({LW.replace('text', 'summary')}) AS s FROM summaries WHERE document IS NOT NULL AND summary IS NOT NULL GROUP BY sum_id), x AS (SELECT sum_id, list_transform(range(1, len(d)), lambda i: d[i] || ' ' || d[i + 1]) AS d, list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]) AS s FROM w), y AS (SELECT * FROM x WHERE len(d) > 0 AND len(s) > 0),
a AS (SELECT sum_id, g, count(*) AS n FROM (SELECT sum_id, unnest(d) AS g FROM y) GROUP BY 1, 2), b AS (SELECT sum_id, g, count(*) AS n FROM (SELECT sum_id, unnest(s) AS g FROM y) GROUP BY 1, 2),
h AS (SELECT sum_id, sum(least(a.n, b.n)) AS h FROM a JOIN b USING (sum_id, g) GROUP BY 1) SELECT sum_id, round(coalesce(h, 0) / len(s), 6) AS precision, round(coalesce(h, 0) / len(d), 6) AS recall, round(CASE WHEN coalesce(h, 0) > 0 THEN 2 * (h / len(s)) * (h / len(d)) / (h / len(s) + h / len(d)) ELSE 0 END, 6) AS f1 FROM y LEFT JOIN h USING (sum_id)""")
def rouge_2(t):
    w = t("summaries").where("document is not null and summary is not null").groupBy("sum_id").agg(F.any_value("document").alias("d"), F.any_value("summary").alias("s"))
    w = w.select("sum_id", T.lower_words("d").alias("d"), T.lower_words("s").alias("s")).where((F.size("d") > 1) & (F.size("s") > 1))
    return M.overlap_f1(w, "sum_id", "d", "s", 2).select("sum_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@q("SELECT new_id, coalesce(len(list_filter(topics, lambda x: x IS NOT NULL AND lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(split_part(title, ' ', 1), '[^A-Za-z0-9]', '', 'g')))) > 0, false) AS exact FROM reuters21578")
def exact_match_any(t):
    n = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    said = n(F.split_part("title", F.lit(" "), F.lit(1)))
    return t("reuters21578").select("new_id", F.coalesce(F.exists(F.filter("topics", lambda x: x.isNotNull()), lambda x: n(x) == said), F.lit(False)).alias("exact"))


# orders -----------------------------------------------------------------------------
@q("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':5'), doc_id) - 1 AS place FROM documents")
def full_permutation(t):
    return O.permutation(t("documents").select("doc_id"), "doc_id", 5)


@q("WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS b FROM documents) SELECT doc_id, b * 64 + row_number() OVER (PARTITION BY b ORDER BY md5(doc_id::VARCHAR || ':6'), doc_id) - 1 AS place FROM r")
def shuffle_buffer(t):
    return O.shuffle_buffer(t("documents").select("doc_id"), "doc_id", 64, 6)


# models -----------------------------------------------------------------------------
@q("SELECT count(DISTINCT new_id) AS scored FROM reuters21578 WHERE lower(trim(split)) = 'test' AND text IS NOT NULL")
def multi_label_classifier(t):
    """One model per topic, fitted on the training split with the better of two penalties, applied to the test split."""
    r = t("reuters21578").where("text is not null").select("new_id", "split", "topics", C.word_grams(T.lower_words("text"), 2).alias("w")).dropDuplicates(["new_id"])
    found = X.one_against_rest(split(r, "train"), split(r, "test"), "new_id", "w", "topics", ["profits", "crude", "grain"], 2000, penalties=(0.01, 0.1))
    return found.agg(F.countDistinct("new_id").alias("scored"))


@q("SELECT vec_id, label AS given, true AS sums FROM embeddings")
def out_of_fold_probabilities(t):
    p = X.fold_probabilities(t("embeddings"), "vec_id", "embedding", "label")
    return p.select("vec_id", "given", (F.abs(F.aggregate("p", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-6).alias("sums"))
