"""Queries: text and array functions, tokens, vocabularies, packing, sequence labels, HTML, chats, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import arrays as A
from lexiloom.functions import text as T
from lexiloom.operators import corpus as C
from lexiloom.operators import frames as O
from lexiloom.operators import metrics as M
from lexiloom.plans.eda import LW, W
from lexiloom.sources.readers import html_elements, table

Q: dict = {}
PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def q(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = (lambda spark, d: fn(lambda n: table(spark, d, n)), sql)
        return fn

    return add


# F: scalar functions --------------------------------------------------------
@q(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '', 'g'), '\n', ' ', 'g'), '[^\p{L}\p{M}\p{N}_ \t\n\r\f]', '', 'g')) AS h FROM documents")
def preprocess_text(t):
    return t("documents").select("doc_id", F.md5(T.plain_letters("text")).alias("h"))


@q(rf"SELECT id, regexp_replace(replace(lower(body), '<br />', ' '), '{PUNCT}', '', 'g') AS clean FROM reddit_finance")
def clean_text(t):
    return t("reddit_finance").select("id", T.clean_review("body").alias("clean"))


@q("SELECT id, replace(body, '</s>', '') AS body FROM reddit_finance")
def remove_end_tag(t):
    return t("reddit_finance").select("id", T.without("body", "</s>").alias("body"))


@q(f"SELECT pair_id, array_to_string(list_filter({W.format(f"regexp_replace(lower(output), '{PUNCT}', '', 'g')")}, lambda w: w NOT IN ('a', 'an', 'the')), ' ') AS answer FROM finance_alpaca")
def normalize_answer(t):
    return t("finance_alpaca").select("pair_id", T.normal_answer("output").alias("answer"))


@q("SELECT n_name, length(n_name)::BIGINT AS n, substr(n_name, 1, 3) AS head, replace(n_name, 'A', '4') AS swapped, reverse(n_name) AS back, rpad(n_name, 20, ' ') AS padded, lower(n_name) AS low FROM nation")
def string_functions(t):
    return t("nation").select("n_name", F.length("n_name").cast("long").alias("n"), F.substring("n_name", 1, 3).alias("head"), F.replace("n_name", F.lit("A"), F.lit("4")).alias("swapped"), F.reverse("n_name").alias("back"), T.to_width("n_name", 20).alias("padded"), F.lower("n_name").alias("low"))


@q("SELECT doc_id, split_part(split_part(text, '. ', 2), ', ', 1) AS part FROM documents")
def text_between_markers(t):
    return t("documents").select("doc_id", T.between("text", ". ", ", ").alias("part"))


@q(r"SELECT news_id, list_transform(list_filter(string_split(description, '. '), lambda s: s <> ''), lambda s: CASE WHEN s LIKE '%.' THEN s ELSE s || '.' END) AS sentences FROM news_finance")
def sentence_split(t):
    return t("news_finance").select("news_id", T.sentences("description").alias("sentences"))


@q(r"SELECT new_id, coalesce(nullif(trim(regexp_replace(split_part(title, chr(10), 1), '[^A-Za-z0-9_]+', ' ', 'g')), ''), 'Unlabelled') AS label FROM reuters21578")
def label_cleanup(t):
    return t("reuters21578").select("new_id", T.clean_label("title").alias("label"))


@q("SELECT pair_id, 'Instruction: ' || coalesce(instruction, '') || chr(10) || 'Input: ' || coalesce(input, '') || chr(10) || 'Response: ' || coalesce(output, '') AS prompt FROM finance_alpaca")
def prompt_template(t):
    return t("finance_alpaca").select("pair_id", T.prompt("Instruction: {}\nInput: {}\nResponse: {}", "instruction", "input", "output").alias("prompt"))


@q("SELECT id, '<|user|>' || chr(10) || coalesce(title, '') || '</s>' || chr(10) || '<|assistant|>' || chr(10) || coalesce(body, '') || '</s>' || chr(10) || '<|assistant|>' || chr(10) AS chat FROM reddit_finance")
def chat_template(t):
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("title").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("body").alias("content")))
    return t("reddit_finance").select("id", T.chat(turns).alias("chat"))


@q("WITH w AS (SELECT id, tweet, string_split(tweet, ' ') AS w FROM sem_eval) SELECT id, CASE WHEN len(w) >= 12 THEN array_to_string(w[:12], ' ') ELSE tweet || repeat('<pad>', 12 - len(w)) END AS text FROM w")
def unify_length(t):
    return t("sem_eval").select("id", T.to_words("tweet", 12).alias("text"))


@q(r"""SELECT id, list_filter(regexp_split_to_array(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(tweet), '<br />', ' '), '"', ''), ';', ' '), ':', ' '), '''', ' '' '), '.', ' . '), ',', ' , '), '(', ' ( '), ')', ' ) '), '!', ' ! '), '?', ' ? '), '[ \t\n\r\f]+'), lambda w: w <> '') AS tokens FROM sem_eval""")
def basic_english(t):
    return t("sem_eval").select("id", T.basic_tokens("tweet").alias("tokens"))


@q("SELECT event_id, floor(value / 60)::BIGINT::VARCHAR || 'm ' || floor(value % 60)::BIGINT::VARCHAR || 's' AS took, round(1 / (1 + exp(-value / 10)), 6) AS p, round(exp(value / 50), 4) AS e, round(-ln(1 / (value + 1)), 6) AS nats, round(value / 255, 6) AS scaled, (floor(value / 7) * 7)::BIGINT AS floored FROM events")
def math_functions(t):
    v = F.col("value")
    return t("events").select("event_id", T.elapsed("value").alias("took"), F.round(A.sigmoid(v / 10), 6).alias("p"), F.round(F.exp(v / 50), 4).alias("e"), F.round(-F.log(1 / (v + 1)), 6).alias("nats"), F.round(v / 255, 6).alias("scaled"), (F.floor(v / 7) * 7).cast("long").alias("floored"))


@q("SELECT new_id, replace(to_json(topics)::VARCHAR, '\"', '''') AS literal, topics AS back FROM reuters21578 WHERE topics IS NOT NULL AND len(list_filter(topics, lambda x: x IS NULL)) = 0")
def literal_parse(t):
    r = t("reuters21578").where(F.col("topics").isNotNull() & ~F.exists("topics", lambda x: x.isNull()))
    lit = F.replace(F.to_json("topics"), F.lit('"'), F.lit("'"))
    return r.select("new_id", lit.alias("literal")).withColumn("back", T.literal_list("literal"))


@q("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@q("SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey)::VARCHAR || '|' || greatest(l_partkey, l_suppkey)::VARCHAR AS pair FROM lineitem")
def pair_keys(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", T.pair_key("l_partkey", "l_suppkey").alias("pair"))


@q(f"WITH w AS (SELECT sum_id, {LW.replace('text', 'document')} AS d, {LW.replace('text', 'summary')} AS s FROM summaries WHERE document IS NOT NULL AND summary IS NOT NULL) SELECT sum_id, list_sort(list_distinct(list_filter(s, lambda x: NOT list_contains(d, x)))) AS added FROM w")
def word_difference(t):
    w = t("summaries").where("document is not null and summary is not null").select("sum_id", T.lower_words("document").alias("d"), T.lower_words("summary").alias("s"))
    return w.select("sum_id", F.array_sort(F.array_distinct(F.array_except("s", "d"))).alias("added"))


@q("SELECT sum_id, CASE WHEN lower(trim(source)) IN ('xsum', 'cnn_dailymail') THEN 'summarize: ' || document ELSE document END AS input FROM summaries")
def prefix_by_condition(t):
    s = F.lower(F.trim("source")).isin("xsum", "cnn_dailymail")
    return t("summaries").select("sum_id", F.when(s, F.concat(F.lit("summarize: "), "document")).otherwise(F.col("document")).alias("input"))


@q("SELECT p_partkey, substr(p_name, 1, length(p_name) - 1) AS input, substr(p_name, 2) AS target FROM part")
def shifted_characters(t):
    x, y = A.shifted(F.filter(F.split("p_name", ""), lambda c: c != ""))
    return t("part").select("p_partkey", F.array_join(x, "").alias("input"), F.array_join(y, "").alias("target"))


# arrays ----------------------------------------------------------------------
@q(f"WITH w AS (SELECT id, {W.format('tweet')} AS w FROM sem_eval WHERE tweet IS NOT NULL) SELECT id, list_concat(w, ['<pad>','<pad>','<pad>','<pad>','<pad>','<pad>','<pad>','<pad>'])[:8] AS tokens, (list_concat(list_transform(w, lambda x: 1), [0,0,0,0,0,0,0,0])[:8])::INTEGER[] AS mask FROM w")
def pad_truncate_tokens(t):
    x = t("sem_eval").where("tweet is not null").select("id", A.fit(T.words("tweet"), 8, "<pad>").alias("tokens"))
    return x.withColumn("mask", A.mask("tokens", "<pad>"))


@q("SELECT id, (list_concat(list_transform(['anger','joy'], lambda x: 0), list_transform(range(len(string_split(tweet, ' '))), lambda x: 1)))::INTEGER[] AS ids FROM sem_eval WHERE tweet IS NOT NULL")
def segment_ids(t):
    return t("sem_eval").where("tweet is not null").select("id", A.segments(F.array(F.lit("anger"), F.lit("joy")), T.blank_parts("tweet")).alias("ids"))


TOPICS = ["crude", "gold", "grain", "profits", "trade"]
_T = "[" + ",".join(f"'{x}'" for x in TOPICS) + "]"


@q(f"SELECT new_id, list_transform({_T}, lambda v: CASE WHEN list_contains(coalesce(topics, []), v) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hot, list_filter({_T}, lambda v: list_contains(coalesce(topics, []), v)) AS names FROM reuters21578")
def multi_hot(t):
    clean = F.filter("topics", lambda x: x.isNotNull())
    x = t("reuters21578").select("new_id", A.multi_hot(clean, TOPICS).alias("hot"))
    return x.withColumn("names", A.from_hot("hot", TOPICS))


@q("SELECT s_suppkey, list_transform(range(5), lambda i: CASE WHEN i = s_nationkey % 5 THEN 1 ELSE 0 END)::INTEGER[] AS hot FROM supplier")
def one_hot(t):
    return t("supplier").select("s_suppkey", A.one_hot(F.col("s_nationkey") % 5, 5).alias("hot"))


@q("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def argmax_label(t):
    return t("embeddings").select("vec_id", A.argmax("embedding").alias("best"))


@q("WITH e AS (SELECT vec_id, list_transform(embedding[:4], lambda x: exp(x::DOUBLE - list_max(embedding[:4])::DOUBLE)) AS e FROM embeddings) SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 5)) AS p FROM e")
def softmax(t):
    p = A.softmax(F.slice("embedding", 1, 4))
    return t("embeddings").select("vec_id", F.transform(p, lambda x: F.round(x, 5)).alias("p"))


@q("SELECT new_id, list_filter(list_concat(coalesce(topics, []), coalesce(places, [])), lambda x: x IS NOT NULL) AS labels FROM reuters21578")
def flatten_lists(t):
    return t("reuters21578").select("new_id", F.filter(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("topics", "places")])), lambda x: x.isNotNull()).alias("labels"))


@q("SELECT c_custkey, list_concat(list_concat(['O'], string_split(c_name, '#')), ['O']) AS labels FROM customer")
def wrap_labels(t):
    return t("customer").select("c_custkey", A.wrap(F.split("c_name", "#"), "O", "O").alias("labels"))


@q("SELECT id, list_filter(['anger','joy','trust'], lambda k: CASE k WHEN 'anger' THEN coalesce(anger, false) WHEN 'joy' THEN coalesce(joy, false) ELSE coalesce(trust, false) END) AS on_ FROM sem_eval")
def map_filter(t):
    m = F.create_map(*[x for c in ("anger", "joy", "trust") for x in (F.lit(c), F.coalesce(c, F.lit(False)))])
    return t("sem_eval").select("id", F.map_keys(F.map_filter(m, lambda k, v: v)).alias("on_"))


@q("SELECT id, anger::INT + joy::INT + love::INT AS flags FROM sem_eval")
def wide_flags(t):
    return t("sem_eval").select("id", (F.col("anger").cast("int") + F.col("joy").cast("int") + F.col("love").cast("int")).alias("flags"))


# T: tokens --------------------------------------------------------------------
VOCAB = f"(SELECT w AS token, count(*) AS cnt FROM (SELECT unnest({LW}) AS w FROM documents) GROUP BY w ORDER BY cnt DESC, token LIMIT 500)"


@q(f"SELECT '<unk>' AS token, 0::BIGINT AS cnt, 0::BIGINT AS id UNION ALL SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS id FROM {VOCAB}")
def vocab_build(t):
    return C.vocabulary(t("documents").select(F.explode(T.lower_words("text")).alias("w")), "w", 500)


@q(f"WITH v AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) AS id FROM {VOCAB}), f AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT doc_id, {LW} AS w FROM documents WHERE text IS NOT NULL)) SELECT doc_id, list(coalesce(id, 0) ORDER BY i) AS ids FROM f LEFT JOIN v USING (token) GROUP BY doc_id")
def vocab_encode(t):
    d = t("documents")
    v = C.vocabulary(d.select(F.explode(T.lower_words("text")).alias("w")), "w", 500)
    return C.encode(d.where("text is not null").select("doc_id", T.lower_words("text").alias("tokens")), "doc_id", "tokens", v).where(F.size("ids") > 0)


@q(f"WITH v AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) AS id FROM {VOCAB}), f AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT doc_id, {LW} AS w FROM documents WHERE text IS NOT NULL)) SELECT doc_id, string_agg(coalesce(v.token, '<unk>'), ' ' ORDER BY i) AS text FROM f LEFT JOIN v USING (token) GROUP BY doc_id")
def decode_ids(t):
    d = t("documents")
    v = C.vocabulary(d.select(F.explode(T.lower_words("text")).alias("w")), "w", 500)
    return C.decode(C.encode(d.where("text is not null").select("doc_id", T.lower_words("text").alias("tokens")), "doc_id", "tokens", v).where(F.size("ids") > 0), "doc_id", "ids", v)


@q(f"WITH f AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest({LW}) AS w FROM documents) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY term), n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS weight FROM f JOIN d USING (term), n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM x) SELECT doc_id, term, tf, df, round(weight, 5) AS weight, rank FROM r WHERE rank <= 3")
def tfidf_topk(t):
    x = C.tf_idf(t("documents").select("doc_id", T.lower_words("text").alias("tokens")), "doc_id", "tokens")
    return C.top_terms(x, "doc_id", 3).select("doc_id", "term", "tf", "df", F.round("weight", 5).alias("weight"), "rank")


@q("WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part), v AS (SELECT c, row_number() OVER (ORDER BY c) AS id FROM (SELECT DISTINCT c FROM c WHERE c <> '')) SELECT p_partkey, sum(id)::BIGINT AS total FROM c JOIN v USING (c) GROUP BY p_partkey")
def character_ids(t):
    c = t("part").select("p_partkey", F.explode(F.split("p_name", "")).alias("c")).where("c <> ''")
    v = c.select("c").distinct().withColumn("id", F.row_number().over(Window.orderBy("c")))  # an alphabet
    return c.join(F.broadcast(v), "c").groupBy("p_partkey").agg(F.sum("id").alias("total"))


@q(f"""WITH w AS (SELECT line_id, {W.format('text')} AS w FROM (SELECT line_id, any_value(text) AS text FROM wikitext WHERE text IS NOT NULL GROUP BY line_id)), f AS (SELECT unnest(w) AS token, row_number() OVER (ORDER BY line_id, i) - 1 AS p FROM (SELECT line_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w) x(line_id, w_, i), (SELECT 1) y) SELECT 1 AS block, ['x'] AS ids WHERE false""".replace("unnest(w) AS token, row_number() OVER (ORDER BY line_id, i) - 1 AS p FROM (SELECT line_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w) x(line_id, w_, i), (SELECT 1) y) SELECT 1 AS block, ['x'] AS ids WHERE false", "w_ AS token, row_number() OVER (ORDER BY line_id, i) - 1 AS p FROM (SELECT line_id, unnest(w) AS w_, generate_subscripts(w, 1) AS i FROM w)) SELECT p // 256 AS block, list(token ORDER BY p) AS ids FROM f GROUP BY 1 HAVING count(*) = 256"))
def block_packing(t):
    one = t("wikitext").where("text is not null").groupBy("line_id").agg(F.any_value("text").alias("text"))
    return O.blocks(one.select("line_id", T.words("text").alias("tokens")), "line_id", 256)


@q(r"WITH w AS (SELECT id, regexp_extract_all(tweet, '[A-Za-z]+') AS w FROM sem_eval WHERE tweet IS NOT NULL) SELECT id, list_concat(list_concat(['[CLS]'], w), ['[SEP]']) AS tokens, list_concat(list_concat([-100], list_transform(w, lambda x: length(x))), [-100])::BIGINT[] AS labels FROM w")
def template_and_labels(t):
    w = F.regexp_extract_all("tweet", F.lit("([A-Za-z]+)"), 1)
    labels = F.concat(F.array(F.lit(-100).cast("long")), F.transform(w, lambda x: F.length(x).cast("long")), F.array(F.lit(-100).cast("long")))
    return t("sem_eval").where("tweet is not null").select("id", A.wrap(w, "[CLS]", "[SEP]").alias("tokens"), labels.alias("labels"))


@q(r"""WITH w AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT id, regexp_extract_all(tweet, '[A-Za-z]+') AS w FROM (SELECT DISTINCT id, tweet FROM sem_eval WHERE tweet IS NOT NULL))), s AS (SELECT id, i, w, unnest(range(ceil(length(w) / 4)::BIGINT)) AS k FROM w)
SELECT id, i::BIGINT AS word, k AS piece, substr(w, (k * 4 + 1)::BIGINT, 4) AS token, CASE WHEN k = 0 THEN length(w)::BIGINT ELSE -100 END AS first_only, length(w)::BIGINT AS all_pieces FROM s""")
def align_labels(t):
    w = t("sem_eval").where("tweet is not null").select("id", "tweet").distinct().select("id", F.posexplode(F.regexp_extract_all("tweet", F.lit("([A-Za-z]+)"), 1)).alias("i", "w"))
    s = w.select("id", (F.col("i") + 1).cast("long").alias("word"), "w", F.explode(F.sequence(F.lit(0), (F.ceil(F.length("w") / 4) - 1).cast("int"))).alias("k"))
    n = F.length("w").cast("long")
    return s.select("id", "word", F.col("k").cast("long").alias("piece"), F.substring(F.col("w"), F.col("k") * 4 + 1, F.lit(4)).alias("token"), F.when(F.col("k") == 0, n).otherwise(F.lit(-100)).alias("first_only"), n.alias("all_pieces"))


@q("SELECT c_custkey, list_filter(string_split(c_name, ''), lambda c: c <> '') AS pieces, length(c_name)::BIGINT AS n FROM customer")
def repeat_labels(t):
    ch = F.filter(F.split("c_name", ""), lambda c: c != "")
    return t("customer").select("c_custkey", ch.alias("pieces"), F.size(A.repeat_each(F.array("c_name"), F.array(F.size(ch)))).cast("long").alias("n"))


TAGS = """(SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN CASE WHEN lag(event_type) OVER w = 'click' THEN 'I-ACT' ELSE 'B-ACT' END ELSE 'B-' || upper(substr(event_type, 1, 3)) END AS tag, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def tags(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    tag = F.when(F.col("event_type") == "view", "O").when(F.col("event_type") == "click", F.when(F.lag("event_type").over(w) == "click", "I-ACT").otherwise("B-ACT")).otherwise(F.concat(F.lit("B-"), F.upper(F.substring("event_type", 1, 3))))
    return t("events").select("user_id", "event_id", tag.alias("tag"), F.row_number().over(w).cast("long").alias("pos"))


@q(f"WITH g AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS r FROM {TAGS}) SELECT user_id, substr(tag, 3) AS kind, min(pos) AS start, max(pos) + 1 AS stop FROM g WHERE tag <> 'O' GROUP BY user_id, r, substr(tag, 3)")
def entity_spans(t):
    return M.spans(tags(t), ["user_id"], "pos", "tag")


@q(rf"SELECT news_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(description, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS text FROM news_finance")
def html_text_nodes(t):
    return t("news_finance").select("news_id", T.html_text("description").alias("text"))


@q()
def html_element_kinds(t):
    d = t("news_finance").select("news_id", F.concat(F.lit("<h1>"), "title", F.lit("</h1><p>"), "description", F.lit("</p>")).alias("html"))
    return html_elements(d, "news_id", "html").groupBy("kind").agg(F.count("*").alias("n"))


@q(r"""WITH e AS (SELECT new_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line FROM reuters21578) SELECT CASE WHEN regexp_matches(line, '^[^a-z]*[A-Z][^a-z]*$') THEN 'Title' ELSE 'NarrativeText' END AS kind, count(*) AS n FROM e GROUP BY 1""")
def element_histogram(t):
    e = t("reuters21578").select(F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line"))
    kind = F.when(F.col("line").rlike("^[^a-z]*[A-Z][^a-z]*$"), "Title").otherwise("NarrativeText")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@q()
def accent_folding(t):
    from lexiloom.functions.python import ascii_fold

    return t("documents").select("doc_id", ascii_fold("text").alias("folded"))


@q()
def tokens_with_offsets(t):
    from lexiloom.functions.python import token_offsets

    return t("documents").select("doc_id", token_offsets("text").alias("tokens"))


@q()
def recursive_chunks(t):
    from lexiloom.functions.python import recursive_chunks

    return t("documents").where("text is not null").select("doc_id", F.posexplode(recursive_chunks("text", 512, 100)).alias("chunk", "piece"))
