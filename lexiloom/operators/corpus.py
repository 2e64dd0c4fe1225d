"""Vocabularies, term weights, encodings, label quality and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Entries of a vocabulary that is looked up in memory.
IN_MEMORY = 1_000_000
SPECIALS = ("<unk>",)


def vocabulary(tokens: DataFrame, token: str, size: int, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """(token, cnt, id): specials first, then the ``size`` most frequent tokens, ties in order of the token. Only the top rows are ranked (top-n, no full sort)."""
    top = tokens.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(size)
    ranked = top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("cnt"), "token")) + (len(specials) - 1)).cast("long"))
    head = tokens.sparkSession.createDataFrame([(s, 0, i) for i, s in enumerate(specials)], "token string, cnt long, id long")
    return head.unionAll(ranked)


def encode(docs: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """(key, ids): token ids in order, unknown ones as ``unknown``; documents without tokens keep an empty list.

    A vocabulary of up to IN_MEMORY entries is looked up in Arrow batches where
    the documents are, without a shuffle; a larger one is joined.
    """
    known = vocab.select("token", "id").limit(IN_MEMORY + 1).collect()
    if len(known) <= IN_MEMORY:
        return _looked_up(docs, key, tokens, {r["token"]: r["id"] for r in known}, unknown)
    flat = docs.select(key, F.posexplode(tokens).alias("pos", "token")).join(vocab.select("token", "id"), "token", "left")
    ids = flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("x"))  # one document's tokens
    return docs.select(key).join(ids, key, "left").select(key, F.coalesce(F.col("x.id"), F.array().cast("array<long>")).alias("ids"))


def _looked_up(docs: DataFrame, key: str, tokens: str, ids: dict[str, int], unknown: int) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        words, numbers = pa.array(list(ids), pa.string()), pa.array([*ids.values(), unknown], pa.int64())
        for b in batches:
            lists = b.column(1).cast(pa.list_(pa.string()))
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=words, skip_nulls=True), len(words))
            size = pc.fill_null(pc.list_value_length(lists), 0)
            ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(size)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends.cast(pa.int32()), numbers.take(at))], names=[key, "ids"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    return docs.select(key, tokens).mapInArrow(run, StructType([docs.schema[key], StructField("ids", ArrayType(LongType()))]))


def decode(df: DataFrame, key: str, ids: str, vocab: DataFrame, glue: str = " ") -> DataFrame:
    flat = df.select(key, F.posexplode(ids).alias("pos", "id")).join(vocab.select("id", "token"), "id", "left")
    return flat.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("token", F.lit("")).alias("t")))), lambda z: z["t"]), glue).alias("text"))


def tf_idf(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, tf, df, weight): long form; weight = tf * (ln((1 + n) / (1 + df)) + 1)."""
    tf = docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(F.count("*").alias("n"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", "tf", "df", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("weight"))  # n is one row


def class_tf_idf(docs: DataFrame, topic: str, tokens: str) -> DataFrame:
    """(topic, term, tf, weight): weight = tf / |topic| * ln(1 + A / f), A the mean words of a topic, f the term's count in all."""
    tf = docs.select(F.col(topic).alias("topic"), F.explode(tokens).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy("topic").agg(F.sum("tf").alias("words"))
    mean = size.agg(F.avg("words").alias("mean"))
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    return tf.join(f, "term").join(F.broadcast(size), "topic").crossJoin(F.broadcast(mean)).select("topic", "term", "tf", (F.col("tf") / F.col("words") * F.log(1 + F.col("mean") / F.col("f"))).alias("weight"))  # a row per topic


def top_terms(weights: DataFrame, topic: str, k: int) -> DataFrame:
    w = Window.partitionBy(topic).orderBy(F.desc(F.round("weight", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def label_issues(probs: DataFrame, key: str, label: str, p: str) -> DataFrame:
    """(key, given, suggested, score, is_issue): confident learning. The threshold of a class is the mean probability of it among rows given it; a row's confident class is the likeliest of those at or above their thresholds. ``p`` is an array by class, ``label`` its index."""
    own = F.get(F.col(p), F.col(label))
    t = probs.groupBy(label).agg(F.avg(own).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("int"), "t"))).alias("t"))  # a row per class
    x = probs.crossJoin(F.broadcast(t)).withColumn("_c", F.filter(F.transform(F.col(p), lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))), lambda z: z["v"] >= F.coalesce(F.try_element_at(F.col("t"), -z["i"]), F.lit(2.0))))
    best = F.array_max("_c")
    x = x.withColumn("_b", F.when(F.size("_c") > 0, -best["i"]))
    return x.select(key, F.col(label).alias("given"), F.coalesce("_b", F.col(label)).cast("int").alias("suggested"), own.alias("score"), (F.col("_b").isNotNull() & (F.col("_b") != F.col(label))).alias("is_issue"))


def cross_validated(df: DataFrame, key: str, folds: int, fit, predict) -> DataFrame:
    """Out-of-fold predictions: ``fit(train)`` gives a model, ``predict(model, rows)`` a frame; folds by hash."""
    from lexiloom.functions.text import bucket

    out = None
    for k in range(folds):
        held = bucket(key, folds) == k
        part = predict(fit(df.where(~held)), df.where(held))
        out = part if out is None else out.unionByName(part)
    return out


def word_grams(tokens, up_to: int):
    """All n-grams of an array of words from 1 to ``up_to`` words."""
    from lexiloom.functions.arrays import ngrams

    return F.concat(*[ngrams(tokens, n) for n in range(1, up_to + 1)])


def capped_tf_idf(docs: DataFrame, key: str, tokens: str, size: int, up_to: int = 2) -> DataFrame:
    """(key, term, tf, df, weight) over the ``size`` most frequent n-grams of up to ``up_to`` words, ties in order of the term; the weights of a document have length 1.

    The vocabulary is as small as the caller says, so the join with it is left
    to the optimizer's size check; all else is one shuffle by document.
    """
    grams = docs.select(key, F.explode(word_grams(tokens, up_to)).alias("term"))
    vocab = vocabulary(grams, "term", size, ()).select(F.col("token").alias("term"))
    tf = grams.join(vocab, "term").groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(F.count("*").alias("n"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    return raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))).select(key, "term", "tf", "df", "weight")


def topic_centres(df: DataFrame, topic: str, vector: str) -> DataFrame:
    """(topic, n, centre): the mean vector of each topic."""
    m = df.where(F.col(vector).isNotNull()).select(F.col(topic).alias("topic"), F.posexplode(vector).alias("i", "v")).groupBy("topic", "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return m.groupBy("topic").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("centre"))  # one vector a topic


def find_topics(centres: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(topic, cosine): the k topics nearest to a search vector, ties by topic."""
    from lexiloom.functions.arrays import cosine

    c = centres.select("topic", cosine("centre", F.array(*[F.lit(float(v)) for v in vector])).alias("cosine"))
    return c.orderBy(F.desc(F.round("cosine", 12)), "topic").limit(k)


def merge_topics(centres: DataFrame, left: int) -> DataFrame:
    """(topic, merged): the smallest topic joins its most similar one, again and again, until ``left`` are left; ties by topic. The centres are a row per topic, few by nature."""
    import numpy as np

    rows = sorted(centres.collect(), key=lambda r: r["topic"])
    size = {r["topic"]: r["n"] for r in rows}
    centre = {r["topic"]: np.array(r["centre"]) for r in rows}
    into = {t: t for t in size}
    while len(size) > left:
        small = min(size, key=lambda t: (size[t], t))
        cos = {t: centre[small] @ centre[t] / max(1e-12, np.linalg.norm(centre[small]) * np.linalg.norm(centre[t])) for t in size if t != small}
        best = min(cos, key=lambda t: (-round(cos[t], 12), t))
        centre[best] = (centre[best] * size[best] + centre[small] * size[small]) / (size[best] + size[small])
        size[best] += size.pop(small)
        into = {t: best if m == small else m for t, m in into.items()}
    kind = centres.schema["topic"].dataType.simpleString()
    return centres.sparkSession.createDataFrame(list(into.items()), f"topic {kind}, merged {kind}")
