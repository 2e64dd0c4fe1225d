"""Spans and tokens: offsets, containment, labels of word pieces, answer positions, dependency patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a document that are joined in one go.
STRETCH = 4_096


def blank_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, token, start, stop): the parts between single blanks with their places in the text, from 0; empty parts keep their place."""
    flat = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, " ", -1)).alias("i", "token"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # one document
    start = F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)).cast("long")
    return flat.withColumn("start", start).withColumn("stop", (F.col("start") + F.length("token")).cast("long"))


def covering(spans: DataFrame, tokens: DataFrame, key: str, span: str) -> DataFrame:
    """(key, span, first, last): the tokens (i, start, stop) that a span (start, stop) touches; spans that touch none are left out.

    An interval join by stretches of STRETCH characters: a document of any
    length is spread over as many tasks, and each span meets only the tokens of
    the stretches that it lies in. Null bounds take no part.
    """
    step = F.lit(STRETCH)
    s = spans.where("start < stop").select(key, span, F.col("start").alias("_a"), F.col("stop").alias("_b")).withColumn("_s", F.explode(F.sequence(F.floor(F.col("_a") / step), F.floor((F.col("_b") - 1) / step))))
    t = tokens.where("start < stop").select(key, "i", "start", "stop").withColumn("_s", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("stop") - 1) / step))))
    hit = s.join(t, [key, "_s"]).where("start < _b and stop > _a")
    return hit.groupBy(key, span).agg(F.min("i").cast("long").alias("first"), F.max("i").cast("long").alias("last"))


def answer_features(answers: DataFrame, tokens: DataFrame, key: str, size: int, stride: int) -> DataFrame:
    """(key, feature, begin, first, last) of question answering: windows of ``size`` tokens, each ``stride`` after the one before, with the places of the answer's tokens in the window, from 1; 0 (the class token) where the window does not hold all of it."""
    n = tokens.groupBy(key).agg((F.max("i") + 1).alias("n"))
    last = F.greatest(F.ceil((F.col("n") - size) / stride), F.lit(0)).cast("int")
    windows = n.select(key, F.explode(F.sequence(F.lit(0), last)).alias("feature")).withColumn("begin", (F.col("feature") * stride).cast("long"))
    all_ = windows.join(answers.select(key, F.col("first").alias("_f"), F.col("last").alias("_l")), key, "left")
    whole = F.coalesce((F.col("_f") >= F.col("begin")) & (F.col("_l") < F.col("begin") + size), F.lit(False))
    place = lambda c: F.when(whole, F.col(c) - F.col("begin") + 1).otherwise(0).cast("long")
    return all_.select(key, F.col("feature").cast("long").alias("feature"), "begin", place("_f").alias("first"), place("_l").alias("last"))


def first_pieces(pieces: DataFrame) -> DataFrame:
    """Word pieces that open a word: their offsets within it start at 0 and do not end there (special tokens have 0, 0)."""
    return pieces.where("start = 0 and stop <> 0")


def piece_labels(pieces: DataFrame, label: str, ignore: int = -100) -> DataFrame:
    """Adds ``piece_label``: the word's label on its first piece, ``ignore`` on the others and on special tokens."""
    return pieces.withColumn("piece_label", F.when((F.col("start") == 0) & (F.col("stop") != 0), F.col(label)).otherwise(ignore).cast("long"))


def triples(tokens: DataFrame, key: str) -> DataFrame:
    """(key, subject, verb, modifier, object) of dependency trees (i, word, relation, head): a verb with a nominal subject and a direct object, and the object's last adjective, if any."""
    by = lambda *r: tokens.where(F.col("relation").isin(*r))
    verb = by("ROOT").select(key, F.col("i").alias("_v"), F.col("word").alias("verb"))
    subject = by("nsubj").select(key, F.col("head").alias("_v"), F.col("word").alias("subject"))
    object_ = by("dobj").select(key, F.col("head").alias("_v"), F.col("i").alias("_o"), F.col("word").alias("object"))
    modifier = by("amod").groupBy(key, F.col("head").alias("_o")).agg(F.max_by("word", "i").alias("modifier"))
    return subject.join(verb, [key, "_v"]).join(object_, [key, "_v"]).join(modifier, [key, "_o"], "left").select(key, "subject", "verb", "modifier", "object")
