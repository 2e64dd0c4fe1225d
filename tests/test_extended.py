"""Operators of spans, retrieval, topics, orders and label metrics against brute force and on odd input."""

from __future__ import annotations

import itertools
import random

import numpy as np

from lexiloom.functions import arrays as A
from lexiloom.functions import text as T
from lexiloom.operators import corpus as C
from lexiloom.operators import frames as O
from lexiloom.operators import metrics as M
from lexiloom.operators import spans as P
from lexiloom.operators.retrieval import Index
from lexiloom.operators.sets import containing
from lexiloom.operators.similarity import nearest
from lexiloom.sources import readers, writers


def test_covering_spans_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "STRETCH", 16)
    text = " ".join(["ab", "", "cdefghijklmnopqrstuvwxyz" * 3, "x"] * 20)
    docs = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9)], "doc long, text string, i int")
    tokens = P.blank_tokens(docs, "doc", "text")
    rows = tokens.where("doc = 1").orderBy("i").collect()
    assert all(text[r["start"] : r["stop"]] == r["token"] for r in rows)
    rnd = random.Random(2)
    spans = [(1, k, s, s + rnd.randint(1, 90)) for k, s in enumerate(rnd.sample(range(len(text)), 40))]
    got = {r["span"]: (r["first"], r["last"]) for r in P.covering(spark.createDataFrame([*spans, (1, 99, None, 3), (1, 98, 5, 5)], "doc long, span long, start long, stop long"), tokens, "doc", "span").collect()}
    want = {}
    for _, k, a, b in spans:
        hit = [r["i"] for r in rows if r["start"] < r["stop"] and r["start"] < b and r["stop"] > a]
        if hit:
            want[k] = (min(hit), max(hit))
    assert got == want


def test_answer_windows_hold_all_tokens(spark):
    tokens = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "doc long, i int")
    answers = spark.createDataFrame([(1, 20, 22)], "doc long, first long, last long")
    f = [tuple(r) for r in P.answer_features(answers, tokens, "doc", 16, 8).orderBy("doc", "feature").collect()]
    assert f[0] == (1, 0, 0, 0, 0) and f[1] == (1, 1, 8, 13, 15) and f[2] == (1, 2, 16, 5, 7) and f[-1] == (2, 0, 0, 0, 0)
    assert {i for _, _, b, _, _ in f[:-1] for i in range(b, b + 16)} >= set(range(50))


def test_triples_without_modifier_or_object(spark):
    rows = [(1, 1, "bank", "nsubj", 2), (1, 2, "raised", "ROOT", 2), (1, 3, "old", "amod", 5), (1, 4, "high", "amod", 5), (1, 5, "fees", "dobj", 2), (2, 1, "it", "nsubj", 2), (2, 2, "rains", "ROOT", 2), (3, 1, "we", "nsubj", 2), (3, 2, "sell", "ROOT", 2), (3, 3, "tin", "dobj", 2)]
    df = spark.createDataFrame(rows, "doc long, i int, word string, relation string, head int")
    assert sorted(tuple(r) for r in P.triples(df, "doc").collect()) == [(1, "bank", "raised", "high", "fees"), (3, "we", "sell", None, "tin")]


def test_index_reloads_appends_and_finds(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    Index.build(df.where("vec_id < 200"), "vec_id", "v", str(tmp_path / "index"), 8)
    Index(spark, str(tmp_path / "index")).append(df.where("vec_id >= 200"), "vec_id", "v")
    index = Index(spark, str(tmp_path / "index"))
    assert index.rows().count() == 300
    asked = df.where("vec_id < 20")
    want = {(r["query_id"], r["vec_id"]) for r in nearest(asked, df, "vec_id", "v", 4).collect()}
    exact = {(r["query_id"], r["key"]) for r in index.search(asked, "vec_id", "v", 4, 8).collect()}
    some = {(r["query_id"], r["key"]) for r in index.search(asked, "vec_id", "v", 4, 6).collect()}
    assert exact == want and len(some & want) >= 0.9 * len(want)
    none = Index.build(df.limit(0), "vec_id", "v", str(tmp_path / "none"), 8)
    assert none.rows().count() == 0 and none.search(asked, "vec_id", "v", 4).count() == 0


def test_topics_merge_and_are_found(spark):
    rows = [(k, [1.0, 0.01 * i, 0.0]) for k, n in ((0, 9), (1, 3)) for i in range(n)] + [(2, [0.0, 0.0, 1.0])] * 5 + [(3, None)]
    c = C.topic_centres(spark.createDataFrame(rows, "label int, v array<double>"), "label", "v")
    assert {r["topic"]: r["merged"] for r in C.merge_topics(c, 2).collect()} == {0: 0, 1: 0, 2: 2}
    assert [r["topic"] for r in C.find_topics(c, [0.0, 0.1, 1.0], 1).collect()] == [2]
    assert C.merge_topics(c.limit(0), 2).count() == 0


def test_orders_and_ranks(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None, i) for i in range(1000)], "k long, g string, _c int")
    ranks = O.group_rank(df.select("k", "g"), ["g"], "k", "n").collect()
    for g in ("hot", None):
        assert [r["n"] for r in sorted((r for r in ranks if r["g"] == g), key=lambda r: r["k"])] == list(range(sum(r["g"] == g for r in ranks)))
    p = O.permutation(df.select("k"), "k", 3).collect()
    assert sorted(r["place"] for r in p) == list(range(1000)) and [r["k"] for r in sorted(p, key=lambda r: r["place"])] != list(range(1000))
    b = O.shuffle_buffer(df.select("k"), "k", 32).collect()
    assert sorted(r["place"] for r in b) == list(range(1000)) and all(r["place"] // 32 == r["k"] // 32 for r in b)
    held = O.stratified(df.select("k", "g"), "k", "g", 0.3).where("held").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in held} == {"hot": 199, None: 100}
    assert O.permutation(df.select("k").limit(0), "k").count() == 0


def test_metrics_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([0.1, 0.5, rnd.random() * 1e6, None]), rnd.random() < 0.4, rnd.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y boolean, z double")
    kept = [(s, y, z) for s, y, z in rows if s is not None]
    pairs = [(a > b) + 0.5 * (a == b) for (a, ya, _), (b, yb, _) in itertools.product(kept, kept) if ya and not yb]
    assert abs(M.auc(df, "s", "y").first()[0] - sum(pairs) / len(pairs)) < 1e-9

    def ranks(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    want = np.corrcoef(ranks([s for s, _, _ in kept]), ranks([z for _, _, z in kept]))[0, 1]
    assert abs(M.spearman(df, "s", "z").first()[0] - want) < 1e-9
    labels = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["b"]), (["b"], ["b"])], "g array<string>, p array<string>")
    r = {x["label"]: x for x in M.multi_label_report(labels, "g", "p").collect()}
    assert (r["a"]["f1"], r["b"]["precision"], r["b"]["recall"], r["micro avg"]["support"]) == (1.0, 0.5, 0.5, 3)
    assert abs(M.subset_accuracy(labels, "g", "p").first()[0] - 1 / 3) < 1e-9


def test_short_texts_are_found_inside(spark):
    outer = spark.createDataFrame([(1, "a b, c"), (2, "tin fell again"), (3, None), (4, "")], "k long, t string")
    inner = spark.createDataFrame([(10, ","), (11, "el"), (12, "fell"), (13, "tin fell again"), (14, ""), (15, None), (16, "in f")], "k long, t string")
    assert {tuple(r) for r in containing(outer, "k", "t", inner, "k", "t").collect()} == {(1, 10), (2, 11), (2, 12), (2, 13), (2, 16)}


def test_words_as_published(spark):
    df = spark.createDataFrame([("Well-known café, isn't it? (\"yes\"; no)",), (None,)], "t string")
    assert [r[0] for r in df.select(T.basic_tokens("t")).collect()] == [["well-known", "café", ",", "isn", "'", "t", "it", "?", "(", "yes", "no", ")"], None]
    df = spark.createDataFrame([("a  b",), ("a b c d e",)], "t string")
    assert [r[0] for r in df.select(T.to_words("t", 4)).collect()] == ["a  b<pad>", "a b c d"]
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(A.ngrams("w", 2)).collect()] == [["a b", "b c"], [], []]


def test_vocabulary_is_saved_and_used(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["zz"])], "doc long, w array<string>")
    v = C.vocabulary(spark.createDataFrame([(x,) for x in "aabbbc"], "w string"), "w", 2)
    writers.vocabulary(v, str(tmp_path / "v"))
    again = readers.vocabulary(spark, str(tmp_path / "v"))
    looked = {r["doc"]: list(r["ids"]) for r in C.encode(docs, "doc", "w", again).collect()}
    assert looked == {1: [1, 2, 1, 0], 2: [], 3: [], 4: [0]}
    monkeypatch.setattr(C, "IN_MEMORY", 1)  # a vocabulary too large for that is joined
    assert {r["doc"]: list(r["ids"]) for r in C.encode(docs, "doc", "w", again).collect()} == looked


def test_models_are_saved(spark, tmp_path):
    from lexiloom.operators import models as X

    df = spark.createDataFrame([(i, ["bank", "fee"] if i % 2 else ["fern", "moss"], float(i % 2)) for i in range(20)], "k long, w array<string>, y double")
    fitted = X.text_pipeline("w", "y", 64).fit(df)
    writers.model(fitted, str(tmp_path / "m"))
    assert readers.model(str(tmp_path / "m")).transform(df).where("prediction = y").count() == 20
    labels = df.selectExpr("k", "w", "if(y = 1, array('money'), array('plants', 'x')) AS labels")
    found = X.one_against_rest(labels, labels, "k", "w", "labels", ["money", "plants"], 64, penalties=(0.01, 1.0))
    assert all(set(r["gold"]) == set(r["pred"]) for r in found.collect())
