from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus as C
from lexiloom.operators import frames as O
from lexiloom.operators import metrics as M
from lexiloom.operators import models as X
from lexiloom.operators import similarity as S
from lexiloom.operators import sets as sets_
from lexiloom.operators.sets import containing, jaccard_join
from lexiloom.sources import readers as R
from lexiloom.sources import writers as K


def test_running_total_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "BUCKET", 3)
    df = spark.createDataFrame([(i, i) for i in range(20)], "k long, v long")
    got = {r["k"]: r["offset"] for r in O.running_total(df, "k", F.col("v")).collect()}
    assert got == {i: sum(range(i)) for i in range(20)}


def test_blocks_drop_the_rest(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["d", "e"])], "k long, tokens array<string>")
    assert [(r["block"], r["ids"]) for r in O.blocks(df, "k", 2).orderBy("block").collect()] == [(0, ["a", "b"]), (1, ["c", "d"])]


def test_splits_are_stable_and_exact(spark):
    df = spark.range(1000).withColumn("label", F.col("id") % 3)
    parts = df.groupBy(O.part("id", {"train": 800, "test": 200}).alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 1000
    held = O.stratified(df, "id", "label", 0.1).where("held").groupBy("label").count().collect()
    assert {r["count"] for r in held} == {33}
    assert O.few_shot(df, "id", "label", 5).count() == 15


def test_islands_and_early_stop(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabbba")], "g int, i int, v string")
    assert [r["run"] for r in O.islands(df, "v", ["i"], ["g"]).orderBy("i").collect()] == [1, 1, 2, 2, 2, 3]
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 3.0, 2.0, 2.0, 5.0])], "g int, i int, s double")
    assert [r["stopped"] for r in O.early_stop(s, "i", "s", 2, ["g"]).orderBy("i").collect()] == [False, False, False, True, True]


def test_not_in_keeps_nulls(spark):
    df = spark.createDataFrame([("en",), ("fr",), (None,)], "lang string")
    assert {r["lang"] for r in O.not_in(df, "lang", ["en"]).collect()} == {"fr", None}


def test_vocabulary_encodes_and_decodes(spark):
    d = spark.createDataFrame([(1, ["b", "a", "b", "zz"]), (2, [])], "k long, t array<string>")
    v = C.vocabulary(d.select(F.explode("t").alias("w")), "w", 2)
    assert [(r["token"], r["id"]) for r in v.orderBy("id").collect()] == [("<unk>", 0), ("b", 1), ("a", 2)]
    e = C.encode(d, "k", "t", v)
    assert {r["k"]: r["ids"] for r in e.collect()} == {1: [1, 2, 1, 0], 2: []}
    assert C.decode(e, "k", "ids", v).first()["text"] == "b a b <unk>"


def test_angular_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(S, "PIVOTS", 5)
    monkeypatch.setattr(S, "CELL", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    v[100:] = v[:20] + 0.05 * rng.normal(size=(20, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None)], "id long, v array<float>")
    u = np.float32(v).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for t in (0.5, 0.95):
        want = {(i, j) for i, j in itertools.combinations(range(120), 2) if u[i] @ u[j] >= t}
        assert {(r["a"], r["b"]) for r in S.angular_join(df, "id", "v", t).collect()} == want
    near = S.nearest(df.where("id % 10 = 0"), df, "id", "v", 3)
    for r in near.where("rank = 1").collect():
        sim = u @ u[r["query_id"]]
        sim[r["query_id"]] = -2
        assert sim.argmax() == r["id"]


def test_keep_first_greedy_goes_in_order(spark):
    nodes = spark.range(6)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    got = {r["id"]: (r["kept"], r["original"]) for r in S.keep_first_greedy(nodes, edges).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 2), 4: (True, None), 5: (False, 4)}


def test_jaccard_join_against_brute_force(spark):
    rnd = random.Random(5)
    sets = [frozenset(rnd.choices("abcdefghij", k=rnd.randint(1, 8))) for _ in range(80)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(90, []), (91, None)], "id long, w array<string>")
    for t in (0.5, 0.8):
        want = {(i, j) for i, j in itertools.combinations(range(80), 2) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}
        assert {(r["a"], r["b"]) for r in jaccard_join(df, "id", "w", t).collect()} == want


def test_jaccard_join_sends_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(sets_, "PASS_TOKENS", 5_000)
    rnd = random.Random(8)
    rows = [(i, rnd.sample([f"w{k}" for k in range(70)], rnd.randint(15, 25))) for i in range(1500)]
    rows += [(2000 + i, [*w[:-1], "new"]) for i, w in rows[:60]] + [(3000 + i, w[::-1]) for i, w in rows[:30]] + [(4000, []), (4001, None)]
    bags_ = {i: set(w) for i, w in rows if w}
    want = {(i, j): len(bags_[i] & bags_[j]) / len(bags_[i] | bags_[j]) for i, j in itertools.combinations(bags_, 2)}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName(): f.length() for f in map(disk.getAllFiles().apply, range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before = files()
    got = alike_sets(spark.createDataFrame(rows, "id long, w array<string>"))
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.8}
    assert sum(n for f, n in files().items() if f not in before) < 300_000


def alike_sets(df):
    return {(r["a"], r["b"]): r["jaccard"] for r in jaccard_join(df, "id", "w", 0.8).collect()}


def test_containing(spark):
    outer = spark.createDataFrame([(1, "so she said hello big world again"), (2, "xhello big worldly"), (3, None), (4, "short")], "k long, t string")
    inner = spark.createDataFrame([(7, "hello big world"), (8, "hor"), (9, ""), (10, None)], "k long, t string")
    assert {tuple(r) for r in containing(outer, "k", "t", inner, "k", "t").collect()} == {(1, 7), (2, 7), (4, 8)}


def test_containing_sends_only_what_is_found(spark):
    rnd = random.Random(5)
    words = ["é", "a", "ab", "bank", "Zinsen", "общий", "x" * 40, ""]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(80)]
    outer = [(i, x) for i, x in enumerate(texts)]
    inner = [(i, x[lo : lo + rnd.choice([1, 2, 3, 5, 8, 16, 33, 70])]) for i, x in enumerate(texts) for lo in [rnd.randrange(len(x) + 1)]]
    o, n = spark.createDataFrame(outer, "k long, t string"), spark.createDataFrame(inner, "k long, t string")
    got = containing(o, "k", "t", n, "k", "t")
    assert {tuple(r) for r in got.collect()} == {(i, j) for i, x in outer for j, y in inner if y and y in x}
    # neither words nor characters of the outer texts are sent as rows: there is no generator in the plan
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "g string, p string")
    r = {x["label"]: x for x in M.report(df, "g", "p").collect()}
    assert r["a"]["precision"] == 0.5 and r["a"]["recall"] == 0.5 and r["c"]["f1"] == 0.0 and r["macro avg"]["support"] == 4
    s = spark.createDataFrame([(0.1, False), (0.4, True), (0.35, False), (0.8, True), (0.4, False)], "s double, y boolean")
    assert abs(M.auc(s, "s", "y").first()["auc"] - 5.5 / 6) < 1e-9
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(["O", "B-P", "I-P", "I-L", "B-L", "O"])], "k long, i int, tag string")
    assert sorted((x["kind"], x["start"], x["stop"]) for x in M.spans(t, ["k"], "i", "tag").collect()) == [("L", 3, 4), ("L", 4, 5), ("P", 1, 3)]
    w = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["b", "x", "d"]), (2, [], ["a"])], "k long, g array<string>, p array<string>")
    assert {x["k"]: x["lcs"] for x in M.longest_common(w, "k", "g", "p").collect()} == {1: 2, 2: 0}
    f = M.overlap_f1(w, "k", "g", "p", 1).where("k = 1").first()
    assert abs(f["precision"] - 2 / 3) < 1e-9 and f["recall"] == 0.5


def test_label_issues(spark):
    df = spark.createDataFrame([(1, 0, [0.9, 0.1]), (2, 0, [0.2, 0.8]), (3, 1, [0.3, 0.7])], "k long, y int, p array<double>")
    got = {r["k"]: (r["suggested"], r["is_issue"]) for r in C.label_issues(df, "k", "y", "p").collect()}
    assert got == {1: (0, False), 2: (1, True), 3: (1, False)}


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "tree"
    for split, label, name, text in (("train", "pos", "1", "good\nfilm"), ("train", "neg", "2", "bad"), ("test", "pos", "3", "fine")):
        (root / split / label).mkdir(parents=True, exist_ok=True)
        (root / split / label / f"{name}.txt").write_text(text)
    rows = {(r["split"], r["label"], r["code"], r["text"]) for r in R.labelled_tree(spark, str(root), {"pos": 1, "neg": 0}).collect()}
    assert rows == {("train", "pos", 1, "good\nfilm"), ("train", "neg", 0, "bad"), ("test", "pos", 1, "fine")}
    (tmp_path / "names").mkdir()
    (tmp_path / "names" / "Polish.txt").write_text("Nowak\n\n Wójcik \n")
    assert {tuple(r) for r in R.category_lines(spark, str(tmp_path / "names" / "*.txt")).collect()} == {("Polish", "Nowak"), ("Polish", "Wójcik")}
    (tmp_path / "q.json").write_text('{"data":[{"title":"t","paragraphs":[{"context":"c","qas":[{"id":"1","question":"q","answers":[{"text":"a","answer_start":3}]},{"id":"2","question":"r","answers":[]}]}]}]}')
    assert {(r["id"], r["answer"], r["start"]) for r in R.reading_comprehension(spark, str(tmp_path / "q.json")).collect()} == {("1", "a", 3), ("2", None, None)}
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert R.csv(spark, str(tmp_path / "x.csv"), "a int, b string").collect()[0]["b"] == "two\nlines"
    df = spark.createDataFrame([("a\nb\\c", True, None)], "t string, x boolean, y boolean")
    K.lines(df, str(tmp_path / "lines"), "t")
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == "a\\nb\\\\c"
    K.category_json(df, str(tmp_path / "json"), "t", ["x", "y"])
    assert R.json_lines(spark, str(tmp_path / "json"), "text string, cats struct<x:boolean,y:boolean>").first()["cats"]["y"] is False
    K.documents(df, str(tmp_path / "docs"))
    K.append(df, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2
    K.metrics(spark, {"f1": 0.5}, str(tmp_path / "metrics"))
    assert R.additions(spark, 50).groupBy("a", "b").count().where("count > 1").count() == 0


def test_streaming_counts(spark, tmp_path):
    from lexiloom.streaming import events as E

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "2024-01-01 00:05:00", "a", 1.0, "x y"), (2, "2024-01-01 00:50:00", "a", 2.0, "x"), (2, "2024-01-01 00:50:00", "a", 2.0, "x"), (3, "2024-01-01 02:00:00", "b", 5.0, "z")], "event_id long, s string, event_type string, value double, text string").withColumn("ts", F.to_timestamp("s")).drop("s").coalesce(1).write.parquet(src)
    s = E.stream(spark, src, "event_id long, event_type string, value double, text string, ts timestamp")
    q = E.tumbling(E.keep_first(s, "event_id"), "1 hour", None).writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["event_type"], r["n"], r["total"]) for r in spark.table("tumbled").collect()}
    assert ("a", 2, 3.0) in got


def test_models(spark):
    df = spark.createDataFrame([(1, "good good"), (2, "bad"), (3, None)], "id long, t string")
    got = {r["id"]: r["score"] for r in X.score(df, X.lexicon_scorer("id", "t", {"good": 1.0, "bad": -1.0}), "id long, score double").collect()}
    assert got == {1: 1.0, 2: -1.0, 3: 0.0}
    vocab = X.train_wordpiece([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], 30)
    assert "##est" in vocab
    assert X.generate({"ab": {"c": 1}, "bc": {"d": 1}}, "ab", 5) == "abcd"


@pytest.mark.parametrize("few", [0, 100_000])
def test_keep_first_greedy_tells_long_chains(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_EDGES", few)  # 0: by joins to the end
    edges = spark.createDataFrame([(i, i + 1) for i in range(69)] + [(0, 5)], "a long, b long")
    got = {r["id"]: (r["kept"], r["original"]) for r in S.keep_first_greedy(spark.range(72), edges).collect()}
    want: dict = {}
    for i in range(72):
        near = [a for a in sorted({i - 1} | ({0} if i == 5 else set())) if 0 < i < 70 and want[a][0]]
        want[i] = (not near, near[0] if near else None)
    assert got == want
