from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import arrays as A
from lexiloom.functions import text as T
from lexiloom.functions.python import ascii_fold, recursive_chunks, split_recursively, token_offsets


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items()))
    assert names
    return df.select(column.alias("x")).first()["x"]


def test_words_and_cleaning(spark):
    assert one(spark, T.words("a"), a=" one\ttwo  three\n") == ["one", "two", "three"]
    assert one(spark, T.words("a"), a="") == []
    assert one(spark, T.words("a"), a=None) is None
    assert one(spark, T.clean_review("a"), a="Great!<br />Film, no?") == "great film no"
    assert one(spark, T.plain_letters("a"), a="Añb 12\nc-d_e") == "Añb  cd_e"
    assert one(spark, T.normal_answer("a"), a=" The  Cat, and a dog. ") == "cat and dog"
    assert one(spark, T.clean_label("a"), a='"Big Topic!"\nmore') == "Big Topic"
    assert one(spark, T.clean_label("a"), a="") == "Unlabelled"
    assert one(spark, T.sentences("a"), a="One. Two. Three.") == ["One.", "Two.", "Three."]
    assert one(spark, T.to_words("a", 3), a="x y") == "x y<pad>"  # padding stands right behind the text
    assert one(spark, T.to_words("a", 1), a="x y") == "x"
    assert one(spark, T.html_text("a"), a="<p>a &amp; b</p><script>x()</script> c") == "a & b c"
    assert one(spark, T.literal_list("a"), a="['x', 'y']") == ["x", "y"]
    assert one(spark, T.between("a", "<o>", "</o>"), a="k<o>v</o>z") == "v"


def test_arrays(spark):
    assert one(spark, A.fit("a", 3, "p"), a=["x"]) == ["x", "p", "p"]
    assert one(spark, A.ngrams("a", 2), a=["x", "y", "z"]) == ["x y", "y z"]
    assert one(spark, A.ngrams("a", 4), a=["x"]) == []
    x, y = A.shifted(F.split("a", ""))
    assert "".join(one(spark, x, a="Tensorflow")) == "Tensorflo"
    assert "".join(one(spark, y, a="Tensorflow")) == "ensorflow"
    assert one(spark, A.multi_hot("a", ["x", "y"]), a=["y", "other"]) == [0.0, 1.0]
    assert one(spark, A.multi_hot(F.lit(None).cast("array<string>"), ["x", "y"]), a="") == [0.0, 0.0]
    assert one(spark, A.from_hot(F.array(F.lit(0.5), F.lit(0.4)), ["x", "y"]), a="") == ["x"]
    assert one(spark, A.argmax(F.array(F.lit(1), F.lit(5), F.lit(5))), a="") == 1
    p = one(spark, A.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), a="")
    assert p == [0.5, 0.5]


def test_python_functions(spark):
    df = spark.createDataFrame([("Ślusàrski",), (None,)], "a string")
    assert [r["x"] for r in df.select(ascii_fold("a").alias("x")).collect()] == ["Slusarski", None]
    t = spark.createDataFrame([("This is!",)], "a string").select(token_offsets("a").alias("x")).first()["x"]
    assert [(z["token"], z["start"], z["stop"]) for z in t] == [("This", 0, 4), ("is", 5, 7), ("!", 7, 8)]
    text = "aa bb cc " * 40
    assert "".join("".join(split_recursively(text, 50)).split()) == "".join(text.split())
    assert all(len(p) <= 50 for p in split_recursively(text, 50))
    c = spark.createDataFrame([(text,), ("",), (None,)], "a string").select(recursive_chunks("a", 60, 10).alias("x")).collect()
    assert all(len(p) <= 61 for p in c[0]["x"]) and c[1]["x"] == [] and c[2]["x"] == []
