"""Models: Spark ML baselines, pluggable scorers, and a deterministic stand-in.

Pretrained models are not part of this engine: ``score`` takes any function
over batches. ``lexicon_scorer`` is a stand-in for tests, not a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Applies a model to batches of rows; ``load`` runs once a task and gives the function over a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in frames:
            yield predict(pdf)

    return df.mapInPandas(run, schema)


def lexicon_scorer(key: str, text: str, words: dict[str, float]) -> Callable:
    """A stand-in scorer: the mean weight of a text's known words."""

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def predict(pdf: pd.DataFrame) -> pd.DataFrame:
            def one(t: str | None) -> float:
                w = [words[x] for x in (t or "").lower().split() if x in words]
                return sum(w) / len(w) if w else 0.0

            return pd.DataFrame({key: pdf[key], "score": pdf[text].map(one)})

        return predict

    return load


def text_pipeline(tokens: str, label: str, features: int = 5000, kind: str = "logistic"):
    """TF-IDF and a classifier as a Spark ML pipeline (logistic regression or naive Bayes, one against rest where needed)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.feature import IDF, HashingTF

    tf = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=features)
    idf = IDF(inputCol="_tf", outputCol="_x", minDocFreq=2)
    model = NaiveBayes(featuresCol="_x", labelCol=label) if kind == "bayes" else LogisticRegression(featuresCol="_x", labelCol=label, maxIter=20, regParam=0.01)
    return Pipeline(stages=[tf, idf, model])


def vector_classifier(vector: str, label: str, hidden: int = 0, classes: int = 2, width: int = 64):
    """A classifier of dense vectors: logistic, or a perceptron with one hidden layer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

    if hidden:
        return Pipeline(stages=[MultilayerPerceptronClassifier(featuresCol=vector, labelCol=label, layers=[width, hidden, classes], maxIter=30, seed=1)])
    return Pipeline(stages=[LogisticRegression(featuresCol=vector, labelCol=label, maxIter=30, regParam=0.01)])


def topics(df: DataFrame, key: str, vector: str, k: int, dims: int = 8, outlier: float = 0.9, seed: int = 1) -> DataFrame:
    """(key, topic, distance): PCA, k-means, and -1 for rows beyond a quantile of the distance to their centre (an approximate quantile of fixed accuracy)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select(key, array_to_vector(vector).alias("_v"))
    x = PCA(k=dims, inputCol="_v", outputCol="_p").fit(x).transform(x)
    model = KMeans(k=k, featuresCol="_p", predictionCol="_t", seed=seed).fit(x)
    centres = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "_t int, _c array<double>")
    x = model.transform(x).join(F.broadcast(centres), "_t")  # k rows
    d = F.sqrt(F.aggregate(F.zip_with(vector_to_array("_p"), "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    x = x.select(key, "_t", d.alias("distance"))
    far = x.approxQuantile("distance", [outlier], 0.001)
    return x.select(key, F.when(F.col("distance") > (far[0] if far else 0.0), -1).otherwise(F.col("_t")).alias("topic"), "distance")


def train_wordpiece(counts: list[tuple[str, int]], size: int, prefix: str = "##") -> list[str]:
    """A word-piece vocabulary by greedy merges of the most frequent adjacent pieces; ``counts`` are word frequencies, already aggregated."""
    from collections import Counter, defaultdict

    words = [([w[0], *[prefix + c for c in w[1:]]], n) for w, n in counts if w]
    vocab = sorted({p for w, _ in words for p in w})
    pairs: Counter = Counter()
    where: dict = defaultdict(set)
    for i, (w, n) in enumerate(words):
        for a, b in zip(w, w[1:], strict=False):
            pairs[a, b] += n
            where[a, b].add(i)
    while len(vocab) < size and pairs:
        (a, b), n = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        if n < 2:
            break
        new = a + b.removeprefix(prefix)
        vocab.append(new)
        for i in where.pop((a, b)):
            w, n = words[i]
            for x, y in zip(w, w[1:], strict=False):
                pairs[x, y] -= n
                if pairs[x, y] <= 0:
                    del pairs[x, y]
            out, k = [], 0
            while k < len(w):
                if k + 1 < len(w) and w[k] == a and w[k + 1] == b:
                    out.append(new)
                    k += 2
                else:
                    out.append(w[k])
                    k += 1
            words[i] = (out, n)
            for x, y in zip(out, out[1:], strict=False):
                pairs[x, y] += n
                where[x, y].add(i)
        pairs.pop((a, b), None)
    return vocab


def generate(model: dict[str, dict[str, int]], start: str, length: int, temperature: float = 1.0, seed: int = 0, barred: str = "") -> str:
    """Samples characters from an n-gram table (context -> next -> count); barred characters are never drawn."""
    import random

    rnd, out = random.Random(seed), start
    n = len(next(iter(model), ""))
    for _ in range(length):
        options = {c: k ** (1 / temperature) for c, k in model.get(out[-n:], {}).items() if c not in barred}
        if not options:
            break
        out += rnd.choices(list(options), list(options.values()))[0]
    return out


def one_against_rest(train: DataFrame, test: DataFrame, key: str, tokens: str, labels: str, names: list[str], features: int = 5000, threshold: float = 0.5, penalties: tuple[float, ...] = (0.01,), validation: float = 0.2) -> DataFrame:
    """(key, gold, pred): a logistic model per label on TF-IDF, fitted on ``train`` and applied to ``test``.

    ``labels``: an array of labels; ``names``: those to be learned, few by the
    caller's choice. Of several penalties the one with the best micro F1 on a
    held-out part of the training rows (by hash) is taken.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    from lexiloom.functions.text import bucket
    from lexiloom.operators.metrics import micro
    from lexiloom.session import materialise

    have = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    clean = lambda d: d.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("_w"), F.array_intersect(F.array(*map(F.lit, names)), have).alias("gold"))
    train, test = materialise(clean(train), "train"), materialise(clean(test), "test")  # read in every iteration

    def applied(fit_on: DataFrame, to: DataFrame, penalty: float) -> DataFrame:
        prepared = Pipeline(stages=[HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x", minDocFreq=2)]).fit(fit_on)
        x, out = prepared.transform(fit_on), prepared.transform(to)
        hit = []
        for i, name in enumerate(names):
            y = x.withColumn("_y", F.array_contains("gold", name).cast("double"))
            model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=penalty, probabilityCol=f"_p{i}", rawPredictionCol=f"_r{i}", predictionCol=f"_d{i}").fit(y)
            out = model.transform(out)
            hit.append(F.when(F.get(vector_to_array(f"_p{i}"), F.lit(1)) >= threshold, F.lit(name)))
        return out.select(key, "gold", F.filter(F.array(*hit), lambda v: v.isNotNull()).alias("pred"))

    best = penalties[0]
    if len(penalties) > 1:
        held = bucket(key, 1000) < int(validation * 1000)
        scores = {p: micro(applied(train.where(~held), train.where(held), p), "gold", "pred").first()["f1"] for p in penalties}
        best = max(penalties, key=lambda p: (scores[p], -p))
    return applied(train, test, best)


def fold_probabilities(df: DataFrame, key: str, vector: str, label: str, folds: int = 3) -> DataFrame:
    """(key, given, p): out-of-fold class probabilities of a logistic model on vectors; p is an array by class, labels are 0, 1, ..."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from lexiloom.operators.corpus import cross_validated

    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_x"), F.col(label).cast("double").alias("_y"))
    fit = lambda train: LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01).fit(train)
    predict = lambda model, held: model.transform(held).select(key, F.col("_y").cast("int").alias("given"), vector_to_array("probability").alias("p"))
    return cross_validated(rows, key, folds, fit, predict)
