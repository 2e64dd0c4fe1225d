"""Functions of arrays and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import _c


def fit(a: Column | str, n: int, pad) -> Column:
    """Cut or padded to n elements."""
    return F.slice(F.concat(_c(a), F.array_repeat(F.lit(pad), n)), 1, n)


def mask(a: Column | str, pad) -> Column:
    return F.transform(_c(a), lambda x: (x != F.lit(pad)).cast("int"))


def segments(a: Column | str, b: Column | str) -> Column:
    """0 for each element of the first array, 1 for each of the second."""
    return F.concat(F.array_repeat(F.lit(0), F.size(_c(a))), F.array_repeat(F.lit(1), F.size(_c(b))))


def multi_hot(labels: Column | str, vocabulary: list[str]) -> Column:
    """1.0 for each label of the vocabulary that the array holds; others are ignored, null is none."""
    have = F.coalesce(_c(labels), F.array().cast("array<string>"))
    return F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.array_contains(have, v).cast("double"))


def from_hot(hot: Column | str, vocabulary: list[str], threshold: float = 0.5) -> Column:
    pairs = F.arrays_zip(_c(hot).alias("p"), F.array(*map(F.lit, vocabulary)).alias("v"))
    return F.transform(F.filter(pairs, lambda z: z["p"] >= threshold), lambda z: z["v"])


def one_hot(code: Column | str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == _c(code)).cast("int"))


def argmax(a: Column | str) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(_c(a), F.array_max(_c(a))) - 1


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(a: Column | str) -> Column:
    """Exponentials of the differences to the largest element, normalised."""
    e = F.transform(_c(a), lambda x: F.exp(x.cast("double") - F.array_max(_c(a)).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def ngrams(a: Column | str, n: int) -> Column:
    """The n-grams of an array of strings, joined by blanks."""
    c = F.coalesce(_c(a), F.array().cast("array<string>"))
    many = F.greatest(F.size(c) - (n - 1), F.lit(0))
    out = F.slice(c, F.lit(1), many)
    for k in range(2, n + 1):  # shifted arrays are zipped, so that the array is not computed again for every place
        out = F.zip_with(out, F.slice(c, F.lit(k), many), lambda x, y: F.concat_ws(" ", x, y))
    return out


def repeat_each(values: Column | str, counts: Column | str) -> Column:
    return F.flatten(F.zip_with(_c(values), _c(counts), lambda v, k: F.array_repeat(v, k.cast("int"))))


def shifted(a: Column | str) -> tuple[Column, Column]:
    """Input and target of a sequence model: all but the last, all but the first."""
    c = _c(a)
    return F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1)


def wrap(a: Column | str, first, last) -> Column:
    return F.concat(F.array(F.lit(first)), _c(a), F.array(F.lit(last)))
