"""Queries without SQL give rows for documents of every kind."""

from __future__ import annotations

import itertools

from lexiloom.plans import catalogue

TEXTS = [
    (1, "the bank raised the fee of the loan in may", "news"),
    (2, "The bank raised the fee of the loan in May", "wiki"),
    (3, "the bank raised the fee of the loan in june", "qa"),
    (4, "keep the bond and sell the fund", "intent"),
    (5, "keep the bond and sell a fund", None),
    (6, None, "news"),
    (7, " ", "post"),
]


def folder(spark, tmp_path) -> str:
    spark.createDataFrame(TEXTS, "doc_id long, text string, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_near_duplicates_of_every_kind(spark, tmp_path):
    sets = {i: set(t.lower().split()) for i, t, _ in TEXTS if t and t.split()}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(sets, 2)}
    got = catalogue.queries()["jaccard_pairs"](spark, folder(spark, tmp_path)).collect()
    assert {(r["a"], r["b"]): r["jaccard"] for r in got} == {k: round(v, 6) for k, v in want.items() if v >= 0.8}


def test_tokens_with_offsets_of_every_kind(spark, tmp_path):
    got = {r["doc_id"]: r["tokens"] for r in catalogue.queries()["tokens_with_offsets"](spark, folder(spark, tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in TEXTS} and len(got[1]) == 10
