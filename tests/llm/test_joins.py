"""Word-bag joins against brute force, with nulls, short and long texts, copies, repeats and empty tables."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import bags
from lexiloom.llm.neardup import NearDuplicates
from lexiloom.llm.overlap import SplitOverlap

WORDS = re.compile(r"[^\W_]+")


def corpus(seed: int, n: int = 150) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the"] * 60 + ["of"] * 40
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        if rows and rnd.random() < 0.4:
            words = (rnd.choice(rows)[1] or "x").split()
            for _ in range(rnd.randint(0, max(1, len(words) // 4))):
                k = rnd.randrange(len(words))
                what = rnd.random()
                if what < 0.4:
                    words[k] = rnd.choice(vocab)
                elif what < 0.7 and len(words) > 5:
                    del words[k]
                else:
                    words.insert(k, rnd.choice(vocab))
            if rnd.random() < 0.3:
                rnd.shuffle(words)
        else:
            words = rnd.choices(vocab, k=rnd.choice([20, 29, 30, 31, 45, 60, 90, 140, 400]))
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1]), (n + 3, (rows[1][1] or "").upper()), (5, rows[5][1])]
    return rows


def alike(rows: list[tuple[int, str | None]], t: float = 0.75) -> set[tuple[int, int]]:
    b = {k: Counter(WORDS.findall(x.lower())) for k, x in dict(rows).items() if x}
    b = {k: c for k, c in b.items() if c.total() >= 30}
    return {(i, j) for i, j in itertools.combinations(sorted(b), 2) if 4 * (b[i] & b[j]).total() >= 4 * t * (b[i] | b[j]).total() - 1e-9}


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 8)])
def test_near_duplicates_lose_no_pair(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(bags, "HOT", hot)  # with 8, crowded regions are cut into blocks
    monkeypatch.setattr(bags, "COPIES", 1 if hot == 8 else 2_000)  # with 1, copies are joined in parts
    rows = corpus(seed)
    df = spark.createDataFrame([(k, x, "other") for k, x in rows], "id long, text string, bag string")  # a clashing extra column
    found = NearDuplicates([("a", df, "id", "text"), ("b", df.limit(0), "id", "text")])
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got))
    assert {(i, j) for tab, i, j in got} == alike(rows) and {tab for tab, _, _ in got} == {"a"}
    classes = {r["id"]: r for r in found.classes().collect()}
    links = Counter(x for i, j in alike(rows) for x in (i, j))
    for k, r in classes.items():
        assert r["links"] + r["copies"] - 1 == links[k]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string, split string, source string")
    assert NearDuplicates([("a", none, "id", "text")]).pairs().count() == 0
    assert NearDuplicates([("a", none, "id", "text")]).classes().count() == 0
    o = SplitOverlap([("a", none, "id", "text", "split", "source")])
    assert o.pairs().count() == 0 and o.report().count() == 0


@pytest.mark.parametrize("copies", [2_000, 1])
def test_overlaps_across_splits(spark, monkeypatch, copies):
    monkeypatch.setattr(bags, "COPIES", copies)
    rows = corpus(3)
    rnd = random.Random(9)
    split = {k: rnd.choice(["train", " Train", "test ", "VALIDATION", "unused", None]) for k, _ in rows}
    df = spark.createDataFrame([(k, x, split[k], " S1 ") for k, x in rows], "id long, text string, split string, source string")
    side = {k: (s or "").strip().lower() for k, s in split.items()}
    want = {(i, j) for i, j in alike(rows) if {side[i], side[j]} in ({"train", "test"}, {"train", "validation"})}
    o = SplitOverlap([("a", df, "id", "text", "split", "source")])
    assert {(r["id_a"], r["id_b"]) for r in o.pairs().collect()} == want
    for r in o.hits().collect():
        assert side[r["train_id"]] == "train" and side[r["eval_id"]] != "train" and 0.75 - 1e-9 <= r["likeness"] <= r["containment"] + 1e-9
    report = o.report().collect()
    assert {r["source"] for r in report} == {"s1"}
    assert sum(r["overlapping"] for r in report) == len({k for p in want for k in p if side[k] != "train"})


def on_disk(spark) -> int:
    """Bytes of shuffle files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


@pytest.mark.parametrize("most", [1, 20_000])
def test_pairs_are_met_in_passes_that_leave_the_disk(spark, monkeypatch, most):
    monkeypatch.setattr(bags, "PASS_BYTES", most)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "id long, text string")
    split = spark.createDataFrame([(k, x, ("train", "test")[k % 2]) for k, x in rows], "id long, text string, split string")
    seen, left = [], []
    meet, before = bags._meet, on_disk(spark)

    def spy(sent, *args):
        seen.append(sent.count())
        left.append(on_disk(spark) - before)
        return meet(sent, *args)

    monkeypatch.setattr(bags, "_meet", spy)
    got = NearDuplicates([("a", df, "id", "text"), ("b", df, "id", "text")])
    assert len(seen) >= bags.PASSES - 1 and max(seen) < sum(seen) / 2 and max(left) < 10_000
    assert {(r["tab"], r["id_a"], r["id_b"]) for r in got.pairs().collect()} == {(t, i, j) for t in "ab" for i, j in alike(rows)}
    o = SplitOverlap([("a", split, "id", "text", "split", None)])
    assert {(r["id_a"], r["id_b"]) for r in o.pairs().collect()} == {(i, j) for i, j in alike(rows) if (i + j) % 2}


def test_passes_hold_every_unit_once():
    units = {(tab, c): 10 ** (c % 4) * (tab + 1) for tab in range(3) for c in range(7)}
    whole = bags.passes(units)
    assert len(whole) == 1
    bags_most = bags.PASS_BYTES
    try:
        bags.PASS_BYTES = 1
        cut = bags.passes(units)
    finally:
        bags.PASS_BYTES = bags_most
    held = [(tab, c, p.part, p.parts) for p in cut for c, tabs in p.tabs.items() for tab in tabs]
    assert len(held) == len(set(held)) and {x[:2] for x in held} == set(units)
    assert max(sum(units[tab, c] for c, tabs in p.tabs.items() for tab in tabs) / p.parts for p in cut) <= sum(units.values()) / bags.PASSES


@pytest.mark.parametrize("words", [2, 5, 12])
@pytest.mark.parametrize("roles", [True, False])
def test_candidates_fit_in_their_whole_sketches(roles, words):
    rnd = np.random.default_rng(words)
    size = [1, 2, 9, bags.SMALL - 1, bags.SMALL, 150, 400]
    region = np.repeat(np.arange(len(size)), size)
    n = rnd.integers(20 * words, 60 * words, len(region))
    n[rnd.random(len(n)) < 0.02] = bags.UNKNOWN
    role = rnd.integers(1, 3, len(region))
    flips = [rnd.integers(0, 2**63, (words, len(region))) for _ in range(4)]  # of a quarter of the bits, in most texts of a sixteenth
    base = (flips[0] & flips[1] & np.where(rnd.random(len(region)) < 0.7, flips[2] & flips[3], -1)).astype(np.uint64)
    by = np.lexsort((n, role, region) if roles else (n, region))
    region, n, role, sketch = region[by], n[by], role[by], list(base[:, by])
    got = [(int(i), int(j)) for x, y in bags._candidates(region, sketch, n, role if roles else None, 0.75) for i, j in zip(x, y, strict=True)]
    want = set()
    for i, j in itertools.combinations(range(len(region)), 2):
        far = max(abs(int(n[i]) - int(n[j])), sum(int(s[i] ^ s[j]).bit_count() for s in sketch))
        if region[i] == region[j] and not (roles and role[i] == role[j]) and (far <= (n[i] + n[j]) / 7 + 1e-9 or n[i] == n[j] == bags.UNKNOWN):
            want.add((i, j))
    assert len(want) > 100 and len(got) == len(set(got))
    assert {(i, j) for i, j in got if (n[i] == bags.UNKNOWN) == (n[j] == bags.UNKNOWN)} == want  # the others may come or not
