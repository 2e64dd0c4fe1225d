"""Word-bag likeness joins that find every pair.

The likeness of two texts is the weighted Jaccard index of their word bags.
A bag is turned into a set by numbering repeats: the j-th "the" is the token
(the, j). For bags of a and b tokens that are at least ``t`` alike, the tokens
in only one of them number D <= (1-t)/(1+t) * (a+b).

Candidate regions. The vocabulary is cut by hash into m sub-spaces; the
distances in the sub-spaces (sizes of symmetric differences) add up to the
distance of the whole bags. So at least m - D sub-spaces hold the very same
sub-bag in both texts. Every distinct sub-bag is the pivot of a region of its
sub-space; a text is a member of the m regions whose pivots lie at distance 0.
As a pair shares at least m - D of m regions, it shares one of the D + 1
smallest regions of either text, whatever total order of regions is taken
(prefix argument); ordering by frequency leaves out the crowded ones. m grows
with the length, so texts are joined in classes of length; those long enough
for a partner in the next class visit that too.

Within a region a parity sketch of each bag gives a lower bound of the
distance (a token in only one bag flips one bit); pairs under the bound are
compared token by token. No step loses a pair.

Texts of different classes of length or of different tables never share a
region, so the rows sent are met in passes, each over some classes of some
tables; a class with too many rows is cut by the hash of its regions. The rows
of a pass leave the disk before the next one begins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import collected, materialise

WORDS = re.compile(r"[^\W_]+")
#: Cells of the frequency sketch: at least and at most 2**these, in between one for every TOKENS_A_CELL tokens.
SKETCH_BITS, MOST_SKETCH_BITS, TOKENS_A_CELL = 20, 24, 64
MARK_BITS = 25
#: Members of a region from which on it is cut into blocks, and copies of a bag from which on they are joined in parts.
HOT, COPIES = 50_000, 2_000
#: Rows of a region from which on it is compared in strips, pairs of a strip, and the length from which on it is not known exactly.
SMALL, STRIP, UNKNOWN = 24, 2**15, 2**20 - 1
RATIO = 1.75
#: Passes that the rows are met in at least once they exceed as many bytes in each.
PASSES, PASS_BYTES = 6, 64_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of words, computed once per worker; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def bags(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the texts of at least ``least`` words, their numbers of tokens, and all their tokens in a row (32 bits each, ascending within a text)."""
    at, n, words = [], [], []
    for i, text in enumerate(texts):
        if text is None:
            continue
        found = WORDS.findall(text.lower())
        if len(found) >= least:
            at.append(i)
            n.append(len(found))
            words.extend(found)
    n_ = np.array(n, dtype=np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(n_), dtype=np.uint64), n_)
    order = np.argsort(h)
    h = h[order[np.argsort(doc[order].astype(np.uint16 if len(n_) < 2**16 else np.uint64), kind="stable")]]
    if len(h):
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(fresh)
        nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
        h = mix(h + nth.astype(np.uint64) * _M2)
    token = np.sort(doc << np.uint64(32) | h >> np.uint64(32)).astype(np.uint32)
    return np.array(at, dtype=np.int64), n_, token


def bag_table(df: DataFrame, key: str, text: str, tab: int, least: int, role: str | None = None) -> DataFrame:
    """(tab, id, role, bag, n, words) of each row that has a key and a text of at least ``least`` words.

    bag is a 64-bit hash of table and bag; equal for texts of the same words.
    Rows delivered again give the same row again. role: an int column, 1 or 2.
    """
    salt = np.uint64(tab * 0x5851F42D4C957F2D % 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            ids, roles = b.column(0), b.column(1)
            at, n, token = bags(b.column(2).to_pylist(), least)
            start = np.concatenate([[0], np.cumsum(n)])
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(token.astype(np.uint64) + np.uint64(1)), start[:-1]) if len(n) else np.zeros(0, np.uint64)
                bag = mix(sums + salt + n.astype(np.uint64))
            take = pa.array(at)
            words = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(token.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), tab, np.int32)), ids.take(take), roles.take(take), pa.array(bag.view(np.int64)), pa.array(n.astype(np.int32)), words],
                names=["tab", "id", "role", "bag", "n", "words"],
            )

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), (F.lit(0) if role is None else F.col(role)).cast("int"), F.col(text))
    return rows.mapInArrow(run, "tab int, id long, role int, bag long, n int, words array<int>")


def classes(least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the classes of length up to ``n`` and one beyond."""
    low = [least]
    while low[-1] <= 2 * n:
        low.append(max(low[-1] + 1, math.ceil(low[-1] * RATIO)))
    low_ = np.array(low, dtype=np.int64)
    return low_[:-1], low_[1:]


def _wide(high: int) -> int:
    """Bits of the sketches of a class of texts of less than ``high`` tokens."""
    return 104 if high <= 120 else 64 * math.ceil(high * 0.8 / 64)


class Pass:
    """A part of the join: classes of length of tables, as (tab, class), and of their regions those with ``part`` as the remainder of their hash by ``parts``."""

    def __init__(self, units: list[tuple[int, int]], part: int = 0, parts: int = 1):
        self.part, self.parts = part, parts
        self.tabs: dict[int, list[int]] = {}
        for tab, c in units:
            self.tabs.setdefault(c, []).append(tab)

    def texts(self, tab: np.ndarray, c: int) -> np.ndarray:
        return np.isin(tab, self.tabs.get(c, []))

    def regions(self, key: np.ndarray) -> np.ndarray:
        return mix(key) % np.uint64(self.parts) == self.part

    def of(self, table: DataFrame, least: int, t: float) -> DataFrame:
        """The rows of a ``bag_table`` whose texts may be at home in the pass or visit it."""
        ask = F.lit(False)
        for c, tabs in self.tabs.items():
            low, high = classes_to(least, c)
            ask |= F.col("tab").isin(tabs) & F.col("n").between(int(t * low), high - 1)
        return table.where(ask)


def passes(units: dict[tuple[int, int], int]) -> list[Pass]:
    """Passes over units of so many bytes: of at most PASS_BYTES, or else a PASSES-th of all."""
    most = max(PASS_BYTES, sum(units.values()) / PASSES)
    out, open_, room = [], [], most
    for unit, size in sorted(units.items(), key=lambda x: (-x[1], x[0])):
        if size > most:
            parts = math.ceil(size / most)
            out += [Pass([unit], i, parts) for i in range(parts)]
            continue
        if size > room:
            out.append(Pass(open_))
            open_, room = [], most
        open_.append(unit)
        room -= size
    return [*out, Pass(open_)] if open_ else out


def classes_to(least: int, c: int) -> tuple[int, int]:
    """The bounds of class ``c``."""
    low, high = classes(least, math.ceil((least + c + 1) * RATIO ** (c + 1)))
    return int(low[c]), int(high[c])


def regions(n: np.ndarray, token: np.ndarray, tab: np.ndarray, least: int, t: float, now: Pass | None = None) -> Iterator[tuple]:
    """For each class of length (of the pass ``now``): its number, which texts, whether as visitors, regions (texts x m), how many of them matter, sketch."""
    if not len(n):
        return
    salt = _salt(tab)
    start = np.concatenate([[0], np.cumsum(n)])
    low, high = classes(least, int(n.max()))
    home = np.searchsorted(low, n, side="right") - 1
    spread = (1 - t) / (1 + t)
    eps = 1e-9
    for c in range(len(low)):
        visit = (home == c - 1) & (n >= t * low[c] - eps)
        docs = np.flatnonzero((home == c) | visit if now is None else ((home == c) | visit) & now.texts(tab, c))
        if not len(docs):
            continue
        most = int(spread * 2 * (high[c] - 1) + eps)
        m = most + max(2, most * 3 // 8)
        size = n[docs]
        where = np.repeat(np.arange(len(docs)), size)
        pick = np.repeat(start[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        x = mix(token[pick].astype(np.uint64) + _M1)
        cell = where * m + ((x >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        total = np.zeros(len(docs) * m, np.uint64)
        np.add.at(total, cell, x)
        region = mix(total.reshape(len(docs), m) + np.arange(1, m + 1, dtype=np.uint64)[None, :] * _M2 + np.uint64((c + 1) * int(_M1) % 2**64) + salt[docs][:, None])
        partner = np.minimum(np.floor(size / t + eps).astype(np.int64), high[c] - 1)
        matter = np.minimum((spread * (size + partner) + eps).astype(np.int64) + 1, m)
        wide = _wide(int(high[c]))
        bit = (x & np.uint64(0xFFFFF)).astype(np.int64) * wide >> 20
        odd = np.bincount(where * wide + bit, minlength=len(docs) * wide).reshape(len(docs), wide) & 1
        yield c, docs, visit[docs], region, matter, odd.astype(np.uint8)


def _frequency(table: DataFrame, least: int, t: float, bits: int) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """Counts of all regions in 2**bits cells (a bound on each region's size), and the bytes of the rows that each table and class of length sends.

    Each task sends its cells in slices, in as few bytes a count as hold them,
    those that are sparse without their zeros; they are summed by slice on the
    executors. There are twice as many tasks as cores, not one for so many
    texts, so what is sent has a bound that does not grow with the texts.
    """
    slices = 256
    step = 2**bits // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(2**bits, np.int64)
        units: dict[int, int] = {}
        for (_, tab), n, token in _read(batches):
            for c, docs, _, region, matter, odd in regions(n, token, tab, least, t):
                cells += np.bincount(_sketched(region.ravel(), bits), minlength=len(cells))
                for x, rows in enumerate(np.bincount(tab[docs], weights=matter)):
                    units[x << 10 | c] = units.get(x << 10 | c, 0) + int(rows) * (24 + odd.shape[1] // 8)
        part, where, what = [], [], []
        for i, own in enumerate(cells.reshape(slices, step)):
            at = np.flatnonzero(own)
            if len(at):
                part.append(i)
                size = np.min_scalar_type(own.max())
                sparse = len(at) * (2 + size.itemsize) < step * size.itemsize
                where.append(at.astype(np.uint16).tobytes() if sparse else b"")
                what.append((own[at] if sparse else own).astype(size).tobytes())
        for unit, size in units.items():
            part.append(slices + unit)
            where.append(b"")
            what.append(np.array([size], np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(where, pa.binary()), pa.array(what, pa.binary())], names=["part", "cells", "counts"])

    def add(key: tuple, pdf):
        total = np.zeros(step if key[0] < slices else 1, np.int64)
        for x, y in zip(pdf["cells"], pdf["counts"], strict=True):
            if len(x):
                total[np.frombuffer(x, np.uint16)] += np.frombuffer(y, f"u{len(y) * 2 // len(x)}").astype(np.int64)
            else:
                total += np.frombuffer(y, f"u{len(y) // len(total)}").astype(np.int64)
        return pd.DataFrame({"part": [key[0]], "counts": [(np.minimum(total, 2**31 - 1).astype(np.int32) if key[0] < slices else total).tobytes()]})

    few = table.coalesce(2 * table.sparkSession.sparkContext.defaultParallelism)
    found = collected(few.select("tab", "bag", "n", "words").mapInArrow(count, "part int, cells binary, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary"))
    cells, units = np.zeros(2**bits, np.int32), {}
    for r in found:
        if r["part"] < slices:
            cells[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(bytes(r["counts"]), np.int32)
        elif size := int(np.frombuffer(bytes(r["counts"]), np.int64)[0]):
            units[divmod(r["part"] - slices, 1 << 10)] = size
    return cells, units


def _sketched(region: np.ndarray, bits: int) -> np.ndarray:
    return (region >> np.uint64(64 - bits)).astype(np.int64)


def _hot(table: DataFrame, cells, least: int, t: float) -> DataFrame | None:
    """(region, blocks) of the regions with more than HOT members, counted exactly; None if the sketch rules them out."""
    if not (cells.value > HOT).any():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = cells.value
        for (_, tab), n, token in _read(batches):
            for _, _, _, region, matter, _ in regions(n, token, tab, least, t):
                _, key, bound = _chosen(region, matter, count)
                key, times = np.unique(key[bound > HOT], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times)], names=["region", "n"])

    found = table.select("tab", "bag", "n", "words").mapInArrow(run, "region long, n long").groupBy("region").agg(F.sum("n").alias("n"))
    return materialise(found.where(F.col("n") > HOT).select("region", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")), "hot")


def _salt(tab: np.ndarray) -> np.ndarray:
    return mix(tab.astype(np.uint64) + np.uint64(77))


def _read(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Texts of each batch, the same bag once per task: ((bag, tab, *extra), n, token)."""
    seen: set[int] = set()
    for b in batches:
        bag = b.column("bag").to_numpy()
        roles = [b.column(x).to_numpy() for x in extra]
        fresh = []
        for i, k in enumerate(zip(bag.tolist(), *[r.tolist() for r in roles], strict=True)):
            if k not in seen:
                seen.add(k)
                fresh.append(i)
        if not fresh:
            continue
        b = b.take(pa.array(fresh))
        words = b.column("words")
        yield (b.column("bag").to_numpy(), b.column("tab").to_numpy(), *[b.column(x).to_numpy() for x in extra]), b.column("n").to_numpy().astype(np.int64), words.flatten().to_numpy().view(np.uint32)


def _chosen(region: np.ndarray, matter: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the regions that matter: the least crowded, by one total order. (text, region, bound of its size)."""
    often = count[_sketched(region, len(count).bit_length() - 1)]
    rank = (np.minimum(often, 2**24 - 1).astype(np.uint64) << np.uint64(40)) | (region >> np.uint64(24))
    order = np.argsort(rank, axis=1)
    r, c = np.nonzero(np.arange(region.shape[1])[None, :] < matter[:, None])
    col = order[r, c]
    return r, region[r, col], often[r, col]


def _marks(table: DataFrame, cells, least: int, t: float, now: Pass) -> np.ndarray:
    """A bitmap of 2**MARK_BITS cells with a mark for every region of the evaluation texts (role 2) in the pass; its size is the same for any input."""
    slices = 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(2**MARK_BITS, bool)
        for (_, tab), n, token in _read(batches):
            for _, _, _, region, matter, _ in regions(n, token, tab, least, t, now):
                key = _chosen(region, matter, cells.value)[1]
                on[(key[now.regions(key)] >> np.uint64(64 - MARK_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([np.packbits(x).tobytes() for x in on.reshape(slices, -1)], pa.binary())], names=["part", "cells"])

    return _joined(table.where("role = 2").select("tab", "bag", "n", "words").mapInArrow(mark, "part int, cells binary"), slices)


def _joined(bitmaps: DataFrame, slices: int) -> np.ndarray:
    """The union of the bitmaps of all tasks, packed."""

    def join(key: tuple, pdf):
        on = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["cells"]])
        pdf = pdf.head(1).copy()
        pdf["cells"] = [on.tobytes()]
        return pdf

    found = {r["part"]: np.frombuffer(bytes(r["cells"]), np.uint8) for r in collected(bitmaps.groupBy("part").applyInPandas(join, "part int, cells binary"))}
    return np.concatenate([found[k] for k in range(slices)]) if found else np.zeros(0, np.uint8)


def _emit(table: DataFrame, cells, least: int, t: float, marks, now: Pass) -> DataFrame:
    """One row for each text and each of its regions that matter in the pass. With ``marks``, training texts (role 1) only meet regions that evaluation texts have marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = cells.value
        on = None if marks is None else np.unpackbits(marks.value).astype(bool)
        for (bag, tab, role), n, token in _read(batches, ("role",)):
            for _, docs, visit, region, matter, odd in regions(n, token, tab, least, t, now):
                r, key, _ = _chosen(region, matter, count)
                if now.parts > 1:
                    own = now.regions(key)
                    r, key = r[own], key[own]
                if on is not None:
                    hit = (role[docs[r]] != 1) | (on[(key >> np.uint64(64 - MARK_BITS)).astype(np.int64)] if len(on) else False)
                    r, key = r[hit], key[hit]
                packed = np.packbits(odd, axis=1, bitorder="little")
                flags = (np.minimum(n[docs], UNKNOWN) << 3 | np.where(visit, 4, 0) | (role[docs] & 3)).astype(np.uint64)
                small = odd.shape[1] == 104
                head = np.ascontiguousarray(packed[:, :8]).view(np.uint64)[:, 0]
                if small:
                    tail = np.zeros((len(docs), 8), np.uint8)
                    tail[:, :5] = packed[:, 8:13]
                    second = tail.view(np.uint64)[:, 0] << np.uint64(24) | flags
                else:
                    second = flags
                rest = pa.nulls(len(r), pa.binary()) if small else pa.array([x.tobytes() for x in packed[:, 8:]], pa.binary()).take(pa.array(r))
                for lo in range(0, len(r), 200_000):
                    s = slice(lo, lo + 200_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[s].view(np.int64)), pa.array(bag[docs][r[s]]), pa.array(head[r[s]].view(np.int64)), pa.array(second[r[s]].view(np.int64)), rest.slice(lo, 200_000)],
                        names=["region", "bag", "head", "tail", "rest"],
                    )

    return table.select("tab", "bag", "n", "words", "role").mapInArrow(run, "region long, bag long, head long, tail long, rest binary")


def _in_blocks(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Crowded regions are cut into blocks by bag; every two blocks meet in a region of their own. ``hot`` has a row for every HOT rows sent at most."""
    own = F.pmod(F.xxhash64("bag"), F.col("blocks"))
    rows = rows.join(F.broadcast(hot), "region", "left").withColumn("own", own).withColumn("with", F.explode(F.coalesce(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.lit(0)))))
    region = F.when(F.col("blocks").isNull(), F.col("region")).otherwise(F.xxhash64("region", F.least("own", "with"), F.greatest("own", "with")))
    return rows.select(region.alias("region"), "bag", "head", "tail", "rest")


def _fit(sketch: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray, spread: float, far: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (x, y) those whose lengths and sketches allow the likeness; ``far``: their distances in words before these. Pairs that are too far leave before the next word."""
    most = np.where((n[x] >= UNKNOWN) | (n[y] >= UNKNOWN), np.inf, spread * (n[x] + n[y]) + 1e-9)
    far = np.zeros(len(x), np.int64) + far
    ok = np.maximum(np.abs(n[x] - n[y]), far) <= most
    for s in sketch:
        x, y, far, most = x[ok], y[ok], far[ok], most[ok]
        if not len(x):
            return x, y
        far += np.bitwise_count(s[x] ^ s[y])
        ok = far <= most
    return x[ok], y[ok]


def _candidates(region: np.ndarray, sketch: list[np.ndarray], n: np.ndarray, role: np.ndarray | None, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one region that fit in length and in their sketches.

    Rows are sorted by region and length (with roles: region, role, length).
    Small regions are compared all at once, neighbour by neighbour; in larger
    ones, each strip of rows is compared with those rows that are not too long.
    One word of a sketch says nothing about texts of a distance of 64 or more,
    so a strip adds words up until few pairs are left.
    """
    spread = (1 - t) / (1 + t)
    if not len(region):
        return
    cut = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
    size = np.diff(cut)
    small = np.repeat(size < SMALL, size)
    i = np.flatnonzero(small)
    end = np.repeat(cut[1:], size)
    d = 0
    while True:
        d += 1
        i = i[i + d < end[i]]
        if not len(i):
            break
        j = i + d
        if role is not None:
            cross = role[i] != role[j]
            x, y = i[cross], j[cross]
        else:
            x, y = i, j
        yield _fit(sketch, n, x, y, spread)
    xs, ys, held = [], [], 0
    room = np.empty(max(STRIP, int(size.max())), np.uint64)
    for g in np.flatnonzero(size >= SMALL):
        lo, hi = int(cut[g]), int(cut[g + 1])
        mid = lo + int(np.searchsorted(role[lo:hi], 2)) if role is not None else lo
        i0 = lo
        last = mid if role is not None else hi
        base = mid if role is not None else lo  # where the partners begin
        lengths = n[base:hi]
        while i0 < last:
            # partners of the strip: not shorter than t times its shortest, not longer than its longest over t
            a = i0 if role is None else base + int(np.searchsorted(lengths, t * n[i0] - 1e-9))
            i1 = min(last, i0 + max(1, STRIP // max(1, hi - a)))
            b = base + int(np.searchsorted(lengths, n[i1 - 1] / t + 1e-9, side="right")) if n[i1 - 1] < UNKNOWN and n[hi - 1] < UNKNOWN else hi
            if b > a:
                most = int(spread * (n[i1 - 1] + n[b - 1]) + 1e-9) if n[b - 1] < UNKNOWN and n[i1 - 1] < UNKNOWN else 64 * len(sketch)
                far = np.zeros((i1 - i0, b - a), np.uint16 if len(sketch) < 1024 else np.uint32)
                odd = room[: far.size].reshape(far.shape)
                for words, s in enumerate(sketch, 1):
                    np.bitwise_xor(s[i0:i1, None], s[None, a:b], out=odd)
                    far += np.bitwise_count(odd)
                    if words < len(sketch) and 24 * words > most and np.count_nonzero(far <= most) * 16 < far.size:
                        break
                at = np.flatnonzero(far <= most)
                r, c = np.divmod(at, b - a)
                r, c, far = r + i0, c + a, far.ravel()[at]
                if role is None:
                    later = c > r
                    r, c, far = r[later], c[later], far[later]
                if len(r):
                    r, c = _fit(sketch[words:], n, r, c, spread, far)
                    xs.append(r)
                    ys.append(c)
                    held += len(r)
            i0 = i1
            if held > 1_000_000:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)


def _meet(rows: DataFrame, parts: int, t: float, roles: bool) -> DataFrame:
    """Pairs of bags that share a region and whose sketches allow the likeness."""
    spread = (1 - t) / (1 + t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        all_ = pa.Table.from_batches(read)
        rest = all_.column("rest").combine_chunks()
        width = pa.compute.fill_null(pa.compute.binary_length(rest), 0).to_numpy(zero_copy_only=False)
        cols = [all_.column(c).to_numpy() for c in ("region", "bag", "head", "tail")]
        a_all, b_all = [], []
        for w in np.unique(width):
            one = np.flatnonzero(width == w)
            region, bag, head, tail = (c[one] for c in cols)
            sketch = [head.view(np.uint64)]
            tail = tail.view(np.uint64)
            if w:
                found = rest.take(pa.array(one)).cast(pa.binary(int(w)))
                wide = np.concatenate([np.frombuffer(x.buffers()[1], np.uint8, len(x) * w, x.offset * w) for x in (found.chunks if isinstance(found, pa.ChunkedArray) else [found])]).reshape(len(one), w)
                pad = np.zeros((len(one), -(-int(w) // 8) * 8), np.uint8)
                pad[:, :w] = wide
                sketch += list(np.ascontiguousarray(pad.view(np.uint64).T))
            else:
                sketch.append(tail >> np.uint64(24))
            flags = (tail & np.uint64(0xFFFFFF)).astype(np.int64)
            order = np.argsort(mix(mix(bag.view(np.uint64)) ^ region.view(np.uint64)) ^ flags.astype(np.uint64))
            x, y = order[:-1], order[1:]
            same = np.zeros(len(order), bool)  # copies, delivered by several tasks
            same[1:] = (region[x] == region[y]) & (bag[x] == bag[y]) & (flags[x] == flags[y])
            order = order[~same]
            order = order[np.argsort(region[order])]
            near = np.zeros(len(order), np.uint64)  # the regions, numbered
            near[1:] = np.cumsum(region[order[1:]] != region[order[:-1]])
            by = flags[order].astype(np.uint64)
            if roles:  # within a region: by role, then by length
                by = (by & np.uint64(3)) << np.uint64(22) | by >> np.uint64(2)
            by = np.argsort(near << np.uint64(24) | by)
            order, near = order[by], near[by]
            bag, flags = bag[order], flags[order]
            n, role, visitor = flags >> 3, flags & 3, (flags & 4) > 0
            sketch = [s[order] for s in sketch]
            for x, y in _candidates(near, sketch, n, role if roles else None, t):
                ok = ~(visitor[x] & visitor[y]) & (bag[x] != bag[y])
                x, y = x[ok], y[ok]
                if len(x):
                    a_all.append(np.minimum(bag[x], bag[y]))
                    b_all.append(np.maximum(bag[x], bag[y]))
        if a_all:
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], names=["a", "b"])

    return rows.repartition(parts, "region").mapInArrow(run, "a long, b long").distinct()


def _wanted(bags_: DataFrame) -> np.ndarray:
    """A bitmap of 2**22 cells with a mark for every bag of ``bags_``: a filter of fixed size that lets all of them through."""
    slices, cells = 16, 2**22

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(cells, bool)
        for b in batches:
            on[_cell(b.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([np.packbits(x).tobytes() for x in on.reshape(slices, -1)], pa.binary())], names=["part", "cells"])

    on = _joined(bags_.mapInArrow(mark, "part int, cells binary"), slices)
    return on if len(on) else np.zeros(cells // 8, np.uint8)


def _cell(bag: np.ndarray) -> np.ndarray:
    return (mix(bag.view(np.uint64)) >> np.uint64(42)).astype(np.int64)


def alike_bags(table: DataFrame, least: int, t: float, roles: bool = False) -> DataFrame:
    """(a, b, shared, n_a, n_b): all pairs of different bags, a < b, that are at least ``t`` alike.

    ``table`` is a materialised ``bag_table``. With ``roles``, only bags that
    occur in different roles are compared; whether two records of the pair
    differ in role is left to the caller. Exact: see the module's head.
    """
    spark = table.sparkSession
    tokens = table.agg(F.sum("n")).first()[0] or 0
    cells, units = _frequency(table, least, t, min(MOST_SKETCH_BITS, max(SKETCH_BITS, (tokens // TOKENS_A_CELL).bit_length())))
    shared = spark.sparkContext.broadcast(cells)
    hot = _hot(table, shared, least, t)
    met = []
    for now in passes(units):
        own = now.of(table, least, t)
        marks = spark.sparkContext.broadcast(_marks(own, shared, least, t, now)) if roles else None
        rows = _emit(own, shared, least, t, marks, now)
        size = sum(units[tab, c] for c, tabs in now.tabs.items() for tab in tabs) // now.parts
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 40_000_000)
        met.append(materialise(_meet(rows if hot is None else _in_blocks(rows, hot), parts, t, roles), "met"))
        if marks is not None:
            marks.unpersist()
    if not met:
        met.append(spark.createDataFrame([], "a long, b long"))
    pairs = met[0] if len(met) == 1 else materialise(reduce(DataFrame.unionAll, met).distinct(), "pairs")

    wanted = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("bag"))
    bitmap = spark.sparkContext.broadcast(_wanted(wanted.select("bag")))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        on = np.unpackbits(bitmap.value)
        for b in batches:
            bag = b.column(0).to_numpy()
            at = np.flatnonzero(on[_cell(bag)])
            fresh = [i for i, k in zip(at.tolist(), bag[at].tolist(), strict=True) if not (k in seen or seen.add(k))]
            if fresh:
                yield b.take(pa.array(fresh))

    words = table.select("bag", "words").mapInArrow(once, "bag long, words array<int>")
    both = (
        words.join(wanted, "bag")
        .groupBy("a", "b")
        .agg(F.any_value(F.when(F.col("bag") == F.col("a"), F.col("words")), True).alias("wa"), F.any_value(F.when(F.col("bag") == F.col("b"), F.col("words")), True).alias("wb"))
    )
    return (
        both.select("a", "b", F.size(F.array_intersect("wa", "wb")).cast("long").alias("shared"), F.size("wa").cast("long").alias("n_a"), F.size("wb").cast("long").alias("n_b"))
        .where(F.col("shared") >= F.lit(t) * (F.col("n_a") + F.col("n_b") - F.col("shared")) - F.lit(1e-9))
    )


class Members:
    """The records (tab, id, role) behind each bag; bags of many copies in parts, so that no task holds all of them."""

    def __init__(self, table: DataFrame):
        one = table.select("tab", "bag", "id", "role").distinct()
        self.crowded = materialise(one.groupBy("bag").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts")).where("parts > 1"), "crowded")
        self.rows = one.join(self.crowded, "bag", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def of(self, links: DataFrame, side: str, role: int | None = None) -> DataFrame:
        """``links`` with tab and the id (``side``_id) of every member of the bag in column ``side``."""
        mine = (self.rows if role is None else self.rows.where(F.col("role") == role)).select(F.col("bag").alias(side), F.col("part").alias("_part"), "tab", F.col("id").alias(f"{side}_id"))
        many = self.crowded.select(F.col("bag").alias(side), "parts")
        links = links.join(many, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return links.join(mine, [side, "_part"]).drop("_part")

    def copies(self, roles: tuple[int, int] | None = None) -> DataFrame:
        """(tab, a_id, b_id) of members of the same bag: a_id < b_id, or one of either role."""
        with_ = self.rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x = with_ if roles is None else with_.where(F.col("role") == roles[0])
        y = with_ if roles is None else with_.where(F.col("role") == roles[1])
        x = x.select("bag", "tab", F.col("id").alias("a_id"), F.col("part").alias("p"), F.col("other").alias("q"))
        y = y.select("bag", F.col("id").alias("b_id"), F.col("other").alias("p"), F.col("part").alias("q"))
        return x.join(y, ["bag", "p", "q"]).where("a_id < b_id" if roles is None else "a_id <> b_id").select("tab", "a_id", "b_id")
