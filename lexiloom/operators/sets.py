"""Similarity of token sets: exact Jaccard join, MinHash candidates, containment of texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import materialise


#: Cells of the token counts, tokens from which on prefixes are joined in passes, and how many passes at most; members of a token from which on they are compared in strips, and pairs of a strip.
COUNT_BITS, PASS_TOKENS, PASSES, SMALL, STRIP = 20, 2_000_000, 4, 32, 2**15


def _prefixes(counts, threshold: float, part: int, parts: int):
    """(t, h, n, pos, a, b, c, d): the tokens of the prefix of each set that belong to a pass, with their places and 256 parities of the set's tokens. The same set once per task."""

    def run(batches):
        often, seen = counts.value, set()
        for b in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            fresh = [i for i, k in enumerate(b.column(0).to_pylist()) if not (k in seen or seen.add(k))]
            if not fresh:
                continue
            b = b.take(pa.array(fresh))
            h, x = b.column(0).to_numpy(), b.column(1)
            n = x.value_lengths().to_numpy().astype(np.int64)
            x = _spread(x.flatten().to_numpy().view(np.uint64))
            doc = np.repeat(np.arange(len(n)), n)
            odd = np.bincount(doc * 256 + (x >> np.uint64(56)).astype(np.int64), minlength=len(n) * 256).reshape(-1, 256) & 1
            sketch = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            order = np.lexsort((x, often[(x & np.uint64(2**COUNT_BITS - 1)).astype(np.int64)], doc))
            pos = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            own = (pos < (n - np.ceil(n * threshold - 1e-9) + 1)[doc]) & ((x[order] >> np.uint64(32)) % np.uint64(parts) == part)
            doc, x, pos = doc[own], x[order][own], pos[own]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(h[doc]), pa.array(n[doc].astype(np.int32)), pa.array(pos.astype(np.int32)), *[pa.array(np.ascontiguousarray(sketch[doc, i])) for i in range(4)]], names=["t", "h", "n", "pos", "a", "b", "c", "d"])

    return run


def _compared(threshold: float):
    """(ha, hb): sets that share a token of their prefixes and that sizes, places and parities allow to be alike."""

    def fits(n, pos, sketch, x, y):
        both = n[x] + n[y]
        least = np.ceil(threshold / (1 + threshold) * both - 1e-9)
        ok = (n[x] >= threshold * n[y] - 1e-9) & (n[y] >= threshold * n[x] - 1e-9)
        ok &= 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1 + np.minimum(pos[x], pos[y]) >= least
        ok &= sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in sketch) <= both - 2 * least
        return ok

    def run(batches):
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        all_ = pa.Table.from_batches(read)
        t, h, n, pos, *sketch = (all_.column(i).to_numpy() for i in range(8))
        order = np.lexsort((h, n, t))
        t, h, n, pos = t[order], h[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        sketch = [s[order].view(np.uint64) for s in sketch]
        cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
        size = np.diff(cut)
        found = []

        def take(x, y):
            ok = fits(n, pos, sketch, x, y) & (h[x] != h[y])
            if ok.any():
                x, y = h[x[ok]], h[y[ok]]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))

        end = np.repeat(cut[1:], size)
        i = np.flatnonzero(np.repeat(size < SMALL, size))
        d = 1
        while len(i := i[i + d < end[i]]):
            take(i, i + d)
            d += 1
        for g in np.flatnonzero(size >= SMALL):
            lo, hi = int(cut[g]), int(cut[g + 1])
            while lo < hi:
                to = min(hi, lo + max(1, STRIP // (hi - lo)))
                last = lo + int(np.searchsorted(n[lo:hi], n[to - 1] / threshold + 1e-9, side="right"))
                near = np.bitwise_count(sketch[0][lo:to, None] ^ sketch[0][None, lo:last]) <= int((n[to - 1] + n[last - 1]) * (1 - threshold) / (1 + threshold) + 1e-9)
                x, y = np.nonzero(near)
                later = y > x
                take(x[later] + lo, y[later] + lo)
                lo = to
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["ha", "hb"])

    return run


def jaccard_join(df: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """(a, b, jaccard): all pairs of at least ``threshold``, a < b; empty sets and nulls take no part.

    Exact: sets are compared as classes of equal sets; each is indexed under
    its rarest tokens (prefix filter; frequencies by cells of a fixed number,
    which only order the tokens), in passes by token whose rows leave the disk
    one after the other. Candidates must fit in size, place and parities before
    they are sent, then whole sets are intersected.
    """
    spark = df.sparkSession
    sets = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("w")).where(F.size("w") > 0).withColumn("h", F.xxhash64("w"))
    own = materialise(sets.select("id", "h", F.transform("w", lambda t: F.xxhash64(t)).alias("x")), "sets")
    hashes, ids = own.select("h", "x"), own.select("h", "id")

    def count(batches):
        cells = np.zeros(2**COUNT_BITS, np.int64)
        for b in batches:
            x = _spread(b.column(1).flatten().to_numpy().view(np.uint64))
            cells += np.bincount((x & np.uint64(2**COUNT_BITS - 1)).astype(np.int64), minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    found = hashes.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(2**COUNT_BITS, np.int64)
    often[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(often)
    passes = max(1, min(PASSES, int(often.sum()) // PASS_TOKENS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(often.sum()) // passes // PASS_TOKENS)
    met = []
    for i in range(passes):
        rows = hashes.mapInArrow(_prefixes(counts, threshold, i, passes), "t long, h long, n int, pos int, a long, b long, c long, d long")
        met.append(materialise(rows.repartition(parts, "t").mapInArrow(_compared(threshold), "ha long, hb long").distinct(), "met"))
    pairs = materialise(reduce(DataFrame.unionAll, met).distinct(), "pairs")

    ends = pairs.select(F.explode(F.array("ha", "hb")).alias("h"))
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * pairs.count() * CELLS_A_TEXT).bit_length()))
    wanted = spark.sparkContext.broadcast(_bitmap(ends, "h", bits))

    def once(batches):
        seen: set[int] = set()
        for b in batches:
            h = b.column(0).to_numpy()
            at = np.flatnonzero(_marked(wanted.value, h.view(np.uint64), bits))
            fresh = [i for i, k in zip(at.tolist(), h[at].tolist(), strict=True) if not (k in seen or seen.add(k))]
            if fresh:
                yield b.take(pa.array(fresh))

    one = sets.select("h", "w").mapInArrow(once, sets.select("h", "w").schema).dropDuplicates(["h"])
    full = pairs.join(one.select(F.col("h").alias("ha"), F.col("w").alias("wa")), "ha").join(one.select(F.col("h").alias("hb"), F.col("w").alias("wb")), "hb")
    n = F.size(F.array_intersect("wa", "wb"))
    near = full.withColumn("jaccard", n / (F.size("wa") + F.size("wb") - n)).where(F.col("jaccard") >= threshold - 1e-12).select("ha", "hb", "jaccard")
    same = ids.groupBy("h").count().where("count > 1").select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(1.0).alias("jaccard"))
    out = near.unionAll(same).join(ids.select(F.col("h").alias("ha"), F.col("id").alias("i")), "ha").join(ids.select(F.col("h").alias("hb"), F.col("id").alias("j")), "hb")
    return out.where((F.col("ha") != F.col("hb")) | (F.col("i") < F.col("j"))).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard")


def _bands(permutations: int, bands: int):
    """(h, id, band, v): the bands of the MinHash signature of each set of token hashes, a batch at a time."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, permutations, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, permutations, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x")
            flat = x.flatten().to_numpy().view(np.uint64)
            start = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])[:-1]  # no set is empty
            out = np.zeros((bands, batch.num_rows), np.uint64)
            for i in range(permutations):
                v = flat * a[i] + b[i]
                v ^= v >> np.uint64(29)
                v *= np.uint64(0x9E3779B97F4A7C15)
                low = np.minimum.reduceat(v, start)
                k = i * bands // permutations
                out[k] = (out[k] ^ low) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i + 1)
            for k in range(bands):
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("id"), pa.array(np.full(batch.num_rows, k, np.int32)), pa.array(out[k].view(np.int64))], names=["h", "id", "band", "v"])

    return run


def minhash_pairs(df: DataFrame, key: str, tokens: str, threshold: float, permutations: int = 128, bands: int = 16) -> DataFrame:
    """(a, b): pairs that share a band of their MinHash signature and are at least ``threshold`` alike, a < b. Equal sets are one class: each further row of it is paired with its first."""
    sets = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("w")).where(F.size("w") > 0).withColumn("h", F.xxhash64("w"))
    one = sets.groupBy("h").agg(F.min("id").cast("long").alias("id"), F.any_value("w").alias("w"))
    hashes = one.select("h", "id", F.transform("w", lambda t: F.xxhash64(t)).alias("x"))
    sig = hashes.mapInArrow(_bands(permutations, bands), "h long, id long, band int, v long")
    sig = sig.join(one.select("h", F.size("w").alias("n")), "h")
    x, y = sig.alias("x"), sig.alias("y")
    fits = (F.col("x.id") < F.col("y.id")) & (F.col("x.n") >= threshold * F.col("y.n")) & (F.col("y.n") >= threshold * F.col("x.n"))
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.v") == F.col("y.v")) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    w = one.select("id", "w")
    full = pairs.join(w.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(w.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    n = F.size(F.array_intersect("wa", "wb"))
    near = full.where(n >= threshold * (F.size("wa") + F.size("wb") - n)).select("a", "b")
    copies = sets.join(one.select("h", F.col("id").alias("a")), "h").where("a < id").select("a", F.col("id").alias("b"))
    return near.unionAll(copies)


_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Cells of the bitmap for every inner text, and the least and the most bits of the number of cells.
CELLS_A_TEXT, LEAST_BITS, MOST_BITS = 64, 16, 28


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Windows:
    """Hashes of all windows of a run of bytes, by sums of their prefixes."""

    def __init__(self, data: np.ndarray):
        # byte i counts times BASE**-i, so that a window is a difference of sums times BASE**start
        back = _powers(pow(int(_BASE), -1, 2**64), len(data))
        self.power = _powers(int(_BASE), len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * back, dtype=np.uint64)])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """The hashes of the windows of ``size`` bytes from ``start`` on."""
        h = (self.sums[start + size] - self.sums[start]) * self.power[start]
        return _spread(h + np.asarray(size).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries without nulls, and where each begins and the last ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _parts(batches, rows: int = 1000, most: int = 4_000_000):
    """Batches cut so that each has few rows and, where one row allows it, few bytes of the last column."""
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            hi = min(b.num_rows, lo + rows)
            while hi > lo + 1 and b.column(b.num_columns - 1).slice(lo, hi - lo).nbytes > most:
                hi = lo + (hi - lo) // 2
            yield b.slice(lo, hi - lo)
            lo = hi


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64(2**bits - 1)).astype(np.int64)


def _index(batches):
    """(start, whole, size): of each inner text the hash of its longest start of a power of two bytes, that of the text, and its bytes."""
    for b in _parts(batches):
        data, at = _bytes(b.column(0))
        size = np.diff(at)
        w = _Windows(data)
        start = 2 ** np.floor(np.log2(size)).astype(np.int64)
        start = np.where(start > size, start // 2, start)  # the logarithm is rounded
        yield pa.RecordBatch.from_arrays([pa.array(w.of(at[:-1], start).view(np.int64)), pa.array(w.of(at[:-1], size).view(np.int64)), pa.array(size)], names=["start", "whole", "size"])


def _bitmap(h: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits cells with two marks for each hash: a filter of fixed size that lets all of them through."""
    low = F.col(column).bitwiseAND(2**bits - 1)
    cell = h.select(F.explode(F.array(F.shiftrightunsigned(column, 64 - bits), low)).alias("c"))
    words = cell.groupBy(F.shiftright("c", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 32 as int))")).alias("on")).toArrow()
    out = np.zeros(2 ** (bits - 5), "<u4")
    out[words.column("w").to_numpy()] = words.column("on").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _marked(on: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    a, b = _cells(h, bits)
    return ((on[a >> 3] >> (a & 7).astype(np.uint8)) & (on[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def containing(outer: DataFrame, outer_key: str, outer_text: str, inner: DataFrame, inner_key: str, inner_text: str) -> DataFrame:
    """(outer key, inner key) where the outer text contains the inner one as it stands.

    Works on the bytes of the texts. Every inner text is known by the hash of
    its longest start of a power of two bytes and by that of the whole; both
    are marked in bitmaps. Outer texts are scanned in place for such starts;
    where one is found, windows of the lengths that inner texts have are looked
    up, and only what passes is sent, to meet the inner texts as it reads.
    """
    spark = outer.sparkSession
    inner = inner.select(F.col(inner_key).alias("ik"), F.col(inner_text).cast("string").alias("it")).where("ik is not null and it is not null and it <> ''").distinct()
    outer = outer.select(F.col(outer_key).alias("ok"), F.col(outer_text).cast("string").cast("binary").alias("ot")).where("ok is not null and ot is not null")
    index = materialise(inner.select(F.col("it").cast("binary")).mapInArrow(_index, "start long, whole long, size long").distinct(), "index")
    texts = index.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (texts * CELLS_A_TEXT).bit_length()))
    sizes = np.sort(index.select("size").distinct().toArrow().column("size").to_numpy())
    known = spark.sparkContext.broadcast((sizes, _bitmap(index, "start", bits), _bitmap(index, "whole", bits)))
    key = outer.schema["ok"].dataType

    def scan(batches):
        sizes, starts, wholes = known.value
        for b in _parts(batches):
            data, at = _bytes(b.column(1))
            w = _Windows(data)
            end = np.repeat(at[1:], np.diff(at))
            rows, begin, size = [], [], []
            place = np.arange(len(data))
            for n in 2 ** np.unique([int(x).bit_length() - 1 for x in sizes]):
                own = sizes[(sizes >= n) & (sizes < 2 * n)]
                here = place[place + n <= end]
                here = here[_marked(starts, w.of(here, n), bits)]
                for s in own:
                    fits = here[here + s <= end[here]]
                    fits = fits[_marked(wholes, w.of(fits, s), bits)]
                    rows.append(np.searchsorted(at, fits, side="right") - 1)
                    begin.append(fits)
                    size.append(np.full(len(fits), s))
            if not rows or not sum(map(len, rows)):
                continue
            row, begin_, size_ = np.concatenate(rows), np.concatenate(begin), np.concatenate(size)
            raw = data.tobytes()
            once = {(r, raw[i : i + s]) for r, i, s in zip(row.tolist(), begin_.tolist(), size_.tolist(), strict=True)}
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in once], pa.int64())), pa.array([x for _, x in once], pa.binary())], names=["ok", "part"])

    hits = outer.mapInArrow(scan, T.StructType([T.StructField("ok", key), T.StructField("part", T.BinaryType())]))
    return hits.join(inner.withColumn("part", F.col("it").cast("binary")), "part").select("ok", "ik").distinct()
