"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Pair occurrence index: the distinct pre-tokens of a batch lie in one row of
symbols; every pair that the vocabulary can merge is mapped to all its
positions. Ranks are taken in ascending order, all positions of a rank are
merged from left to right, and the lists of the neighbouring pairs are updated.
Work per merge does not depend on the length of a pre-token, so long runs
without spaces cost no more than text.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte-level BPE cuts texts into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 400_000
CACHED_BYTES = 64


class PairIndexEncoder:
    """Encodes texts by the ranks of a vocabulary (bytes -> id, the id being the rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.byte_id = [ranks[bytes([i])] for i in range(256)]
        self.merged: dict[int, int] = {}
        self.known: dict[str, array] = {}

    def _merge(self, a: int, b: int) -> int:
        """The id of the pair's merge, -1 if there is none."""
        pair = a << 20 | b
        found = self.merged.get(pair)
        if found is None:
            found = self.merged[pair] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return found

    def pieces(self, words: list[str]) -> list[array]:
        """The ids of each pre-token, by one pair occurrence index over all of them."""
        symbol: list[int] = []
        right: list[int] = []
        left: list[int] = []
        starts = []
        ids = self.byte_id
        for word in words:
            start = len(symbol)
            starts.append(start)
            symbol.extend([ids[x] for x in word.encode("utf-8", "surrogatepass")])
            end = len(symbol)
            right.extend(range(start + 1, end + 1))
            left.extend(range(start - 1, end - 1))
            right[-1] = -1
            left[start] = -1
        merge = self._merge
        where: dict[int, list[int]] = defaultdict(list)
        for i, j in enumerate(right):
            if j >= 0 and (r := merge(symbol[i], symbol[j])) >= 0:
                where[r].append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            todo = where.pop(rank, None)
            if todo is None:
                continue
            todo.sort()
            for k, i in enumerate(todo):
                j = right[i]
                if symbol[i] < 0 or j < 0 or merge(symbol[i], symbol[j]) != rank:
                    continue
                symbol[i] = rank
                symbol[j] = -1
                n = right[i] = right[j]
                lower = False
                if n >= 0:
                    left[n] = i
                    if (r := merge(rank, symbol[n])) >= 0:
                        if r not in where:
                            heapq.heappush(active, r)
                            lower |= r < rank
                        where[r].append(i)
                p = left[i]
                if p >= 0 and (r := merge(symbol[p], rank)) >= 0:
                    if r not in where:
                        heapq.heappush(active, r)
                        lower |= r < rank
                    where[r].append(p)
                if lower:  # a lower rank has come up: it goes first
                    where[rank].extend(todo[k + 1 :])
                    heapq.heappush(active, rank)
                    break
        out = []
        for s in starts:
            one = array("i")
            while s >= 0:
                one.append(symbol[s])
                s = right[s]
            out.append(one)
        return out

    def encode_batch(self, texts: Iterable[str | None]) -> list[array]:
        """The ids of each text; null and empty texts give no ids."""
        cut = [self.split.findall(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHED:
            known.clear()
        fresh = list({w for words in cut for w in words if w not in known})
        now = dict(zip(fresh, self.pieces(fresh), strict=True))
        known.update((w, x) for w, x in now.items() if len(w) <= CACHED_BYTES)
        out = []
        for words in cut:
            one = array("i")
            for w in words:
                one += known[w] if w in known else now[w]
            out.append(one)
        return out


@cache
def load(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> PairIndexEncoder:
    """The encoder of a vocabulary file of ranks; once per process."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return PairIndexEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))})


def encode(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", empty: tuple[int, ...] = ()) -> DataFrame:
    """(``key``, ids) of each row of ``df``.

    Empty and null texts get the ids ``empty`` (none by default); the names of
    special tokens are ordinary text; a null key is kept; repeated rows come
    out as often as they go in; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(folder, name)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [x or array("i", empty) for x in encoder.encode_batch(part.column(1).to_pylist())]
                start = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in found if x] or [np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(start), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
