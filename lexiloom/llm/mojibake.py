"""Problem 9: text decoded with the wrong character encoding.

Garbled passages are joined with their clean near-twins: sentences that are
the same once non-ASCII characters are stripped. The twins' runs of non-ASCII
characters are aligned place by place; each aligned pair votes for the codecs
that lead from one to the other. Transformations with enough votes are learned
and applied to all other records: where the bytes form UTF-8, at once; where
one single-byte encoding was taken for another, if the restored word is known
from other texts and the garbled one is rare, or if a clean twin shows it. Copies
of a text count once in all of this.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections.abc import Iterator
from functools import cache, cached_property

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialise

#: Single-byte encodings that texts are taken for, and what they may be in truth.
TAKEN_FOR = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "cp1250", "cp1253")
TRUTHS = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp850", "cp437")
#: Taken as known without twins: valid UTF-8 read as the most common encodings is no accident.
SURE = (("cp1252", "utf-8"), ("latin-1", "utf-8"))
#: Votes of aligned runs that a transformation needs, and its least ASCII letters in a sentence stripped of all else.
LEAST_VOTES, LEAST_LETTERS = 2, 12
#: Without twins, a transformation is learned from this many rare words of at least five letters that it turns into known ones.
LEAST_WORDS = 3
#: A garbled word must be this many times rarer than what it restores to; words of one or two letters more so.
RARER, RARER_SHORT = 3, 10
#: One garbled word is a case if it has four letters or is this many times rarer; else it takes two.
SURE_ALONE = 30

_RUN = re.compile(r"[^\x00-\x7f]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"(?:[A-Za-z'’]|[^\x00-\x7f\s])+")
#: Well-formed UTF-8 beyond ASCII: no surrogates, nothing above U+10FFFF.
_UTF8 = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_BROKEN = re.compile("[\x80-\x84\x86-\x9f�]")
_TALK = re.compile(r"code page|encoding|charset|character set|mojibake|decod|utf-?8", re.I)


class _Bytes(dict):
    """Characters to the bytes they come from in an encoding; \\0 for those that it lacks. Bytes without a character stand for themselves."""

    def __missing__(self, key: int) -> str:
        self[key] = "\0"
        return "\0"


@cache
def _table(encoding: str) -> _Bytes:
    table = _Bytes()
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table[ord(c)] = chr(b)
    return table


def _usual(text: str) -> bool:
    """Only characters that restored text may hold."""
    return all(
        0xA0 <= (c := ord(x)) <= 0x17F or 0x2C6 <= c <= 0x2DD or 0x300 <= c <= 0x36F or 0x390 <= c <= 0x45F or c in (0x192, 0x490, 0x491) or 0x1E00 <= c <= 0x1EFF or 0x200B <= c <= 0x2044 or 0x20A0 <= c <= 0x20BF or 0x2100 <= c <= 0x22FF or 0x2460 <= c <= 0x27BF or 0x3000 <= c <= 0x30FF or 0x4E00 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0xFE00 <= c <= 0xFE0F or 0xFF00 <= c <= 0xFFEF or 0x1F300 <= c <= 0x1FAFF
        for x in text
    )


def restore_run(run: str, taken: tuple[str, ...]) -> tuple[str, list[tuple[str, str]]]:
    """A run of non-ASCII characters with the UTF-8 in it decoded, and the (garbled, restored) parts; by the encoding that explains most of the run."""
    best: tuple[int, str, list[tuple[str, str]]] = (0, run, [])
    for encoding in taken:
        raw = run.translate(_table(encoding))
        parts, out, at = [], [], 0
        for m in _UTF8.finditer(raw.encode("latin-1")):
            good = m[0].decode("utf-8")
            if _usual(good) or (encoding in ("cp1252", "latin-1") and _usual(good.translate({c: None for c in range(0x80, 0xA0)}))):
                out += [run[at : m.start()], good]
                parts.append((run[m.start() : m.end()], good))
                at = m.end()
        told = sum(len(bad) for bad, _ in parts)
        if told > best[0]:
            best = told, "".join(out) + run[at:], parts
            if told == len(run):
                break
    return best[1], best[2]


def _words(text: str, explains: bool) -> list[str]:
    """Words with non-ASCII characters; a # follows those that stand right before a digit (currency signs)."""
    found = [m[0] + "#" * text[m.end() : m.end() + 1].isdigit() for m in _WORD.finditer(text) if not m[0].isascii()]
    # a text about encodings names single characters
    return [w for w in found if len(w) > 1] if explains or _TALK.search(text) else found


class Finder:
    """Finds and restores UTF-8 that was taken for the given encodings; runs are kept once computed."""

    def __init__(self, taken: tuple[str, ...]):
        self.taken = taken
        self.known: dict[str, tuple[str, list]] = {}

    def run(self, run: str) -> tuple[str, list]:
        found = self.known.get(run)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = restore_run(run, self.taken)
            if len(run) < 200:
                self.known[run] = found
        return found

    def hits(self, text: str) -> bool:
        """Whether the text holds garbled characters other than to speak of them."""
        return self.look(text)[0]

    def look(self, text: str) -> tuple[bool, bool]:
        """The same, and whether the text explains garbled characters up to there: alone, beside what they stand for in the same sentence or, letters, in the next one."""
        starts: list[int] | None = None  # of the text's sentences
        explains = False
        for m in _RUN.finditer(text):
            broken = _BROKEN.search(m[0])
            _, parts = self.run(m[0])
            if not broken and not parts:
                continue
            a, b = m.span()
            if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()):
                if starts is None:
                    starts = [0, *(x.end() for x in _SENTENCE.finditer(text)), len(text) + 1]
                k, after = bisect(starts, a), bisect_left(starts, b)
                whole = self.run(m[0])[0]
                upto = starts[min(after + whole.isalpha(), len(starts) - 1)]
                rest = text[starts[k - 1] : a] + "\0" + text[b:upto]
                if parts and re.search(rf"(?<!\w){re.escape(whole)}(?!\w)", rest):
                    explains = True
                    continue
                if broken and not parts and _TALK.search(text[starts[k - 1] : starts[after]]):
                    explains = True
                    continue
            return True, explains
        return False, explains

    def restore(self, text: str) -> str:
        while True:  # text can be garbled several times over; each round makes it shorter
            better = _RUN.sub(lambda m: self.run(m[0])[0], text)
            if len(better) >= len(text):
                return better
            text = better


def fix(word: str, taken: str, truth: str) -> str | None:
    """The word's characters as bytes of ``taken``, read as ``truth``; None if that cannot be."""
    raw = "".join(c if ord(c) < 128 else c.translate(_table(taken)) for c in word)
    if "\0" in raw:
        return None
    try:
        good = raw.encode("latin-1").decode(truth)
    except UnicodeDecodeError:
        return None
    return good if good != word and _usual("".join(c for c in good if ord(c) > 127)) else None


def _said(sentence: str) -> int:
    return xxhash.xxh64_intdigest(sentence) - 2**63


def _by_twins(text: str, ways: dict[int, str]) -> str:
    """The text with the runs restored of those sentences that a twin shows to be garbled."""
    out, at = [], 0
    for end, stop in [*((m.start(), m.end()) for m in _SENTENCE.finditer(text)), (len(text), len(text))]:
        s = text[at:end]
        way = ways.get(_said(s))
        if way:
            s = _RUN.sub(lambda m, way=way: fix(m[0], *way.split(">")) or m[0], s)
        out += [s, text[end:stop]]
        at = stop
    return "".join(out)


class Mojibake:
    """Finds records with garbled characters and restores them where possible.

    Null keys take no part; null, empty and pure ASCII texts are no cases;
    repeated rows count once; other columns are not read. An empty table
    gives no rows. A text that shows garbled characters only to explain them
    (alone, beside what they stand for in the same sentence or, letters, in the
    next one) is no case.
    """

    def __init__(self, records: DataFrame, key: str, text: str):
        rows = records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
        self.rows = rows.where(F.col("text").rlike(r"[^\x00-\x7F]"))
        self.learned = self._learn()
        self.taken = tuple(dict.fromkeys([a for a, _ in SURE] + [a for a, b in self.learned if b == "utf-8"]))
        self.single = [(a, b) for a, b in self.learned if b != "utf-8"]

    def _learn(self) -> list[tuple[str, str]]:
        """The transformations that twins vote for, most votes first; at most one for each pair of encodings."""

        def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, runs, said = [], [], []
                for text in b.column(0).to_pylist():
                    for s in _SENTENCE.split(text):
                        found = _RUN.findall(s)
                        if found:
                            bare = _RUN.sub("\0", s)
                            if sum(map(str.isalpha, bare)) >= LEAST_LETTERS:
                                keys.append(xxhash.xxh64_intdigest(bare) - 2**63)
                                runs.append(found)
                                said.append(_said(s))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(runs, pa.list_(pa.string())), pa.array(said, pa.int64())], names=["bare", "runs", "said"])

        seen = self.rows.select("text").mapInArrow(sentences, "bare long, runs array<string>, said long").dropDuplicates(["bare", "runs"])
        seen = materialise(seen, "sentences")
        twins = seen.join(seen.groupBy("bare").count().where("count > 1").select("bare"), "bare", "left_semi")
        x, y = twins.alias("x"), twins.alias("y")
        pairs = x.join(y, (F.col("x.bare") == F.col("y.bare")) & (F.col("x.runs") < F.col("y.runs"))).select(F.col("x.said").alias("sa"), F.col("y.said").alias("sb"), F.explode(F.arrays_zip(F.col("x.runs").alias("a"), F.col("y.runs").alias("b"))).alias("z")).select("sa", "sb", "z.*").where("a <> b")
        self.aligned = pairs
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
        often = seen.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("times"))
        pairs = pairs.join(often.select(F.col("run").alias("a"), F.col("times").alias("ta")), "a").join(often.select(F.col("run").alias("b"), F.col("times").alias("tb")), "b")
        self.pairs = pairs = materialise(pairs, "pairs")

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[str, int] = {}
            for b in batches:
                for r in b.to_pylist():
                    for bad, good, tb, tg in ((r["a"], r["b"], r["ta"], r["tb"]), (r["b"], r["a"], r["tb"], r["ta"])):
                        # the clean run is the more frequent one, unless UTF-8 tells them apart
                        ways = [f"{a}>{t}" for a in TAKEN_FOR for t in TRUTHS if a != t and (t == "utf-8" or tg > tb) and fix(bad, a, t) == good]
                        if ways:
                            out[" ".join(ways)] = out.get(" ".join(ways), 0) + r["n"]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["ways", "votes"])

        votes = pairs.mapInArrow(vote, "ways string, votes long").groupBy("ways").agg(F.sum("votes").alias("votes"))
        left = {tuple(r["ways"].split()): r["votes"] for r in votes.collect()}  # sets of encodings that explain the same pairs: few, whatever the input
        learned = []
        while left:  # the transformation that explains most; then the one that explains most of the rest
            total: dict[str, int] = {}
            for ways, n in left.items():
                for w in ways:
                    total[w] = total.get(w, 0) + n
            best = min(total, key=lambda w: (-total[w], [*TAKEN_FOR].index(w.split(">")[0]), w))
            if total[best] < LEAST_VOTES:
                break
            learned.append(tuple(best.split(">")))
            left = {ways: n for ways, n in left.items() if best not in ways}
        return learned

    def _shown(self) -> DataFrame:
        """(said, way): the sentences that a clean twin shows to be garbled, by the learned transformation of single bytes that explains an aligned run."""
        single = self.single

        def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for r in b.to_pylist():
                    for first, bad, good, tb, tg in ((True, r["a"], r["b"], r["ta"], r["tb"]), (False, r["b"], r["a"], r["tb"], r["ta"])):
                        way = next((f"{a}>{t}" for a, t in single if tg > tb and fix(bad, a, t) == good), None)
                        if way:
                            out.append((r["a"], r["b"], first, way))
                cols = [[x[i] for x in out] for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["a", "b", "first", "way"])

        told = self.pairs.mapInArrow(explain, "a string, b string, first boolean, way string")
        return self.aligned.join(told, ["a", "b"]).select(F.when(F.col("first"), F.col("sa")).otherwise(F.col("sb")).alias("said"), "way").groupBy("said").agg(F.min("way").alias("way"))

    def _read(self) -> DataFrame:
        """(id, copy, sure, words, said): a hash of the text, whether it is garbled for certain, its other words with non-ASCII characters, and its sentences with such."""
        taken = self.taken

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(taken)
            for b in batches:
                copy, sure, words, said = [], [], [], []
                for text in b.column(1).to_pylist():
                    copy.append(xxhash.xxh64_intdigest(" ".join(text.split())) - 2**63)
                    hit, explains = finder.look(text)
                    sure.append(hit)
                    words.append(sorted(set(_words(text, explains))))
                    said.append(sorted({_said(x) for x in _SENTENCE.split(text) if not x.isascii() and not _TALK.search(x)}))
                cols = [b.column(0), pa.array(copy, pa.int64()), pa.array(sure, pa.bool_()), pa.array(words, pa.list_(pa.string())), pa.array(said, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "copy", "sure", "words", "said"])

        return self.rows.select("id", "text").mapInArrow(run, "id long, copy long, sure boolean, words array<string>, said array<long>")

    @cached_property
    def _judged(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(id, sure) of all records read; (id, word, good, alone) of the words garbled by a single-byte encoding; (id, said, way) of the sentences that a twin shows."""
        read = materialise(self._read(), "read")
        words = read.select("id", F.explode("words").alias("word")).distinct()
        counts = read.select("copy", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("df"))  # copies count once
        pairs = [(a, t) for a in TAKEN_FOR for t in TRUTHS if t not in ("utf-8", a)]

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bad, good, df, way = [], [], [], []
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for a, t in pairs:
                        g = fix(w, a, t)
                        if g is not None:
                            bad.append(w)
                            good.append(g)
                            df.append(n)
                            way.append(f"{a}>{t}")
                yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string()), pa.array(good, pa.string()), pa.array(df, pa.int64()), pa.array(way, pa.string())], names=["word", "good", "df", "way"])

        made = counts.mapInArrow(candidates, "word string, good string, df long, way string")
        known = counts.select(F.col("word").alias("good"), F.col("df").alias("dg"))
        short = F.length("word") <= 2
        plain = made.join(known, "good").where((F.col("dg") >= F.when(short, 5).otherwise(2)) & (F.col("dg") >= F.when(short, RARER_SHORT).otherwise(RARER) * F.col("df")))
        plain = materialise(plain, "words")
        told = plain.where((F.length("word") >= 5) & (F.col("dg") >= 3)).groupBy("way").agg(F.countDistinct("word").alias("n")).where(F.col("n") >= LEAST_WORDS).select("way").collect()  # at most a row per pair of encodings
        ways = {f"{a}>{t}" for a, t in self.single} | {r["way"] for r in told}
        best = plain.where(F.col("way").isin(sorted(ways) or [""])).groupBy("word").agg(F.max_by(F.struct("good", (F.col("dg") >= SURE_ALONE * F.greatest("df", F.lit(1))).alias("alone")), F.struct("dg", "good")).alias("x")).select("word", "x.*")
        shown = read.select("id", F.explode("said").alias("said")).join(self._shown(), "said").select("id", "said", "way").distinct()
        return read, words.join(best, "word").select("id", "word", "good", (F.col("alone") | (F.length("word") >= 4)).alias("alone")), shown

    def found(self) -> DataFrame:
        """(id) of the records that hold garbled characters."""
        return self._found(*self._judged)

    def _found(self, read: DataFrame, bad: DataFrame, shown: DataFrame) -> DataFrame:
        by_words = bad.groupBy("id").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("n >= 2 or alone").select("id")
        return read.where("sure").select("id").unionAll(by_words).unionAll(shown.select("id")).distinct()

    def restored(self) -> DataFrame:
        """(id, text, whole): the text restored as far as the learned transformations go, and whether no broken character is left in it."""
        taken = self.taken
        read, bad, shown = self._judged
        words = bad.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("word", "good")))).alias("words"))  # the words of one text
        ways = shown.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("said", "way")))).alias("ways"))  # the sentences of one text
        both = self.rows.dropDuplicates(["id"]).join(self._found(read, bad, shown), "id").join(words, "id", "left").join(ways, "id", "left").select("id", "text", "words", "ways")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(taken)
            for b in batches:
                texts, whole = [], []
                for text, words_, ways_ in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    text = finder.restore(_by_twins(text, dict(ways_)) if ways_ else text)
                    swap = dict(words_ or ())
                    text = _WORD.sub(lambda m, swap=swap, t=text: swap.get(m[0] + "#" * t[m.end() : m.end() + 1].isdigit(), m[0]).rstrip("#"), text)
                    texts.append(text)
                    whole.append(not _BROKEN.search(text))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(whole)], names=["id", "text", "whole"])

        return both.mapInArrow(run, "id long, text string, whole boolean")
