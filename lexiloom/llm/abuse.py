"""Problem 5: abusive, hateful or sexual content.

Noisy channel: words with leetspeak, masks, look-alike letters, spacing or
repetition span a lattice of the characters they may stand for; the Viterbi
path under a character language model restores them. The restored text is
scored sentence by sentence by a linear model over word n-grams; a text's
score is that of its worst sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.tables import in_order
from lexiloom.session import materialise

REVIEW = 0.35
#: Log-odds that a feature must have to count, how its reach grows with them, and the weight of the prior.
LEAST_ODDS, POWER, L2 = 1.0, 1.5, 0.4

#: Words of one kind; they share a feature, so that what is learned of one holds for all.
KINDS = {
    "insult": "idiot moron imbecile cretin halfwit dimwit dumbass asshole arsehole bastard bitch pig coward loser clown leech parasite vermin trash scum scumbag degenerate retard fool jerk twat prick whore slut pest rat cockroach maggot animal filth worm swine cunt wanker lowlife garbage douchebag subhuman savage",
    "slur": "stupid pathetic disgusting filthy worthless spineless brainless braindead vile rotten ugly greasy shitty miserable useless fucking dumb crappy lousy gutless",
    "sexual": "tit boob pussy cock dick nude naked porn anal blowjob threesome hardcore horny undress uncensored cum tits orgasm handjob gangbang masturbate milf boner slutty topless sexting",
    "violence": "kill hang strangle shoot stab bury murder hurt beat choke drown rape lynch burn slaughter butcher bludgeon behead hanged stabbed strangled shot buried killed beaten smash",
}
_KIND = {w: k for k, words in KINDS.items() for x in words.split() for w in (x, x + "s", x + "es")}

#: What digits and signs stand for, and letters of other scripts that look like Latin ones.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "v": "u", "¡": "i"}
ALIKE = str.maketrans("аеорсухіѕјԁкмтвнԛԝһӏбɡαεοικνρτυχ", "aeopcyxisjdkmtbhqwhl6gaeoiknptux")
ANY = "*_#%?•"
_MASKS = re.compile(r"[*_#%?•]{8,}")
_HIDDEN = re.compile("[​-‏⁠﻿­︎️]")
_OTHER = re.compile(r"[Ͱ-ԯɐ-ʯ]")
#: What needs decoding: signs or digits among letters, letters three times over, letters set apart by signs.
_NOISY = re.compile(r"[a-z].*[^a-z'’\-.,;:!?)\]}\"”/&\s].*[a-z]|(?:^|[^a-z])[0-9@$!*€|+]+[a-z].*[a-z]|([a-z])\1\1|[a-z][.\-_][a-z][.\-_][a-z]|[a-z][!|?][a-z]|v[bcdfghjklmnpqrstvwxyz]|[a-z][*_#@$]+$")
_SPACED = re.compile(r"(?<!\S)[^\s\d](?:[\s._\-*]+[^\s\d]){3,}(?![^\s.,!?;:])")
_TOKEN = re.compile(r"[#@][a-z_]\w*|[a-z]+(?:'[a-z]+)?|[0-9](?:[0-9.,]*[0-9])?|[.!?;>\n]|[^\x00-\x7f]")
WINDOW, STRIDE = 10, 3


class CharacterModel:
    """A trigram model over the letters of words, by interpolation."""

    def __init__(self, words: Counter):
        tri: dict[str, Counter] = defaultdict(Counter)
        bi: dict[str, Counter] = defaultdict(Counter)
        uni: Counter = Counter()
        for w, n in words.items():
            weight = 1 + math.log(n)
            s = "^^" + w + "$"
            for i in range(2, len(s)):
                tri[s[i - 2 : i]][s[i]] += weight
                bi[s[i - 1]][s[i]] += weight
                uni[s[i]] += weight
        self.words = frozenset(words)
        self.longest = max(map(len, words), default=0)
        self.tri = {k: (c, sum(c.values())) for k, c in tri.items()}
        self.bi = {k: (c, sum(c.values())) for k, c in bi.items()}
        self.uni, self.total = uni, sum(uni.values())
        self.kept: dict[str, float] = {}

    def log(self, two: str, c: str) -> float:
        found = self.kept.get(two + c)
        if found is None:
            p = 0.05 * (self.uni[c] + 0.1) / (self.total + 3)
            b = self.bi.get(two[1])
            if b:
                p += 0.15 * b[0][c] / b[1]
            t = self.tri.get(two)
            if t:
                p += 0.8 * t[0][c] / t[1]
            found = self.kept[two + c] = math.log(p + 1e-9)
        return found

    def decode(self, noisy: str) -> str:
        """The likeliest words behind a noisy string: the best path through the lattice of what each character stands for; linear in its length.

        The state is the last two letters, so no path is given up before a
        better one with the same state is known. Of a run of masks no more
        count than the longest known word has letters.
        """
        noisy = _MASKS.sub(lambda m: m[0][: self.longest + 1], noisy)
        spaced = " " in noisy
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # the path so far: (path before, letters)
        before = ""
        for i, c in enumerate(noisy):
            run = i >= 2 and noisy[i - 1] == c == noisy[i - 2] or (i + 1 < len(noisy) and i >= 1 and noisy[i - 1] == c == noisy[i + 1])
            options: list[tuple[str, float]] = []
            if c.isascii() and c.isalpha():
                options.append((c, 0.0))
                if run:
                    options.append(("", -0.3))
                if c == "v":
                    options.append(("u", -2.0))
            else:
                options += [(x, -0.3) for x in STANDS_FOR.get(c, "")]
                if c in ANY:
                    options += [(x, -2.0) for x in "abcdefghijklmnopqrstuvwxyz"]
                if c in " .-_~/·|\t\n" or not options:
                    options.append(("", -0.1))
                if c in "*.-_!?+":
                    options.append(("", -1.0))
            after: dict[str, tuple[float, tuple | None]] = {}
            for two, (score, out) in states.items():
                for x, cost in options:
                    if x:
                        ways = [(two[1] + x, score + cost + self.log(two, x), (out, x))]
                        if spaced and out:
                            ways.append(("^" + x, score + cost + self.log(two, "$") + self.log("^^", x), (out, " " + x)))
                    else:
                        ways = [(two, score + cost, out)]
                    for key, s, o in ways:
                        if key not in after or after[key][0] < s:
                            after[key] = (s, o)
            states = after
            before = c
        if not before:
            return ""
        score = {two: s + self.log(two, "$") for two, (s, _) in states.items()}
        best = max(score.values())
        return max(_letters(states[two][1]) for two, s in score.items() if s == best)


def _letters(path: tuple | None) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


class Restorer:
    """Restores obfuscated words; what does not become known words stays as it is."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.longest = model.longest

    def word(self, raw: str) -> str:
        """A string without blanks, in lower case."""
        core = raw.strip(".,!?;:\"'()[]{}")
        known = self.model.words
        if not _NOISY.search(core or raw) or core in known or re.fullmatch(r"[@#][a-z]\w*(?:'s)?|[$£€]?[\d.,]+\S{0,2}", core) and not self._decoded(core):
            return raw
        at = raw.find(core)
        for piece, head, tail in ((core, raw[:at], raw[at + len(core) :]), (raw, "", "")):
            found = self._decoded(piece)
            if found:
                return head + found + tail
        return raw

    def _decoded(self, piece: str) -> str:
        if len(piece) > 200 and " " not in piece and sum(c.isascii() and c.isalpha() and c != d and c != e for d, c, e in zip(" " + piece, piece, piece[1:] + " ")) > self.longest:
            return ""  # letters that are not repeated stay: more of them than any known word has
        words = self.model.decode(piece)
        return words if words and len(words) > 1 and all(w in self.model.words for w in words.split()) else ""

    def spaced(self, m: re.Match) -> str:
        piece = " ".join(m[0].split())
        whole = self._decoded(piece)
        if whole:
            return whole
        # each word counts for itself: letters of no known word stay apart as they stood
        return " ".join(w for word in self.model.decode(piece).split() for w in self._split(word))

    def _split(self, word: str) -> list[str]:
        """The known words that a string of letters consists of, long ones first; letters of none of them one by one."""
        known = self.model.words
        if word in known:
            return [word]
        best: list[tuple[int, int]] = [(0, 0)]  # squared lengths of the known words so far, and where the last one begins
        for end in range(1, len(word) + 1):
            ways = [(best[start][0] + (end - start) ** 2, start) for start in range(max(0, end - self.longest), end) if word[start:end] in known]
            best.append(max([*ways, (best[end - 1][0], end - 1)]))
        out, end = [], len(word)
        while end:
            out.append(word[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def clean(self, text: str) -> str:
        """In lower case, without hidden characters and look-alikes of other scripts; letters set apart by blanks joined to words."""
        text = text.lower()
        if not text.isascii():
            text = _HIDDEN.sub("", text).replace("’", "'")
            if _OTHER.search(text) and 2 * len(re.findall("[a-z]", text)) > 0.6 * len(text):
                text = text.translate(ALIKE)
        return _SPACED.sub(self.spaced, text)

    def __call__(self, text: str) -> str:
        return " ".join(map(self.word, self.clean(text).split(" ")))


class AbuseModel:
    """A logistic model of passages, fitted on labels of whole texts: of a labelled text only its worst passage counts as abusive.

    Features are words, pairs and triples of words of the labelled rows; words
    of one kind (``KINDS``) and words unknown to these rows share an id in
    pairs and triples, and what holds no known word is no feature. How far a
    feature may tell follows from its log-odds: how often abusive passages
    hold it against how often all sentences of the texts to be judged do
    (``fit``). A passage is a sentence, or a window of it.
    """

    def __init__(self, rows: list[tuple[str | None, bool]]):
        words: Counter = Counter()
        for text, _ in rows:
            if text and text.isascii():
                words.update(w for w in re.findall(r"(?<![^\s\"'(])[a-z]+(?=[\s.,;:!?\"')]|$)", text.lower()) if (len(w) > 1 or w in "ai") and not re.search(r"(.)\1\1", w))
        words.update(dict.fromkeys(_KIND, 3))
        self.restorer = Restorer(CharacterModel(words))
        seen = Counter(t for text, _ in rows for t in set(_TOKEN.findall(self.restorer(text or ""))) if t[0].isalpha())
        self.vocabulary = {w: i + 4 for i, w in enumerate(sorted({w for w, n in seen.items() if n >= 2} | set(_KIND)))}  # 0 boundary, 1 unknown, 2 number, 3 spare
        size = len(self.vocabulary) + 4 + len(KINDS)
        self.kind_of = np.arange(size)
        for w, k in _KIND.items():
            self.kind_of[self.vocabulary[w]] = len(self.vocabulary) + 4 + [*KINDS].index(k)
        self.size = size
        self.kept: dict[str, tuple[int, ...]] = {}
        ids = [self.ids([text]) for text, _ in rows]
        parts = [self.passages(x, np.array([len(x)])) for x in ids]
        keys = [np.stack(self._keys(x)) for x in ids]
        count = Counter(np.concatenate([k.ravel() for k in keys]).tolist() if keys else [])
        count.pop(-1, None)
        self.features = np.array(sorted(f for f, n in count.items() if n >= 2 and self._telling(f)), np.int64)
        row, col, owner = [], [], []
        for i, ((start, stop, _), three) in enumerate(zip(parts, keys, strict=True)):
            for a, b in zip(start, stop, strict=True):
                at, hit = self._at(self._inside(three, a, b))
                row.append(np.full(int(hit.sum()), len(owner)))
                col.append(at[hit])
                owner.append(i)
        none = np.zeros(0, np.int64)
        self.row, self.col, self.owner = (np.concatenate(row) if row else none, np.concatenate(col) if col else none, np.array(owner, np.int64))
        self.label = np.array([bad for _, bad in rows], bool)
        sound, sentences = np.zeros(len(self.features), np.int64), 0
        for x, (_, bad) in zip(ids, rows, strict=True):
            if not bad:
                c, k = self.counts(x)
                sound, sentences = sound + c, sentences + k
        self.sound = sound, sentences
        self.fit(np.zeros(len(self.features), np.int64), 0)

    def fit(self, counts: np.ndarray, sentences: int, rounds: int = 4) -> None:
        """Fits the weights, given how many of so many sentences of the corpus hold each feature."""
        n = len(self.owner)
        y = self.label[self.owner].astype(float) if n else np.zeros(0)
        self.weights, self.bias = np.zeros(len(self.features)), 0.0
        everywhere = np.log((counts + self.sound[0] + 0.5) / (sentences + self.sound[1] + 1))
        dense = (np.bincount(self.row, minlength=n) + 1) ** -0.5  # all that is known of a passage
        pairs = np.unique(self.row * max(1, len(self.features)) + self.col)  # a feature counts once a passage
        for _ in range(rounds if n else 0):
            bad = np.bincount(pairs % len(self.features), y[pairs // len(self.features)], minlength=len(self.features))
            odds = np.log((bad + 0.5) / (y.sum() + 1)) - everywhere
            tells = np.abs(odds) >= LEAST_ODDS
            live = tells[self.col]
            row, col = self.row[live], self.col[live]
            scale = (np.bincount(row, minlength=n) + 1) ** -0.5
            reach = np.where(tells, np.abs(odds) ** POWER / 3, 0.0)
            self._descend(row, col, scale, reach, y)
            z = self.bias + dense * np.bincount(row, self.weights[col], minlength=n)
            top = np.full(len(self.label), -np.inf)
            np.maximum.at(top, self.owner, z)
            # the worst passage of an abusive text, and what overlaps it nearly as badly, is abusive
            y = (self.label[self.owner] & (z >= top[self.owner] - 0.15 * np.abs(top[self.owner] - self.bias))).astype(float)

    def _descend(self, row: np.ndarray, col: np.ndarray, scale: np.ndarray, reach: np.ndarray, y: np.ndarray, steps: int = 120) -> None:
        """Logistic regression by Adam; a weight's prior deviation is its reach."""
        w, b = np.zeros(len(self.features)), 0.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        weight = np.where(y > 0, max(1.0, (len(y) - y.sum()) / max(1.0, y.sum()) / 4), 1.0)
        for t in range(1, steps + 1):
            z = b + scale * np.bincount(row, (w * reach)[col], minlength=len(y))
            g = weight * (1 / (1 + np.exp(-z)) - y)
            gw = np.bincount(col, (g * scale)[row], minlength=len(w)) * reach + L2 * w
            gb = g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            r = 0.2 / (1 + 10 * t / steps)
            w -= r * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= r * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        self.weights, self.bias = w * reach, b

    def _ids(self, raw: str) -> tuple[int, ...]:
        """The ids of a string without blanks."""
        out = []
        for t in _TOKEN.findall(self.restorer.word(raw)):
            if t[0].isalpha() and t[0].isascii():
                out.append(self.vocabulary.get(t, 1))
            elif t[0].isdigit():
                out.append(2)
            else:
                out.append(0)
        found = tuple(out)
        if len(self.kept) > 300_000:
            self.kept.clear()
        self.kept[raw] = found
        return found

    def ids(self, texts: list[str | None]) -> np.ndarray:
        """The ids of the words of all texts in a row; each text begins and ends with a boundary (0)."""
        return np.concatenate([x for x, _ in self._ids_of(texts)] or [np.zeros(0, np.int32)])

    def _ids_of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        kept, fresh = self.kept, self._ids
        for text in texts:
            ids = [0]
            for raw in self.restorer.clean(text or "").replace("\n", " \n ").split(" "):
                found = kept.get(raw)
                ids += fresh(raw) if found is None else found
            ids.append(0)
            yield np.array(ids, np.int32), len(ids)

    @staticmethod
    def passages(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and text of each passage; ``ends``: where each text ends."""
        cut = np.flatnonzero(ids == 0)
        start, stop = cut[:-1] + 1, cut[1:]
        some = stop > start
        start, stop = start[some], stop[some]
        more = np.maximum(0, -(-(stop - start - WINDOW) // STRIDE)) + 1
        first = np.repeat(start, more)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        a = first + step * STRIDE
        b = np.minimum(a + WINDOW, np.repeat(stop, more))
        return a, b, np.searchsorted(ends, a, side="right")

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, int]:
        """In how many sentences each feature stands, and how many there are."""
        n = len(self.features)
        sentence = np.cumsum(ids == 0)
        out = np.zeros(n, np.int64)
        for key in self._keys(ids) if n else []:
            at, hit = self._at(key)
            out += np.bincount(np.unique(sentence[hit] * n + at[hit]) % n, minlength=n)
        return out, int(((ids[1:] == 0) & (ids[:-1] != 0)).sum())

    def _at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of keys among the features, and which of them are features."""
        if not len(self.features):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.searchsorted(self.features, key).clip(max=len(self.features) - 1)
        return at, self.features[at] == key

    def _telling(self, key: int) -> bool:
        """Whether a key holds a known word: unknown words, numbers and ends of sentences are no evidence by themselves."""
        size = self.size
        if key < size:
            return key > 3
        key -= size
        places = (key // size, key % size) if key < size * size else ((key - size * size) // size // size, (key - size * size) // size % size, (key - size * size) % size)
        return max(places) > 3

    def _keys(self, ids: np.ndarray) -> list[np.ndarray]:
        """The keys of the word, the pair and the triple that end at each place; -1 across boundaries."""
        k = self.kind_of[ids]
        one = np.where(ids > 0, ids, -1)
        two, three = np.full(len(ids), -1), np.full(len(ids), -1)
        two[1:] = np.where((ids[1:] > 0) | (ids[:-1] > 0), self.size + k[:-1] * self.size + k[1:], -1)
        three[2:] = np.where(ids[1:-1] > 0, self.size * (self.size + 1) + (k[:-2] * self.size + k[1:-1]) * self.size + k[2:], -1)
        return [one, two, three]

    @staticmethod
    def _inside(three: np.ndarray, a: int, b: int) -> np.ndarray:
        """The keys of a passage; pairs and triples may reach one place beyond it."""
        f = np.concatenate([three[0, a:b], three[1, a : b + 1], three[2, a + 1 : b + 1]])
        return f[f >= 0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each text's worst passage; null and empty texts have 0."""
        found = [*self._ids_of(texts)]
        return self.judge(np.concatenate([x for x, _ in found] or [np.zeros(0, np.int32)]), np.cumsum([n for _, n in found]))

    def judge(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same for texts given by their ids; ``ends``: where each text ends."""
        a, b, owner = self.passages(ids, ends)
        worst = np.full(len(ends), -np.inf)
        if len(a) and len(self.features):
            sums, hits = [], []
            for key in self._keys(ids):
                at, hit = self._at(key)
                hit &= self.weights[at] != 0
                sums.append(np.concatenate([[0.0], np.cumsum(np.where(hit, self.weights[at], 0.0))]))
                hits.append(np.concatenate([[0], np.cumsum(hit)]))
            ends_ = ((a, b), (a, b + 1), (a + 1, b + 1))
            total = sum(s[y] - s[x] for s, (x, y) in zip(sums, ends_, strict=True))
            n = sum(h[y] - h[x] for h, (x, y) in zip(hits, ends_, strict=True))
            np.maximum.at(worst, owner, np.where(n > 0, self.bias + total / np.sqrt(n + 1), -np.inf))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-worst))


class AbusiveContent:
    """Scores texts for abusive, hateful or sexual content.

    ``fields``: (table, field, DataFrame, key, text column, source column or
    None) each. Null keys take no part; null and empty texts score 0; of
    repeated rows the worst score counts; sources are taken trimmed and in
    lower case, null and blank ones as null. Empty tables give no rows; other
    columns are not read. ``labelled``: (key, text, label 0/1) to fit the model
    on, all of them, on the driver; null labels are left out. The texts
    are decoded once; how often each feature stands in them is counted over
    all different texts, whatever their number, before the weights are fitted.
    """

    def __init__(self, fields: list[tuple], labelled: DataFrame):
        spark = labelled.sparkSession
        model = AbuseModel([(r["t"], r["y"] > 0) for r in in_order(labelled.toDF("k", "t", "y").where("y is not null"), "k")])
        self.decoded = materialise(self._decoded(fields, spark.sparkContext.broadcast(model)), "decoded")
        model.fit(*self._counted(spark.sparkContext.broadcast(model), len(model.features)))
        self.model = spark.sparkContext.broadcast(model)

    @staticmethod
    def _decoded(fields: list[tuple], model) -> DataFrame:
        """(tab, field_name, rec_id, source, copy, ids) of each row read: the ids of its restored words and a hash of them."""
        parts = []
        for tab, field, df, key, text, source in fields:
            name = F.nullif(F.lower(F.trim(source)), F.lit("")) if source else F.lit(None).cast("string")
            parts.append(df.where(F.col(key).isNotNull()).select(F.lit(tab).alias("tab"), F.lit(field).alias("field_name"), F.col(key).cast("long").alias("rec_id"), name.alias("source"), F.col(text).alias("text")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 2000):
                    part = b.slice(lo, 2000)
                    found = [x for x, _ in model.value._ids_of(part.column(4).to_pylist())]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
                    copy = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(4)], copy, lists], names=["tab", "field_name", "rec_id", "source", "copy", "ids"])

        return reduce(DataFrame.unionAll, parts).mapInArrow(run, "tab string, field_name string, rec_id long, source string, copy long, ids array<int>")

    def _counted(self, model, n: int) -> tuple[np.ndarray, int]:
        """In how many sentences of all different texts each feature of the model stands, and how many sentences there are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sentences = np.zeros(n, np.int64), 0
            for b in batches:
                c, k = model.value.counts(b.column(0).flatten().to_numpy())
                total, sentences = total + c, sentences + k
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], sentences))], names=["feature", "n"])

        one = self.decoded.select("copy", "ids").dropDuplicates(["copy"]).select("ids")
        counts = np.zeros(n, np.int64)
        sentences = 0
        for r in one.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # a row per feature of the labelled rows
            if r["feature"] < 0:
                sentences = r["n"]
            else:
                counts[r["feature"]] = r["n"]
        return counts, sentences

    def rows(self) -> DataFrame:
        """(tab, field_name, rec_id, source, score) of each row read."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids = b.column(4)
                    scores = model.value.judge(ids.flatten().to_numpy(), np.cumsum(pc.list_value_length(ids).to_numpy()))
                    yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(scores)], names=["tab", "field_name", "rec_id", "source", "score"])

        return self.decoded.select("tab", "field_name", "rec_id", "source", "ids").mapInArrow(run, "tab string, field_name string, rec_id long, source string, score double")

    def scores(self) -> DataFrame:
        """(tab, field_name, rec_id, score) of every text."""
        return self.rows().groupBy("tab", "field_name", "rec_id").agg(F.max("score").alias("score"))

    def review(self) -> DataFrame:
        """(tab, field_name, rec_id) of the texts to review: those that score REVIEW or more."""
        return self.rows().where(F.col("score") >= REVIEW).select("tab", "field_name", "rec_id").distinct()

    def rates(self) -> DataFrame:
        """(tab, field_name, source, texts, abusive, rate) per source and table."""
        one = self.rows().groupBy("tab", "field_name", "source", "rec_id").agg(F.max("score").alias("score"))
        out = one.groupBy("tab", "field_name", "source").agg(F.count("*").alias("texts"), F.count_if(F.col("score") >= REVIEW).alias("abusive"))
        return out.withColumn("rate", F.col("abusive") / F.col("texts"))
