"""Problem 4: broken prompt and response pairs.

Language: posteriors of prompt and response by character n-gram naive Bayes.
Truncation: the likelihood that a text ends after its last n-gram, counted over
all responses. Empty, refused and copied answers are told by their words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bags import _cell, _wanted, mix
from lexiloom.llm.language import LanguageModel, asked, guess
from lexiloom.llm.tables import drawn
from lexiloom.session import materialise

#: Labelled rows drawn by hash order, and texts per language of them, on which the language model is fitted.
TRAINING_ROWS, TRAINING_TEXTS = 4_000, 600
#: Least log-odds by which a text must belong to its language rather than the other text's.
MARGIN = 6.0
#: A text whose last n-gram ends a line less often than this breaks off; so does one whose last sentence, seen elsewhere, ends there less often than the other.
LEAST_END, LEAST_SENTENCE_END = 0.25, 0.5

#: Fillers for a missing answer, without blanks and punctuation.
FILLERS = set("na nan none null nil nothing tbd tba todo blank empty noanswer answer missing unknown undefined placeholder pending notavailable notapplicable nooutput noresponse noinput noreply answerhere insertanswer fixme xxx void nocontent noanswergiven noanswerprovided unanswered".split())
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_MARKUP = re.compile(r"</?[a-z][^<>]{0,80}>|&nbsp;|[*`#>]+", re.I)
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\n|[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d(?:[\d,.]*\d)?|[^\w\s]")
_ITEM = re.compile(r"\s*(?:\d{1,3}[.)]|[-*•])\s")
_LONE_ITEM = re.compile(r"\s*(?:\d{1,3}[.)]?|[-*•])\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”']?\s+|\n+")
#: The speaker, what keeps them, and what they will not do.
_REFUSES = re.compile(
    r"\b(?:i|we)(?:'m| am| are|'re)? (?:only a program|just a program|an ai|a language model)|\bas an? (?:\w+ ){0,2}(?:ai|model|assistant|program|bot)\b"
    r"|\b(?:i|we)(?:'m| am|'re| are)? (?:sorry|afraid|unable|not able|not allowed|not permitted|not in a position|can ?not|can't|could not|couldn't|won't|will not|do not|don't|must decline|must refuse|decline|refuse|would rather not|prefer not)\b[^.!?]*"
    r"\b(?:answer|assist|help|discuss|reply|respond|comment|say|provide|share|opinions?|questions?|request|advice|talk|engage|continue|comply|fulfil|fulfill|do (?:that|this))"
    r"|\b(?:something|topic|question|request|matter)s? (?:that )?i (?:must|have to|will|need to) (?:decline|refuse)|\bunable to (?:answer|assist|help|comment|discuss|provide|respond|fulfil)"
    r"|\bno comment\b|\b(?:not|n't) be (?:appropriate|right|proper) for me\b|\b(?:against|outside|beyond) (?:my|our) (?:polic|guideline|rule|scope|remit|instruction|principle|term)|\bi have no (?:access|answer|opinion|way)"
    r"|\b(?:guidelines|rules|policies|policy|instructions|principles|terms) (?:do(?:es)? not allow|prevent|forbid|prohibit|bar|keep|stop) (?:me|us)\b|\b(?:falls?|lies?|goes|is) (?:outside|beyond) what i\b"
    r"|\bi must (?:decline|refuse)|\bi(?:'d| would) rather not\b|\bi do not answer\b|\bcannot say anything\b"
)
#: Sentences that carry nothing.
_COURTESY = re.compile(r"^(?:(?:hello|hi|dear|hey)\b.{0,40}|(?:many )?thank(?:s| you).{0,90}|good question.?|you(?:'re| are) asking about.{0,90}|great question.?|sorry.?|(?:i )?apologi[sz]e.{0,40}|my apologies.?|.{0,20}anything else.{0,40}|please (?:ask|try|consult|contact|rephrase).{0,80}|hope that helps.{0,5}|regards.{0,30}|good luck.{0,3}|have a (?:nice|good).{0,20}|\W*)$")
_ADDRESS = re.compile(r"^(?:hello|hi|dear|hey)\b[^,.!?]{0,40},\s*")


def clean(text: str | None) -> str:
    return _MARKUP.sub(" ", _INVISIBLE.sub("", text or "")).strip()


def is_empty(text: str | None) -> bool:
    """Nothing, or only a filler for a missing answer."""
    bare = re.sub(r"[\W_]+", "", _INVISIBLE.sub("", text or "").lower())
    return bare in FILLERS if bare else not re.search(r"[^\W_]", text or "")


def is_refusal(text: str) -> bool:
    """Every sentence declines or is a courtesy, and one declines."""
    declines = False
    for s in _SENTENCE.split(text.replace("’", "'").lower()):
        s = _ADDRESS.sub("", s.strip())
        if _REFUSES.search(s):
            rest = re.search(r"\bbut\b((?:\W+\w+){6,})", s)
            if rest and not _REFUSES.search(rest[1]):
                return False
            declines = True
        elif s and not _COURTESY.match(s):
            return False
    return declines


def is_copy(prompt: str, context: str, answer: str) -> bool:
    """The words of the answer are those of the prompt (and its context), slight changes aside, and nothing more."""
    o, i, c = (Counter(_WORD.findall(x.lower())) for x in (answer, prompt, context))
    n, ni = o.total(), i.total()
    if n < 4 or ni < 4:
        return False
    common = (o & i).total()
    times = min(4, max(1, round(n / ni)))  # the prompt may be given back several times
    again = Counter({w: k * times for w, k in i.items()}) + c
    return common >= 0.65 * ni and (o & again).total() >= 0.75 * n


_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Tokens(dict):
    """64-bit hashes of tokens; numbers are #."""

    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[t] = xxhash.xxh64_intdigest("#" if t[0].isdigit() else t.lower())
        return value


_tokens = _Tokens()
_START, _LINE, _STOP = _tokens["^"], _tokens["\n"], _tokens["."]
_ENDS = np.array([_STOP, _tokens["!"], _tokens["?"], _LINE, _START], np.uint64)


class Stream:
    """The tokens of many texts in a row, with the n-grams that end at each.

    ``ctx``: the last token, the last two, the last three (those in items of
    lists kept apart) and the sentence so far, as 64-bit hashes. ``last`` marks
    the last token of a text.
    """

    def __init__(self, texts: list[str]):
        flat: list[int] = []
        item: list[bool] = []
        stop: list[int] = []
        for text in texts:
            flat.append(_START)
            item.append(False)
            for k, line in enumerate(text.rstrip().split("\n")):
                found = _TOKEN.findall(line)
                if k:
                    flat.append(_LINE)
                    item.append(False)
                flat.extend(map(_tokens.__getitem__, found))
                item.extend([bool(found) and _ITEM.match(line) is not None] * len(found))
            stop.append(len(flat))
        t = self.t = np.array(flat, np.uint64)
        self.item = np.array(item, bool)
        self.stop = np.array(stop, np.int64)
        self.last = np.zeros(len(t), bool)
        self.last[self.stop - 1] = True
        before = np.concatenate([t[:1], t[:-1]])
        before2 = np.concatenate([t[:2], t[:-2]])[: len(t)]
        mark = np.where(self.item, _C3, np.uint64(0))
        one = mix(t + mark)
        two = mix(one + before * _C1)
        three = mix(two + before2 * _C2)
        begin = np.isin(before, _ENDS)
        begin[0] = True
        at = np.arange(len(t))
        start = np.maximum.accumulate(np.where(begin, at, 0))
        part = np.cumsum(mix(t + (at - start).astype(np.uint64) * _C2))
        sentence = mix(part - np.where(start > 0, part[np.maximum(start - 1, 0)], np.uint64(0)) + _C3)
        self.ctx = np.stack([one, two, three, sentence]).view(np.int64)
        follows = np.concatenate([t[1:], t[:1]])
        self.line = ~self.last & (follows == _LINE)
        self.dot = ~self.last & (follows == _STOP)
        self.word = (t != _START) & (t != _LINE)


class PairDefects:
    """Flags defective pairs with the kind of their defect.

    ``pairs``: key, prompt, context and response columns; ``labelled``: texts
    with a language column for training. Null keys take no part, repeated keys
    count once (the least row), null prompts and contexts are empty strings, a
    null response is the defect ``empty``. One defect a pair, the first of
    empty, refusal, copy, language, truncated. Empty tables give no rows.
    """

    def __init__(self, pairs: DataFrame, labelled: DataFrame, key: str, prompt: str, context: str, response: str, text: str = "text", lang: str = "lang", label_key: str = "doc_id"):
        one = pairs.select(F.col(key).cast("long").alias("id"), *[F.col(c).alias(n) for c, n in ((prompt, "p"), (context, "c"), (response, "r"))]).where("id is not null")
        one = one.groupBy("id").agg(F.min(F.struct("p", "c", "r")).alias("x")).select("id", "x.*")
        self.pairs = materialise(one, "pairs")
        self.model = self._fit(labelled, text, lang, label_key)

    def _fit(self, labelled: DataFrame, text: str, lang: str, label_key: str) -> LanguageModel:
        """Fitted on labelled texts; languages without any on the trigrams of all pairs' texts that function words assign to them."""
        code = F.substring(F.lower(F.trim(lang)), 1, 2)
        rows = labelled.where(F.col(text).isNotNull() & F.length(F.trim(lang)).between(2, 5) & (code != "un")).select(F.col(text).alias("t"), code.alias("code"), F.col(label_key).alias("k"))
        taken: Counter = Counter()
        out = []
        for r in drawn(rows, "k", TRAINING_ROWS):
            if taken[r["code"]] < TRAINING_TEXTS:
                taken[r["code"]] += 1
                out.append((r["t"], r["code"]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total: Counter = Counter()
                for t in (*b.column(0).to_pylist(), *b.column(1).to_pylist()):
                    c = guess(t) if t else None
                    if c and c not in taken:
                        total.update((c, g) for g in LanguageModel.grams_of(t).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.string()), pa.array([g for _, g in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["code", "gram", "n"])

        counted: dict[str, Counter] = {}
        for r in self.pairs.select("p", "r").mapInArrow(count, "code string, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n")).collect():  # the trigrams of a few alphabets
            counted.setdefault(r["code"], Counter())[r["gram"]] = r["n"]
        return LanguageModel(out, counted)

    def _endings(self, wanted) -> DataFrame:
        """(context, seen, ends, lines, dots): how often each n-gram (and beginning of a sentence) of all distinct responses is seen, ends a text, ends a line within one, and goes on with a full stop. ``wanted``: a bitmap of the contexts asked for."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = np.unpackbits(wanted.value)
            for b in batches:
                s = Stream(b.column(0).to_pylist())
                keys, kinds = [], []
                kind = 1 + s.last * (1 << 16) + s.line * (1 << 32) + s.dot * (1 << 48)
                for ctx in s.ctx:
                    hit = s.word & (on[_cell(ctx)] > 0)
                    keys.append(ctx[hit])
                    kinds.append(kind[hit])
                key, at = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.concatenate(kinds)
                cols = [np.bincount(at, (total >> (16 * i)) & 0xFFFF, minlength=len(key)).astype(np.int64) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, cols)], names=["context", "seen", "ends", "lines", "dots"])

        def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [clean(x) for x in b.column(0).to_pylist()]
                keys = [xxhash.xxh64_intdigest(" ".join(t.lower().split())) - 2**63 for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["h", "text"])

        # a response counts once however many pairs give it: copies of a judged text must not speak for it
        distinct = self.pairs.select("r").where("r is not null").mapInArrow(cleaned, "h long, text string").groupBy("h").agg(F.min("text").alias("text"))
        return distinct.select("text").mapInArrow(count, "context long, seen long, ends long, lines long, dots long").groupBy("context").agg(*[F.sum(c).alias(c) for c in ("seen", "ends", "lines", "dots")])

    def judged(self) -> DataFrame:
        """(id, defect, kind, contexts): the defect that a pair itself tells; else the n-grams whose counts must tell whether it breaks off."""
        model = self.pairs.sparkSession.sparkContext.broadcast(self.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = judge(model.value, *(col.to_pylist() for col in b.columns[1:]))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(found, (pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)]], names=["id", "defect", "kind", "contexts"])

        return self.pairs.select("id", "p", "c", "r").mapInArrow(run, "id long, defect string, kind string, contexts array<long>")

    def defects(self) -> DataFrame:
        """(id, defect) of each defective pair."""
        judged = materialise(self.judged(), "judged")
        asked_for = judged.select(F.explode("contexts").alias("context"))
        counts = self._endings(judged.sparkSession.sparkContext.broadcast(_wanted(asked_for)))
        level = judged.where("kind is not null").select("id", "kind", F.posexplode("contexts").alias("k", "context"))
        level = level.join(counts, "context", "left").fillna(0, ["seen", "ends", "lines", "dots"])
        # how a text ends does not speak for itself: line ends within texts count for n-grams, other texts' ends for sentences
        own = (
            F.when(F.col("kind") == "dot", F.struct((F.col("seen") - 1).alias("n"), (F.col("dots") - 1).alias("m")))
            .when(F.col("k") == 3, F.struct((F.col("seen") - 1).alias("n"), (F.col("ends") - 1).alias("m")))
            .otherwise(F.struct((F.col("seen") - F.col("ends")).alias("n"), F.col("lines").alias("m")))
        )
        level = level.withColumn("own", own).select("id", "kind", "k", F.col("own.n").alias("n"), F.col("own.m").alias("m"))
        best = level.groupBy("id", "kind").agg(
            F.max_by(F.struct("n", "m"), F.when((F.col("n") >= 4) & (F.col("k") < 3), F.col("k"))).alias("x"),
            F.max(F.when(F.col("k") == 3, F.struct("n", "m"))).alias("s"),
        )
        rate = (F.col("x.m") + 0.5) / (F.col("x.n") + 1)
        sentence = (F.col("s.n") >= 1) & (F.col("s.m") >= LEAST_SENTENCE_END * F.col("s.n"))
        cut = best.where(F.when(F.col("kind") == "end", ~F.coalesce(sentence, F.lit(False)) & (F.col("x").isNull() | (rate < LEAST_END))).otherwise(F.col("x").isNotNull() & (F.col("x.n") >= 20) & (rate < 0.02)))
        told = judged.where("defect is not null").select("id", "defect")
        return told.unionAll(cut.select("id", F.lit("truncated").alias("defect")))


def judge(model: LanguageModel, prompts: list[str | None], inputs: list[str | None], responses: list[str | None]) -> tuple[list, list, list]:
    """The defect where the pair itself tells it; else what the last n-grams must tell: kind ``end`` (no mark at the end) or ``dot`` (a number and a full stop)."""
    n = len(responses)
    defects: list[str | None] = [None] * n
    kinds: list[str | None] = [None] * n
    found: list[list[int] | None] = [None] * n
    answers = [clean(r) for r in responses]
    for i, (p, c, r, answer) in enumerate(zip(prompts, inputs, responses, answers, strict=True)):
        if is_empty(r) or is_empty(answer):
            defects[i] = "empty"
        elif is_refusal(answer):
            defects[i] = "refusal"
        elif is_copy(clean(p), clean(c), answer):
            defects[i] = "copy"
    left = [i for i in range(n) if defects[i] is None]
    if model.codes and left:
        sp, sr = model.scores([prompts[i] or "" for i in left]), model.scores([answers[i] for i in left])
        for k in np.flatnonzero(sp.argmax(axis=1) != sr.argmax(axis=1)):
            i, p, r = left[k], int(sp[k].argmax()), int(sr[k].argmax())
            if sp[k, p] - sp[k, r] >= MARGIN and sr[k, r] - sr[k, p] >= MARGIN and sum(map(str.isalpha, answers[i])) >= 12 and sum(map(str.isalpha, prompts[i] or "")) >= 12 and model.codes[r] not in asked(prompts[i] or ""):
                defects[i] = "language"
    left = [i for i in left if defects[i] is None]
    ask = []
    for i in left:
        answer = answers[i].rstrip()
        lines = answer.split("\n")
        end = re.sub(r"(?<=[.!?…])[\"”’')\]]+$", "", answer)
        if len(lines) > 1 and _LONE_ITEM.match(lines[-1]) or end[-1:] in ",:;(-–—/&":
            defects[i] = "truncated"
        elif end[-1:] in ".!?…。！？":
            if re.search(r"\d\.$", end) and not _ITEM.match(lines[-1]):
                ask.append((i, end[:-1], "dot"))
        else:
            ask.append((i, answer, "end"))
    if ask:
        s = Stream([text for _, text, _ in ask])
        for (i, _, kind), at in zip(ask, s.stop - 1, strict=True):
            kinds[i] = kind
            found[i] = s.ctx[: 4 if kind == "end" else 3, at].tolist()
    return defects, kinds, found
