"""Language posteriors by naive Bayes over character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

#: Frequent function words, by which texts without a label are assigned for training.
SEEDS = {
    "en": "the of and to is that for with not you this are from before",
    "fr": "le la les des est une dans pour que qui sur été avec pas aux",
    "de": "der die das und ist nicht ein eine für mit auf wird von den wurde",
    "es": "el los las una que con para por del fue según más está sin como",
    "it": "il che della per non più gli è sono alla verrà nel di una perché",
    "pt": "o os que não uma foi com em do da são até mais para porque",
    "nl": "de het een van en niet dat op zijn voor met wordt bij ook",
    "ru": "и в не на что по из для с был это как за",
}
#: How a prompt names a language.
NAMES = {
    "en": "english anglais englisch inglés inglês inglese английск",
    "fr": "french français französisch francés francês francese французск",
    "de": "german deutsch allemand alemán alemão tedesco немецк",
    "es": "spanish español espagnol spanisch espanhol spagnolo испанск",
    "it": "italian italiano italien italienisch итальянск",
    "pt": "portuguese português portugais portugiesisch portugués portoghese португальск",
    "nl": "dutch nederlands néerlandais niederländisch holandés",
    "ru": "russian русск russe russisch ruso russo",
    "zh": "chinese 中文 汉语 chinois chinesisch chino cinese китайск",
}
_NAME = re.compile("|".join(sorted((re.escape(n) for names in NAMES.values() for n in names.split()), key=len, reverse=True)))
_CODE = {n: code for code, names in NAMES.items() for n in names.split()}
_CLEAN = re.compile(r"[\W\d_]+")


def asked(prompt: str) -> set[str]:
    """The languages that a prompt names."""
    return {_CODE[m] for m in _NAME.findall(prompt.lower())}


def guess(text: str) -> str | None:
    """A language by function words, None where they do not tell."""
    words = set(_CLEAN.sub(" ", text.lower()).split())
    score = sorted(((len(words & set(s.split())), code) for code, s in SEEDS.items()), reverse=True)
    return score[0][1] if score[0][0] >= 3 and score[0][0] > score[1][0] else None


class LanguageModel:
    """Multinomial naive Bayes over character trigrams, uniform prior. ``counted``: trigrams (``grams``) of further languages."""

    def __init__(self, texts: list[tuple[str, str]], counted: dict[str, Counter] | None = None, floor: float = 0.1):
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, code in texts:
            counts[code].update(self.grams_of(text).tolist())
        for code, more in (counted or {}).items():
            counts[code].update(more)
        self.codes = sorted(counts)
        self.grams = np.array(sorted({g for c in counts.values() for g in c}), np.int64)
        table = np.full((len(self.grams) + 1, max(1, len(self.codes))), floor)
        for j, c in enumerate(self.codes):
            found = np.array(list(counts[c].items()), np.int64).reshape(-1, 2)
            table[np.searchsorted(self.grams, found[:, 0]), j] += found[:, 1]
        self.table = np.log(table / table.sum(axis=0))

    @classmethod
    def grams_of(cls, text: str) -> np.ndarray:
        """The trigrams of a text."""
        return cls._keys([text])[0]

    @staticmethod
    def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of all texts and where those of each text begin; letters only, runs of all else as a blank."""
        clean = [" " + _CLEAN.sub(" ", t.lower()).strip() + " \0" for t in texts]
        flat = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.concatenate([[0], np.cumsum([len(c) for c in clean])])
        keys = np.full(len(flat), -1)
        keys[:-2] = (flat[:-2] << 42) | (flat[1:-1] << 21) | flat[2:]
        last = start[1:] - 1
        for back in (0, 1, 2):
            keys[np.maximum(last - back, 0)] = -1
        if len(texts) == 1:
            return keys[keys >= 0], start
        return keys, start[:-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The log-likelihood of each text (row) under each language."""
        out = np.zeros((len(texts), self.table.shape[1]))
        if not texts or not len(self.grams):
            return out
        keys, start = self._keys([*texts, ""])
        at = np.searchsorted(self.grams, keys).clip(max=len(self.grams) - 1)
        at = np.where(self.grams[at] == keys, at, len(self.grams))
        for j in range(out.shape[1]):
            out[:, j] = np.add.reduceat(np.where(keys < 0, 0.0, self.table[at, j]), start)[:-1]
        return out

    def posteriors(self, texts: list[str]) -> np.ndarray:
        s = self.scores(texts)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
