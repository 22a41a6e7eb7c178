"""Text analysis: tokens, alternatives, stop words, stems."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

@dataclass(frozen=True)
class Analysis:
    """What happens to tokens, when they are indexed and when a query is read."""

    stop_words: tuple[str, ...] = ()
    stemmed: bool = False

    @classmethod
    def chain(cls, *steps: str) -> Analysis:
        """The analysis that a chain of named steps describes.

        Steps: ``ocr`` (the markup of the field), ``standard`` or ``whitespace`` (a tokenizer), ``alternatives``,
        ``lowercase``, ``stop`` and ``porter``. Alternatives must follow a tokenizer that follows the markup.
        """
        known = {"ocr", "standard", "whitespace", "alternatives", "lowercase", "stop", "porter"}
        bad = [x for x in steps if x not in known]
        tokenizers = [i for i, x in enumerate(steps) if x in ("standard", "whitespace")]
        if bad or len(tokenizers) != 1:
            raise ValueError(f"unknown steps: {bad}" if bad else "a chain has one tokenizer")
        if "alternatives" in steps and (steps.index("alternatives") != tokenizers[0] + 1 or steps[: tokenizers[0]] != ("ocr",)):
            raise ValueError("alternatives must directly follow a tokenizer that reads the markup")
        return cls(tuple(STOP_WORDS) if "stop" in steps else (), "porter" in steps)

    def terms(self, tokens: Iterable[str]) -> list[str | None]:
        """Tokens of a query as the index has them; None where a stop word leaves a gap."""
        return [None if t in self.stop_words else porter(t) if self.stemmed else t for t in tokens]


TOKEN = r"[\p{L}\p{N}]+"
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()
MAX_TOKEN = 255


def tokens(text: Column | str, lower: bool = True) -> Column:
    """Tokens of the standard kind, as an array; a null or empty text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(f"({TOKEN})"))


def whitespace_tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != "")


_VOWEL = re.compile(r"[aeiou]")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return i == 0 or not _consonant(w, i - 1) if c == "y" else True


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(w: str) -> str:
    """The Porter stemmer of 1980."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((x for x in ("ed", "ing") if w.endswith(x) and _has_vowel(w[: -len(x)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if hit:
        stem = w[: -len(hit)]
        if _measure(stem) > 1 and (hit != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem(term: Column) -> Column:
    """Arrow-batched; distinct terms of a batch are stemmed once."""

    @F.pandas_udf(T.StringType())
    def run(terms: pd.Series) -> pd.Series:
        return terms.map({t: porter(t) for t in terms.dropna().unique()})

    return run(term)
