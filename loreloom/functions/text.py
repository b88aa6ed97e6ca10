"""Text functions that the built-in ones cannot express: stemming and snippets, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    if w[i] in VOWELS:
        return False
    return not (w[i] == "y" and i > 0 and _is_consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    shape = "".join("c" if _is_consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall(r"v+c+", shape))


def _has_vowel(stem: str) -> bool:
    return any(not _is_consonant(stem, i) for i in range(len(stem)))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    n = len(w)
    return n > 2 and _is_consonant(w, n - 3) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 1) and w[-1] not in "wxy"


# Suffix rules of Porter's published algorithm (1980): fixed values.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace_longest(w: str, rules: dict[str, str], least: int) -> str:
    for n in range(min(len(w), 7), 0, -1):
        if w[-n:] in rules:
            stem = w[:-n]
            return stem + rules[w[-n:]] if _measure(stem) > least else w
    return w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Porter's stem of a lower-case word; words of other than a-z stay as they are."""
    w = word
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace_longest(w, STEP2, 0)
    w = _replace_longest(w, STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _doubled(w) and w.endswith("l"):
        w = w[:-1]
    return w


WORD = regex.compile(r"[\p{L}\p{N}\p{Co}\u0300-\u036F]+")
ACCENTS = regex.compile(r"[\u0300-\u036F]+")


def best_window(text: str, wanted: set[tuple[str, bool]], size: int = 40, opening: str = ">>>", closing: str = "<<<", more: str = "...") -> str:
    """The run of ``size`` words with the most different wanted words, each wanted word marked.

    Wanted are (stem, whether it is a prefix). Words are cut and folded as in ``operators.search.tokens``.
    """
    from ..operators.search import marked_letters

    fold = str.maketrans(*marked_letters())
    stems, begins = {w for w, prefix in wanted if not prefix}, tuple(w for w, prefix in wanted if prefix)
    spans = [m.span() for m in WORD.finditer(text)]
    folded = [porter(ACCENTS.sub("", text[a:b].lower()).translate(fold)) for a, b in spans]
    hits = [i for i, w in enumerate(folded) if w in stems or (begins and w.startswith(begins))]
    if not spans:
        return text[:200]
    best, at = (-1, -1), 0
    for i in hits or [0]:
        begin = max(0, min(i, len(spans) - size))
        inside = [h for h in hits if begin <= h < begin + size]
        score = (len({folded[h] for h in inside}), len(inside))
        if score > best:
            best, at = score, begin
    end = min(len(spans), at + size)
    left, right = (0 if at == 0 else spans[at][0]), (len(text) if end == len(spans) else spans[end - 1][1])
    out, last = [], left
    for h in hits:
        a, b = spans[h]
        if left <= a and b <= right:
            out += [text[last:a], opening, text[a:b], closing]
            last = b
    out.append(text[last:right])
    return (more if at else "") + "".join(out) + (more if end < len(spans) else "")


def snippet(column: Column | str, words: list[tuple[str, bool]], size: int = 40) -> Column:
    return F.pandas_udf(_snippet_of(set(words), size), "string")(column)


def _snippet_of(wanted: set[tuple[str, bool]], size: int) -> Callable[[pd.Series], pd.Series]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: best_window(t, wanted, size) if t else t)

    return run
