"""Abusive, hateful or sexual passages by maximum-scoring segment search.

Every word gets a score: the log-odds of its longest known n-gram between toxic passages and ordinary
text, with Dirichlet priors (an n-gram's prior is what its shorter n-grams predict, a word's prior the
ordinary text). No word list takes part unless the caller gives one (``seed_words``). Ordinary words score below zero on average, so a linear scan over
a text finds every maximal segment whose total cannot be raised by growing or shrinking it. The best
segment of a text is calibrated by an extreme-value law fitted to ordinary texts, which grows with the
text's length; a text is toxic if chance would so rarely give such a segment.

The scores are fitted to a bounded sample of reviewed documents (``max_reviewed``, in hash order): only
whole documents are labelled, so a second round recounts within the segments that the first one found.
The counts of ordinary text behind the priors and the location and scale of the extreme-value law come from
the sample's ordinary texts, too, so words outside the sample have no count of their own. Scoring runs over
all documents, in one pass without a shuffle.

Defined results: null and empty texts score 0 and are not toxic; a document with several reviews takes
their majority, a draw is left out; without reviews of both kinds all documents score 0, unless words are given.
"""

from __future__ import annotations

import pickle
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe

#: Reviewed documents that the scores are fitted to, at most.
MAX_REVIEWED = 20_000
#: Reviewed documents longer than this many characters are left out of the fit (never out of the scoring).
MAX_CHARS = 200_000
#: Characters of reviewed documents that the fit takes, at most: the sample ends, in hash order, where they are full.
MAX_TOTAL_CHARS = 400_000_000
#: Words that have a number of their own, the most frequent ones if the sample has more; n-gram keys have 20 bits a word.
MAX_WORDS = 1 << 20
#: Words and n-grams seen less often in the reviewed texts have no score of their own, however many reviews there are.
LEAST = 2
#: Natural logarithm of the chance below which a segment counts; lowered where held-out reviews say so.
LOG_CHANCE = -7.0

LEET = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
# Latin letters and the Cyrillic and Greek ones that look alike: fixed values.
LATIN, CYRILLIC, GREEK = "abekmhopctyxijs", "авекмнорстухіјѕ", "αβεκμηορςτυχιϳѕ"
TO_LATIN = str.maketrans(CYRILLIC + GREEK[:13], LATIN + LATIN[:13])
TO_CYRILLIC = str.maketrans(LATIN, CYRILLIC)
INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}]+")
MARKS = regex.compile(r"\p{Mn}+")
TRIPLE = regex.compile(r"(.)\1{2,}")
SPACED = regex.compile(r"(?<![\p{L}\p{N}])(\p{L})(?:([\-_.*·~ ])(?:\p{L}))(?:\2\p{L})+(?![\p{L}\p{N}])")
SPACED_RE2 = r"(^|[^\pL\pN])\pL[\-_.*·~ ]\pL[\-_.*·~ ]\pL([^\pL\pN]|$)"

BREAK, WORD, SIGN, ALONE, JOINT = range(5)
UNKNOWN, NUMBER, CODE, MASK = "<unknown>", "<number>", "<code>", "<mask>"


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point for word cutting, and whether it ends a sentence."""
    kinds = bpe.char_classes()
    table = np.full(0x110000, BREAK, np.uint8)
    table[(kinds == bpe.LETTER) | (kinds == bpe.NUMBER)] = WORD
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for m in regex.finditer(r"[\p{M}\p{Cf}]+", every):
        table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = WORD
    for m in regex.finditer(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+", every):
        table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = ALONE
    table[[ord(c) for c in "*@$!|€"]] = JOINT
    ends = np.zeros(0x110000, bool)
    ends[[ord(c) for c in "\n\r.!?…。！？  "]] = True
    return table, ends


@dataclass
class Words:
    """The words of a block of texts: raw forms, their code at each place, text and sentence numbers, offsets."""

    forms: list[str]
    codes: np.ndarray
    text: np.ndarray
    sentence_start: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def unspaced(text: str) -> str:
    """Words spelled out letter by letter, put together again."""
    return SPACED.sub(lambda m: m[0][0] + m[0][2::2] if len(m[0]) > 4 else m[0], text)


def cut_words(texts: list[str]) -> Words:
    """All words of a block; ideographs and kana stand alone."""
    if texts:
        hit = pc.match_substring_regex(pa.array(texts, pa.large_string()), SPACED_RE2)
        texts = [unspaced(t) if h else t for t, h in zip(texts, hit.to_pylist())]
    joined = "\n".join(texts)
    table, enders = _classes()
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cps)
    empty = np.zeros(0, np.int64)
    if not n:
        return Words([], empty, empty, np.zeros(0, bool), empty, empty)
    cls = table[cps]
    # marks such as * and @ belong to a word only between or before letters
    word = cls == WORD
    joint = np.flatnonzero(cls == JOINT)
    if len(joint):
        padded = np.concatenate([[False], word, [False]])
        is_joint = np.concatenate([[False], cls == JOINT, [False]])
        after = padded[joint + 2] | is_joint[joint + 2]
        before = padded[joint] | is_joint[joint]
        word[joint[after & before]] = True
    alone = cls == ALONE
    inside = word | alone
    first = inside.copy()
    first[1:] &= ~(word[1:] & word[:-1])
    begin = np.flatnonzero(first)
    if not len(begin):
        return Words([], empty, empty, np.zeros(0, bool), empty, empty)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    stop |= alone
    end = np.flatnonzero(stop) + 1
    width = 1 + (cps >= 0x80) + (cps >= 0x800).astype(np.int8) + (cps >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    raw = joined.encode("utf-8", "surrogatepass")
    # one array with words and gaps by turns; the gaps are left out again
    offsets = np.empty(2 * len(begin), np.int64)
    offsets[0::2], offsets[1::2] = byte_at[begin], byte_at[end]
    both = pa.Array.from_buffers(pa.binary(), 2 * len(begin) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    coded = both.take(pa.array(np.arange(0, 2 * len(begin) - 1, 2))).dictionary_encode()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_at = np.cumsum(sizes) - sizes
    text = np.searchsorted(text_at, begin, "right") - 1
    stops = np.concatenate([[0], np.cumsum(enders[cps] & ~word)])
    start = np.ones(len(begin), bool)
    start[1:] = stops[begin[1:]] != stops[begin[:-1]]
    forms = [b.decode("utf-8", "replace") for b in coded.dictionary.to_pylist()]
    return Words(forms, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, start, begin - text_at[text], end - text_at[text])


def plain_word(form: str) -> str:
    """Lower case, compatible forms, no marks or invisible signs, one script."""
    w = INVISIBLE.sub("", form)
    w = unicodedata.normalize("NFKC", w).casefold()
    if len(w) > 1 or w < "⺀":
        w = unicodedata.normalize("NFC", MARKS.sub("", unicodedata.normalize("NFKD", w)))
    if not w.isascii():
        latin = sum("a" <= c <= "z" for c in w)
        other = sum("Ͱ" <= c <= "ӿ" for c in w)
        if latin and other:
            w = w.translate(TO_LATIN if latin >= other else TO_CYRILLIC)
    w = TRIPLE.sub(r"\1", w)
    return w.strip("*@$!|€")


def readings(w: str) -> list[str]:
    """What a word with digits or signs among its letters may stand for, likeliest first."""
    letters = "".join(LEET.get(c, c) for c in w)
    out = [letters, "".join("l" if c in "1|" else LEET.get(c, c) for c in w), w.rstrip("0123456789"), w.lstrip("0123456789")]
    return [x for x in dict.fromkeys(out) if x and x.isalpha()]


@dataclass
class ToxicModel:
    """Scores of words, pairs and triples of words, and the calibration of a text's best segment."""

    ids: dict[str, int] = field(default_factory=dict)
    masks: dict[str, int] = field(default_factory=dict)
    word_score: np.ndarray = field(default_factory=lambda: np.zeros(1))
    keys: list[np.ndarray] = field(default_factory=list)
    scores: list[np.ndarray] = field(default_factory=list)
    rate: float = 1.0
    log_k: float = 0.0
    log_chance: float = LOG_CHANCE

    def word_id(self, form: str) -> int:
        w = plain_word(form)
        known = self.ids.get(w)
        if known is not None:
            return known
        if not w:
            return self.ids.get(UNKNOWN, 0)
        if w.isdigit():
            return self.ids.get(NUMBER, 0)
        if "*" in w:
            ends = (w[0], w[-1]) if w[-1] != "*" else (w[0], "")
            return self.masks.get("*".join(ends), self.ids.get(MASK, 0))
        if not w.isalpha():
            for r in readings(w):
                if r in self.ids:
                    return self.ids[r]
            return self.ids.get(CODE, 0)
        if len(w) > 3:
            squeezed = regex.sub(r"(.)\1", r"\1", w)
            if squeezed in self.ids:
                return self.ids[squeezed]
        return self.ids.get(UNKNOWN, 0)

    def place_scores(self, words: Words, ids: np.ndarray) -> np.ndarray:
        """Score of each place: that of the longest known n-gram ending there within its sentence."""
        s = self.word_score[ids].copy()
        for keys, scores, order in zip(self.keys, self.scores, (2, 3)):
            if not len(keys) or len(ids) < order:
                continue
            at, grams = ngrams(ids, words.sentence_start, order)
            k = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            known = keys[k] == grams
            s[at[known]] = scores[k[known]]
        return s

    def id_places(self, words: Words) -> np.ndarray:
        table = np.fromiter(map(self.word_id, words.forms), np.int64, len(words.forms))
        return table[words.codes]


def ngrams(ids: np.ndarray, start: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last word, key) of each n-gram that stays within a sentence."""
    fits = ~start[1:]
    keys = (ids[:-1] << 20) | ids[1:]
    if order == 2:
        at = np.flatnonzero(fits) + 1
        return at, keys[at - 1]
    at = np.flatnonzero(fits[:-1] & fits[1:]) + 2
    return at, (keys[at - 2] << 20) | ids[at]


def best_segments(s: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Total of the best segment of each text, all texts at once."""
    best = np.zeros(n_texts)
    if len(s):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        c = np.cumsum(s)
        base = np.repeat(np.concatenate([[0.0], c[first[1:] - 1]]), np.diff(np.append(first, len(s))))
        c -= base
        before = np.concatenate([[0.0], c[:-1]])
        before[first] = 0.0
        # a floor far below for each later text makes the running minimum start anew
        drop = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s)))) * (2 * np.abs(c).max() + 1)
        low = np.minimum.accumulate(before - drop) + drop
        best[text[first]] = np.maximum.reduceat(c - low, first)
    return np.maximum(best, 0.0)


def maximal_segments(s: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, total) of one text in linear time (Ruzzo and Tompa, 1999)."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    total = 0.0
    for i, x in enumerate(s):
        left, total = total, total + x
        if x <= 0:
            continue
        begin = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((begin, i + 1, left, total))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, after - before) for b, e, before, after in found]


# --- fitting -----------------------------------------------------------------------------------------


def log_odds(y1: np.ndarray, n1: float, y0: np.ndarray, n0: float, prior: np.ndarray, strength: float, lean: np.ndarray | float = 0.0) -> np.ndarray:
    """Dirichlet log-odds, drawn to zero by one standard deviation; ``lean`` shifts the prior's log-odds."""
    a = strength * np.clip(prior, 1e-6, 1)
    up, down = np.exp(np.clip(lean, -6, 6) / 2), np.exp(-np.clip(lean, -6, 6) / 2)
    p1, p0 = y1 + a * up, y0 + a * down
    d = np.log(p1 / (n1 + strength)) - np.log(p0 / (n0 + strength))
    sd = np.sqrt(1 / (p1 + 0.5) + 1 / (p0 + 0.5))
    return np.sign(d) * np.maximum(0.0, np.abs(d) - 0.5 * sd)


def fit(texts: list[str], toxic: list[bool], least: int = LEAST, rounds: int = 3, seed_words: Sequence[str] = ()) -> ToxicModel:
    """Scores and calibration from labelled texts. N-grams seen less than ``least`` times have no score of their own.

    ``seed_words`` are words that the caller knows to be abusive; their prior leans to it."""
    model = ToxicModel()
    y = np.array(toxic, bool)
    parts = [(a, cut_words(texts[a:b])) for a, b in bpe.blocks(texts)]
    counts: dict[str, int] = {}
    for _, w in parts:
        n = np.bincount(w.codes, minlength=len(w.forms))
        for form, k in zip(w.forms, n.tolist()):
            p = plain_word(form)
            if p.isalpha():
                counts[p] = counts.get(p, 0) + k
    seeds = {plain_word(w) for w in seed_words}
    own = {w: k for w, k in counts.items() if k >= least and w not in seeds}
    if len(own) > MAX_WORDS - len(seeds) - 4:
        own = dict(sorted(own.items(), key=lambda x: (-x[1], x[0]))[: MAX_WORDS - len(seeds) - 4])
    vocabulary = [UNKNOWN, NUMBER, CODE, MASK, *sorted(own.keys() | seeds)]
    model.ids = {w: i for i, w in enumerate(vocabulary)}
    v = len(vocabulary)
    seeded = np.zeros(v)
    seeded[[model.ids[w] for w in seeds]] = 3.0
    model.word_score = np.where(seeded > 0, 3.0, -0.5)
    model.masks = _masks(vocabulary, model.word_score)
    if not (y.any() and (~y).any()):
        model.rate, model.log_k = 2.0, -1.0  # two given words close together are enough
        return model

    if not parts:
        return model
    text = np.concatenate([w.text + a for a, w in parts])
    start = np.concatenate([w.sentence_start for _, w in parts])
    sentence = np.cumsum(start)
    ordinary = ~y[text]
    n0, sizes = float((~y).sum()), np.bincount(text, minlength=len(texts))
    inside: np.ndarray | None = None
    for r in range(rounds):
        if r < 2:  # masked words are read anew once the first scores are known
            model.masks = _masks(vocabulary, model.word_score)
            ids = np.concatenate([model.id_places(w) for _, w in parts])
            grams = [_Grams.of(ids, start, order, ordinary, text) for order in (1, 2, 3)]
        # counted in toxic texts at first, then in the sentences that hold a found segment
        is_toxic, unit = (y[text], text) if inside is None else (inside, sentence)
        n1 = float(y.sum()) if inside is None else float(max(1, len(np.unique(sentence[inside]))))
        s = None
        for g, order in zip(grams, (1, 2, 3)):
            one = is_toxic[g.at]
            y1 = _distinct(g.inverse[one], unit[g.at][one], len(g.keys))
            share = (g.y0 + y1 + 0.1) / (n0 + n1)
            if order == 1:
                sc = log_odds(y1, n1, g.y0, n0, share, 2.0, seeded[g.keys])
                model.word_score = np.where(seeded > 0, 2.0, 0.0)
                model.word_score[g.keys] = sc
                model.word_score[0] = min(model.word_score[0], 0.0)
                s = model.word_score[ids]
                longer_keys, longer_scores = [], []
                continue
            # what the shorter n-grams predict is the prior of the longer one
            if order == 2:
                lean = np.maximum(model.word_score[g.keys >> 20], model.word_score[g.keys & 0xFFFFF])
            else:
                lean = np.maximum(*(_lookup(longer_keys[0], longer_scores[0], k) for k in (g.keys >> 20, g.keys & 0xFFFFFFFFFF)))
            sc = log_odds(y1, n1, g.y0, n0, share, 1.0, lean)
            keep = (y1 + g.y0) >= least
            kept = keep[g.inverse]
            s[g.at[kept]] = sc[g.inverse[kept]]
            longer_keys.append(g.keys[keep])
            longer_scores.append(sc[keep])
        model.keys, model.scores = longer_keys, longer_scores
        s = s - DRIFT - JUMP * start
        best = best_segments(s, text, len(texts))
        _calibrate(model, best, sizes, y)
        if r + 1 < rounds:
            inside = _inside(s, text, sentence, y, best, model, sizes)
    return model


@dataclass
class _Grams:
    """The n-grams of all places: distinct keys, their number at each place, and in how many ordinary texts they occur."""

    at: np.ndarray
    keys: np.ndarray
    inverse: np.ndarray
    y0: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, start: np.ndarray, order: int, ordinary: np.ndarray, text: np.ndarray) -> _Grams:
        at, grams = (np.arange(len(ids)), ids) if order == 1 else ngrams(ids, start, order)
        keys, inverse = np.unique(grams, return_inverse=True)
        zero = ordinary[at]
        y0 = _distinct(inverse[zero], text[at][zero], len(keys))
        return cls(at.astype(np.int32), keys, inverse.astype(np.int32), y0)


#: Taken from every word's score, and from the first word of a sentence: ordinary text drifts down.
DRIFT, JUMP = 0.3, 1.0


def _distinct(gram: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """In how many units each n-gram occurs."""
    if not len(gram):
        return np.zeros(n)
    pairs = np.sort(gram.astype(np.int64) * (int(unit.max()) + 1) + unit)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    return np.bincount(pairs // (int(unit.max()) + 1), minlength=n).astype(float)


def _lookup(keys: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[k] == wanted, scores[k], 0.0)


def _masks(vocabulary: list[str], score: np.ndarray) -> dict[str, int]:
    """First and last letter of a masked word, and the worst word that has them."""
    out: dict[str, int] = {}
    for i in np.argsort(score).tolist():
        w = vocabulary[i]
        if score[i] > 1 and len(w) >= 4 and w.isalpha() and w < "⺀":
            out[f"{w[0]}*{w[-1]}"] = i
            out[f"{w[0]}*"] = i
    return out


def _calibrate(model: ToxicModel, best: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> None:
    """Extreme-value law of the best segment of ordinary texts: P(S > x) = 1 - exp(-K n exp(-rate x)).

    Few ordinary texts have a segment at all; its scale and location come from the lower part of those
    segments, because wrongly labelled texts make up the upper tenth.
    """
    plain = ~y & (sizes > 0) & (best > 0)
    if plain.sum() < 20:
        model.rate, model.log_k = 1.0, -1.0
        return
    total = float((~y & (sizes > 0)).sum())
    q1, q2 = np.quantile(best[plain], [0.3, 0.75])
    # survival at both points among all ordinary texts, which the law makes exponential in the tail
    s1, s2 = 0.7 * plain.sum() / total, 0.25 * plain.sum() / total
    model.rate = float(np.clip(np.log(s1 / s2) / max(q2 - q1, 1e-6), 0.5, 3.0))
    mean_log_n = float(np.log(np.maximum(sizes[~y & (sizes > 0)], 1)).mean())
    model.log_k = float(np.log(-np.log1p(-min(s1, 0.99))) + model.rate * q1 - mean_log_n)


def _best_cut(chance: np.ndarray, y: np.ndarray) -> float:
    """Where the found texts agree best with the reviews (F1)."""
    order = np.argsort(chance, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    here, after = chance[order][k], chance[order][min(k + 1, len(order) - 1)]
    return float(min(LOG_CHANCE, (here + after) / 2))


@lru_cache(maxsize=500_000)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def in_second_half(text: str) -> bool:
    """Which half a reviewed text belongs to: by the least hash of its runs of five words, so copies and most near copies share one."""
    h = np.fromiter(map(_word_hash, regex.findall(r"\p{L}+", text.lower())), np.uint64)
    h = np.concatenate([h, np.zeros(max(0, 5 - len(h)), np.uint64)])
    runs = np.zeros(len(h) - 4, np.uint64)
    for k in range(5):  # a rolling product, in which the order of words counts
        runs = (runs + h[k : len(h) - 4 + k]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return bool(int(runs.min()) >> 7 & 1)


def held_out(texts: list[str], toxic: list[bool], least: int = LEAST, seed_words: Sequence[str] = ()) -> np.ndarray | None:
    """Log chance of every text by a model of the half that the text doesn't belong to; None if a half has few toxic texts."""
    y, second = np.array(toxic, bool), np.fromiter(map(in_second_half, texts), bool, len(texts))
    if min(y[second].sum(), y[~second].sum()) < 20:
        return None
    out = np.zeros(len(texts))
    for side in (True, False):
        model = fit([t for t, s in zip(texts, second) if s != side], y[second != side].tolist(), least, seed_words=seed_words)
        rest = [t for t, s in zip(texts, second) if s == side]
        out[second == side] = np.concatenate([-np.log(10) * score_block(model, rest[a:b])[0] for a, b in bpe.blocks(rest)])
    return out


def fit_with_cut(texts: list[str], toxic: list[bool], least: int = LEAST, seed_words: Sequence[str] = ()) -> ToxicModel:
    """The model of all reviewed texts, with the cut that is best for the texts when each is scored by a model of the other half.

    With fewer than 20 toxic texts in a half the cut stays ``LOG_CHANCE``; that holds for the fit alone.
    """
    model = fit(texts, toxic, least, seed_words=seed_words)
    tried = held_out(texts, toxic, least, seed_words)
    if tried is not None:
        model.log_chance = _best_cut(tried, np.array(toxic, bool))
    return model


def log_chance(model: ToxicModel, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the chance that an ordinary text of that size has so good a segment."""
    log_e = model.log_k + np.log(np.maximum(sizes, 1)) - model.rate * best
    e = np.exp(np.clip(log_e, -700, 50))
    return np.where(log_e < -20, log_e, np.log(np.maximum(-np.expm1(-e), 1e-300)))


def _inside(s: np.ndarray, text: np.ndarray, sentence: np.ndarray, y: np.ndarray, best: np.ndarray, model: ToxicModel, sizes: np.ndarray) -> np.ndarray:
    """Places in sentences of toxic texts that a significant segment touches."""
    chance = log_chance(model, best, sizes)
    # so rare that chance would give less than one such segment in all reviewed texts
    hot = np.flatnonzero(y & (chance <= -np.log(len(y))))
    first = np.searchsorted(text, hot)
    last = np.searchsorted(text, hot, "right")
    touched = np.zeros(int(sentence[-1]) + 1, bool)
    for a, b, t in zip(first.tolist(), last.tolist(), hot.tolist()):
        segments = maximal_segments(s[a:b].tolist())
        for u, v, total in segments:
            if total >= 0.5 * best[t]:
                touched[sentence[a + u : a + v]] = True
    return touched[sentence] & y[text]


# --- scoring -----------------------------------------------------------------------------------------


def score_block(model: ToxicModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """(score, toxic, character ranges of the passages) of each text; the score is -log10 of the chance."""
    words = cut_words(texts)
    ids = model.id_places(words) if len(words.codes) else words.codes
    s = model.place_scores(words, ids) - DRIFT - JUMP * words.sentence_start if len(ids) else np.zeros(0)
    best = best_segments(s, words.text, len(texts))
    sizes = np.bincount(words.text, minlength=len(texts)) if len(ids) else np.zeros(len(texts), int)
    chance = np.where(best > 0, log_chance(model, best, sizes), 0.0)
    toxic = (best > 0) & (chance <= model.log_chance)
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    hot = np.flatnonzero(toxic)
    first, last = np.searchsorted(words.text, hot), np.searchsorted(words.text, hot, "right")
    for a, b, t in zip(first.tolist(), last.tolist(), hot.tolist()):
        for u, v, total in maximal_segments(s[a:b].tolist()):
            if log_chance(model, np.array([total]), sizes[t : t + 1])[0] <= model.log_chance:
                ranges[t].append((int(words.begin[a + u]), int(words.end[a + v - 1])))
    return -chance / np.log(10), toxic, ranges


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("toxic", T.BooleanType()), T.StructField("passages", T.IntegerType()),
])


def fit_reviewed(docs: DataFrame, labels: DataFrame, max_reviewed: int = MAX_REVIEWED, max_chars: int = MAX_CHARS, seed_words: Sequence[str] = ()) -> ToxicModel:
    """The model of at most ``max_reviewed`` reviewed documents of at most ``max_chars`` characters each (and about
    ``MAX_TOTAL_CHARS`` together), taken in hash order of their ids. One task on an executor fits it, so the driver holds the finished scores alone."""
    votes = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    sample = votes.filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).alias("is_toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_reviewed)
    # the sample is bounded by the limit above
    rows = docs.select("doc_id", "text").filter((F.col("text") != "") & (F.length("text") <= max_chars)).join(F.broadcast(sample), "doc_id")

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:  # read to the end, kept up to the bound
            if total < MAX_TOTAL_CHARS:
                held.append(batch)
                total += pc.sum(pc.utf8_length(batch["text"])).as_py() or 0
        data = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")]) if held else None
        model = fit_with_cut(data["text"].to_pylist(), data["is_toxic"].to_pylist(), seed_words=seed_words) if data is not None else fit([], [], seed_words=seed_words)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(fit_all, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], [], seed_words=seed_words)  # noqa: S301  made just above


def toxic_scores(docs: DataFrame, labels: DataFrame, max_reviewed: int = MAX_REVIEWED, seed_words: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, score, toxic, passages) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit_reviewed(docs, labels, max_reviewed, seed_words=seed_words))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in bpe.blocks(texts):
                points, toxic, ranges = score_block(model, texts[a:b])
                passages = pa.array([len(r) for r in ranges], pa.int32())
                head = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.round(points, 6)), pa.array(toxic), passages], SCHEMA.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(score, SCHEMA)


def source_rates(scored: DataFrame) -> DataFrame:
    """(source, docs, toxic_docs, rate)."""
    per = scored.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("toxic").alias("toxic_docs"))
    return per.withColumn("rate", F.round(F.col("toxic_docs") / F.col("docs"), 6))
