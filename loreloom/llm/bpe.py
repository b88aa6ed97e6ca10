"""Corpus encoding with a public byte-level BPE, by speculation and verification.

Every distinct pre-token of a block of texts is first cut by greedy longest match. A proposal is the
BPE encoding exactly if each pair of neighbouring tokens is *compatible*, that is, if merging the
pair's bytes alone gives back the same two tokens; so all neighbouring pairs of a block are tested at
once by binary search in a sorted array of known pairs. Only words with an incompatible pair go through exact merging.

Defined results: a null or empty text gives an empty list; strings that look like special tokens are
ordinary text; texts of any length are encoded whole (work is cut into blocks between texts, and a
text longer than a block is its own block).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie; override with the environment or the argument of each operator.
VOCABULARY = os.environ.get("LORELOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

#: Characters of a block of texts that is encoded at once; bounds the memory of the array work.
BLOCK_CHARS = 1 << 20
#: Bounds of the per-process caches; they restart when full, which costs time only.
CACHE_WORDS, CACHE_PAIRS = 400_000, 1_000_000

SPACE, BLANK, LETTER, NUMBER, OTHER = range(5)
# White_Space of Unicode, fixed by the standard.
WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, as the pre-tokenizer's pattern divides them."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name, value in (("L", LETTER), ("N", NUMBER)):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = value
    table[list(WHITE)] = BLANK
    table[32] = SPACE
    return table


def pretoken_starts(cps: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern begins a new match, for all texts of a block at once.

    The pattern is: contraction | optional blank + letters | optional blank + numbers |
    optional blank + others | white space up to the last before a word | white space.
    """
    n = len(cps)
    cls = char_classes()[cps]
    kind = np.maximum(cls, 1)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= doc_start
    # a white-space run before a word gives up its last sign: a blank joins the word, others stand alone
    words = np.flatnonzero(start & (kind != BLANK) & ~doc_start)
    words = words[kind[words - 1] == BLANK]
    start[words - 1] = True
    start[words[cls[words - 1] == SPACE]] = False
    # contractions are matched before anything else, but only where a match begins
    quotes = np.flatnonzero(start & (cps == 39))
    if len(quotes):
        pad = np.zeros(2, cps.dtype)
        c = np.concatenate([cps, pad])
        new = np.concatenate([doc_start, np.ones(2, bool)])
        a, b = c[quotes + 1], c[quotes + 2]
        one = ~new[quotes + 1] & np.isin(a, [115, 116, 109, 100])  # s t m d
        two = ~new[quotes + 1] & ~new[quotes + 2] & (
            ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        )
        start[quotes[one | two] + 1] = False
        start[quotes[two] + 2] = False
        ends = np.concatenate([quotes[one] + 2, quotes[two] + 3])
        start[ends[ends < n]] |= cls[ends[ends < n]] >= LETTER
        # white space after a contraction keeps the starts computed above
    return start


class SpeculativeBpe:
    """Word-level encoder: longest match, pair check, exact merging for the rest."""

    def __init__(self, vocabulary: bytes | None = None):
        lines = (vocabulary if vocabulary is not None else read_vocabulary()).splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._reset_words()
        self._reset_pairs()

    def _reset_words(self) -> None:
        self.words: dict[bytes, np.ndarray] = {}

    def _reset_pairs(self) -> None:
        # keys of the known pairs in order, with their verdicts
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ranks, out, i, n = self.ranks, [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (r := ranks.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the lowest-ranked, leftmost pair; O(n log n)."""
        ranks, n = self.ranks, len(word)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = nxt[i]
            if j >= n or end[j] != e:
                continue
            end[i], alive[j], nxt[i] = e, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                k = nxt[j]
                if (r := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if prv[i] >= 0:
                k = prv[i]
                if (r := ranks.get(word[k : end[i]])) is not None:
                    heapq.heappush(heap, (r, k, end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = nxt[i]
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (first token << 20 | second), given in order and once, stays as it is when its bytes are merged alone.

        All are looked up at once among the known pairs; only pairs never seen before are merged.
        """
        at = np.searchsorted(self.pair_keys, keys)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == keys[known]
        fits = np.zeros(len(keys), bool)
        fits[known] = self.pair_fits[at[known]]
        new = keys[~known]
        if len(new):
            left, right = (new >> 20).tolist(), (new & 0xFFFFF).tolist()
            fits[~known] = np.fromiter((self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b] for a, b in zip(left, right)), bool, len(new))
            if len(self.pair_keys) + len(new) > CACHE_PAIRS:
                self._reset_pairs()
                at, new, verdicts = np.zeros(len(keys), np.int64), keys, fits
            else:
                at, verdicts = at[~known], fits[~known]
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, at, new), np.insert(self.pair_fits, at, verdicts)
        return fits

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; new words are proposed one by one and verified together."""
        known = self.words
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                self._reset_words()
                known, new = self.words, words
            self._verify(new, known)
        return [known[w] for w in words]

    def _verify(self, new: list[bytes], known: dict[bytes, np.ndarray]) -> None:
        whole = self.ranks.get
        several = []
        for w in new:
            r = whole(w)
            if r is None:
                several.append(w)
            else:
                known[w] = np.array([r], np.int32)
        if not several:
            return
        proposals = [self.propose(w) for w in several]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(several)), lengths)
        inside = owner[1:] == owner[:-1]
        keys, back = np.unique(((flat[:-1] << 20) | flat[1:])[inside], return_inverse=True)
        failed = set(owner[1:][inside][~self.compatible(keys)[back]].tolist())
        for i, (w, p) in enumerate(zip(several, proposals)):
            known[w] = np.array(self.merge(w) if i in failed else p, np.int32)

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end offset of each)."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        doc_start = np.zeros(len(cps), bool)
        doc_start[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(pretoken_starts(cps, doc_start))
        width = 1 + (cps >= 0x80) + (cps >= 0x800).astype(np.int8) + (cps >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        offsets = byte_at[np.append(at, len(cps))].astype(np.int32)
        raw = joined.encode("utf-8", "surrogatepass")
        array = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = array.dictionary_encode()
        ids_of = self.encode_words(coded.dictionary.to_pylist())
        lens = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
        store = np.concatenate(ids_of)
        first = np.cumsum(lens) - lens
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = lens[codes]
        upto = np.cumsum(n)
        flat = store[np.repeat(first[codes] - (upto - n), n) + np.arange(int(upto[-1]))]
        before = np.concatenate([[0], upto])
        return flat, before[np.searchsorted(at, ends)]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: Encoders of this process by their vocabulary's digest; two at most.
_ENCODERS: dict[str, SpeculativeBpe] = {}


@dataclass
class SharedVocabulary:
    """A vocabulary file, read on the driver and sent along with the job: executors need no file of their own."""

    digest: str
    content: object  # a broadcast of the file's bytes, about a megabyte

    def encoder(self) -> SpeculativeBpe:
        found = _ENCODERS.get(self.digest)
        if found is None:
            if len(_ENCODERS) >= 2:
                _ENCODERS.clear()
            found = _ENCODERS[self.digest] = SpeculativeBpe(self.content.value)
        return found


def shared_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> SharedVocabulary:
    content = read_vocabulary(path)
    return SharedVocabulary(hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content))


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def _encoded(vocabulary: SharedVocabulary, batches: Iterator[pa.RecordBatch], lengths_only: bool) -> Iterator[pa.RecordBatch]:
    enc = vocabulary.encoder()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks(texts):
            ids, ends = enc.encode_block([t or "" for t in texts[a:b]])
            offsets = np.concatenate([[0], ends])
            if lengths_only:
                out = pa.array(np.diff(offsets))
            else:
                out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out], ["key", "out"])


def _mapped(df: DataFrame, key: str, text: str, path: str, lengths_only: bool, out: str) -> DataFrame:
    kind = T.LongType() if lengths_only else T.ArrayType(T.IntegerType())
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("out", kind)])
    shared = shared_vocabulary(df.sparkSession, path)
    return slim.mapInArrow(lambda it: _encoded(shared, it, lengths_only), schema).select(
        F.col("key").alias(key), F.col("out").alias(out)
    )


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, one row for each input row, without a shuffle."""
    return _mapped(df, key, text, path, False, "ids")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every text."""
    return _mapped(df, key, text, path, True, "n_tokens")
