"""Splitting oversized texts at natural boundaries.

A text's possible cuts are one sorted array of offsets with a rank each: heading, paragraph, line,
sentence, word. A piece ends at the last cut of the best rank under the limit, found by binary search
in the rank's own sorted offsets; the next piece steps back by the overlap and, by the same search,
forward again to the beginning of a word. Without any cut the piece is cut hard at the limit.

Lengths are characters, or tokens of the whole text's encoding (``measure="tokens"``). Either way the limit and
the overlap are steps in an array of prefix sums, the offset at which each unit begins: for characters the
offset itself, for tokens the running sum of their lengths.

Defined results: offsets count code points; null, empty and short texts give no pieces; in each piece at
most ``limit`` units begin; the pieces without their overlaps are the whole text; a piece starts ``overlap``
units before the end of the last one, or up to a quarter fewer (``LEAST_OVERLAP``) so as to begin at a word;
a text is ``hard`` if two neighbouring white-space offsets lie more than the limit apart, that is if a run
without white space is longer, wherever it stands. Only where the overlap would leave too little room for a
run that fits the limit is the overlap given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import skew_join
from . import bpe

LIMIT, OVERLAP = 4000, 200
#: A better-ranked cut is taken if it leaves the piece at least this share of the limit.
LEAST_SHARE = 0.5
#: An overlap shortened to begin at a word keeps at least this share of its length.
LEAST_OVERLAP = 0.75
RANKS = ("heading", "paragraph", "line", "sentence", "word")
# where a piece may end, best first; each match's end is the cut
CUTS = (
    regex.compile(r"(?:\r\n|\n|\r)(?=#{1,6}[ \t])"),
    regex.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*"),
    regex.compile(r"(?:\r\n|[\n\r\u2028\u2029])\s*"),
    regex.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?:\s+|(?<=[。！？]))"),
    regex.compile(r"\s+"),
)


class Boundaries:
    """Sorted cut offsets by rank, the offsets where words begin, and those where units begin (None: every character)."""

    def __init__(self, text: str, units: np.ndarray | None = None):
        self.n, self.units = len(text), units
        self.by_rank = [np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in CUTS[:-1]]
        spans = np.fromiter((i for m in CUTS[-1].finditer(text) for i in m.span()), np.int64).reshape(-1, 2)
        self.words = np.concatenate([[0] if text and not text[0].isspace() else [], spans[:, 1]]).astype(np.int64)
        # between words a cut may stand before, after and within the white space
        n = spans[:, 1] - spans[:, 0] + 1
        self.by_rank.append(np.repeat(spans[:, 0] - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
        ends = np.concatenate([[0], spans.ravel(), [self.n]])
        self.longest_run = int((ends[1::2] - ends[0::2]).max())

    def ahead(self, at: int, k: int) -> int:
        """The last offset that has no more than ``k`` units between ``at`` and it."""
        if self.units is None:
            return at + k
        i = int(np.searchsorted(self.units, at, "left")) + k
        return int(self.units[i]) if i < len(self.units) else self.n

    def behind(self, at: int, k: int) -> int:
        """The first offset that has no more than ``k`` units between it and ``at``."""
        if self.units is None:
            return at - k
        i = int(np.searchsorted(self.units, at, "left")) - k
        if i <= 0:
            return 0
        if i >= len(self.units):
            return at
        return min(at, int(self.units[i]) + int(self.units[i - 1] == self.units[i]))

    @staticmethod
    def last(offsets: np.ndarray, low: int, high: int) -> int | None:
        """The last offset in (low, high]."""
        k = int(np.searchsorted(offsets, high, "right")) - 1
        return int(offsets[k]) if k >= 0 and offsets[k] > low else None

    @staticmethod
    def first(offsets: np.ndarray, low: int, high: int) -> int | None:
        """The first offset in [low, high]."""
        k = int(np.searchsorted(offsets, low, "left"))
        return int(offsets[k]) if k < len(offsets) and offsets[k] <= high else None


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, units: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of each piece; the last piece's kind is ``end``."""
    return split_at(Boundaries(text, units), limit, overlap)


def split_at(b: Boundaries, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    pieces: list[tuple[int, int, str]] = []
    start = done = 0
    while True:
        high = b.ahead(start, limit)
        if high >= b.n:
            pieces.append((start, b.n, "end"))
            return pieces
        end, kind = None, "hard"
        for wish in (max(done, b.ahead(start, int(limit * LEAST_SHARE))), done):
            for rank, offsets in zip(RANKS, b.by_rank):
                cut = b.last(offsets, wish, high)
                if cut is not None:
                    end, kind = cut, rank
                    break
            if end is not None:
                break
        if end is None:
            # the overlap takes room that the next run of signs needs: begin at the run itself if that saves it
            reach = b.ahead(done, limit)
            if start < done and (b.first(b.by_rank[-1], done + 1, reach) is not None or b.n <= reach):
                start = done
                continue
            end = max(high, done + 1)  # a character that is several tokens by itself stays whole
        pieces.append((start, end, kind))
        done = end
        back = max(start + 1, b.behind(end, overlap))
        word = b.first(b.words, back, min(end, max(back, b.behind(end, ceil(overlap * LEAST_OVERLAP)))))
        start = back if word is None else word


def token_starts(encode: bpe.SpeculativeBpe, text: str) -> np.ndarray:
    """The character offset at which each token of the text begins: prefix sums of the tokens' lengths."""
    ids, _ = encode.encode_block([text])
    sizes = np.fromiter((len(encode.bytes_of[i]) for i in ids.tolist()), np.int64, len(ids))
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (cps >= 0x80) + (cps >= 0x800).astype(np.int8) + (cps >= 0x10000)
    # a token that begins within a character counts for that one
    return np.searchsorted(np.cumsum(width) - width, np.cumsum(sizes) - sizes, "right") - 1


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, vocabulary: object) -> Iterator[pa.RecordBatch]:
    encode = vocabulary.encoder() if vocabulary is not None else None
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        held = 0
        for key, text in zip(keys, texts):
            units = token_starts(encode, text) if encode else None
            if units is not None and len(units) <= limit:
                continue
            b = Boundaries(text, units)
            kind = "hard" if b.longest_run > limit else "soft"
            for k, (s, e, cut) in enumerate(split_at(b, limit, overlap)):
                n = e - s if units is None else int(np.diff(np.searchsorted(units, [s, e], "left"))[0])
                out.append((key, k, s, e, n, cut, kind, text[s:e]))
                held += e - s
            if held > 4_000_000:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], schema=ARROW)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], schema=ARROW)


NAMES = ("key", "piece_no", "start", "end", "units", "cut", "kind", "piece")
ARROW = pa.schema([("key", pa.string()), ("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("units", pa.int64()), ("cut", pa.string()), ("kind", pa.string()), ("piece", pa.string())])
SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("units", T.LongType()), T.StructField("cut", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("piece", T.StringType()),
])


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, measure: str = "characters", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(key, piece_no, start, end, units, cut, kind, piece) of every text longer than the limit; no shuffle of its own.

    ``measure`` is what limit and overlap count, ``characters`` or ``tokens`` of a byte-level vocabulary."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if measure not in ("characters", "tokens"):
        raise ValueError(f"no such measure: {measure}")
    shared = bpe.shared_vocabulary(df.sparkSession, vocabulary) if measure == "tokens" else None
    # a text has no more tokens than bytes
    size = F.length("text") if shared is None else F.octet_length("text")
    big = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter(size > limit)
    return big.mapInArrow(lambda it: _split(it, limit, overlap, shared), SCHEMA)


def note_pieces(notes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each path's current body. Only bodies over the limit are shuffled."""
    named = notes.filter(F.col("path").isNotNull())
    newest = named.groupBy("path").agg(F.max("mtime").alias("newest"))
    big = named.select("path", "mtime", "body").filter(F.length("body") > limit)
    current = skew_join(big, newest, "path").filter(F.col("mtime").eqNullSafe(F.col("newest")))
    # rows that tie are equal
    current = current.groupBy("path").agg(F.first("body").alias("body"))
    return split_oversized(current, "path", "body", limit, overlap).withColumnRenamed("key", "path")


def oversized_notes(notes: DataFrame) -> DataFrame:
    """p5_found: (path, kind), from the first piece of each split body."""
    return note_pieces(notes).filter("piece_no = 0").select("path", "kind")


def piece_checks(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(path, n_chars, pieces_over, gaps, overlaps_over, overlaps_short, hard_cuts_in_soft, text_hash) of each split text.

    The hash is that of the pieces joined without their overlaps. An overlap is short below ``LEAST_OVERLAP`` of the
    wanted one, unless more would have left no room for a run of signs that fits the limit. Pieces of one text meet
    in one task, which has held that text before.
    """
    per = pieces.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "cut", "kind", "piece"))).alias("p"))
    n = F.size("p")
    pair = lambda f: F.transform(F.sequence(F.lit(1), n - 1), lambda i: f(F.get("p", i - 1), F.get("p", i)))
    steps = F.when(n > 1, pair(lambda a, b: F.struct((a["end"] - b["start"]).alias("over"), F.substr(b["piece"], (a["end"] - b["start"] + 1).cast("int")).alias("rest"), (b["end"] - a["end"]).alias("new"))))
    per = per.withColumn("steps", F.coalesce(steps, F.array()))
    count = lambda c, f: F.size(F.filter(c, f))
    room = limit - int(overlap * LEAST_OVERLAP)
    return per.select(
        "path",
        F.get("p", n - 1)["end"].alias("n_chars"),
        count("p", lambda x: F.length(x["piece"]) > limit).alias("pieces_over"),
        (count("steps", lambda x: (x["over"] < 0) | (x["new"] < 1)) + F.when(F.get("p", F.lit(0))["start"] != 0, 1).otherwise(0)).alias("gaps"),
        count("steps", lambda x: x["over"] > overlap).alias("overlaps_over"),
        count("steps", lambda x: (x["over"] < ceil(overlap * LEAST_OVERLAP)) & ~F.regexp_extract(x["rest"], r"^\s*\S*", 0).rlike(f"(?s)^.{{{room},}}")).alias("overlaps_short"),
        count("p", lambda x: (x["cut"] == "hard") & (x["kind"] == "soft")).alias("hard_cuts_in_soft"),
        F.sha2(F.concat(F.get("p", F.lit(0))["piece"], F.array_join(F.transform("steps", lambda x: x["rest"]), "")), 256).alias("text_hash"),
    )
