"""Ranked full-text search: BM25 over title, body and tags, phrases, prefixes and Boolean queries.

Notes are cut, folded and stemmed once, into postings: (term, path, dl, at), where ``at`` lists the places of
the term in the note and ``dl`` is the note's length in terms. Postings lie in parts by the hash of the term,
sorted by term, so a query reads the parts of its own terms alone; a prefix reads the row groups that may hold
it. The empty term has a row for each note, from which the totals come. A query is parsed on the driver, its
words are cut and folded by the very expression that cuts the notes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("title", "body", "tags")
#: Places count from field * FIELD on, so no phrase runs from one field into the next.
FIELD = 1 << 32
SPLIT = r"[^\p{L}\p{N}\p{Co}]+"
POSTINGS = "term string, path string, dl int, at array<bigint>"
PARTS = 32


@lru_cache(maxsize=1)
def marked_letters() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, and their plain letters; the final sigma with the other one."""
    marked, bare = "ς", "σ"
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if chr(cp).islower() and len(parts) == 2 and parts[0].isascii():
            marked, bare = marked + chr(cp), bare + parts[0]
    return marked, bare


def folded(c: Column | str) -> Column:
    col = F.lower(F.col(c) if isinstance(c, str) else c)
    # plain ASCII needs no folding, which looks up every sign
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(F.translate(F.regexp_replace(col, r"[\x{300}-\x{36F}]+", ""), *marked_letters()))


def tokens(c: Column | str) -> Column:
    """Lower-case letter and digit runs without accents, unstemmed. Vowel signs of Indic scripts part them."""
    col = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.array_remove(F.split(folded(col), SPLIT), "")


@lru_cache(maxsize=4096)
def plain_tokens(text: str) -> tuple[str, ...]:
    """``tokens`` of a query's text: the same expression, over one local row."""
    spark = SparkSession.active()
    return tuple(spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("t")).first()["t"])


class QueryError(ValueError):
    """The text isn't a valid search expression."""


# --- expressions ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    """Words in a row, perhaps only in some fields; ``prefixes`` numbers those that only begin a word; ``first`` wants it at a field's start."""

    words: tuple[str, ...]
    prefixes: tuple[int, ...] = ()
    fields: tuple[str, ...] = FIELDS
    first: bool = False
    no: int = 0  # repeated phrases count each


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object


@dataclass
class _Parser:
    text: str
    pos: int = 0
    items: list = field(default_factory=list)
    phrases: int = 0

    LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:+*^,])|(-)|([^\s"(){}:+*^,\-]+))')

    def lex(self) -> None:
        at = 0
        while at < len(self.text):
            m = self.LEX.match(self.text, at)
            if not m:
                if self.text[at:].strip():
                    raise QueryError(f"unexpected sign at {at}")
                break
            quoted, sign, minus, word = m.groups()
            if quoted is not None:
                self.items.append(("str", quoted.replace('""', '"')))
            elif sign:
                self.items.append((sign, sign))
            elif minus:
                self.items.append(("-", "-"))
            else:
                self.items.append(("word", word))
            at = m.end()

    def peek(self) -> tuple[str, str]:
        return self.items[self.pos] if self.pos < len(self.items) else ("end", "")

    def take(self, kind: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if kind and item[0] != kind:
            raise QueryError(f"expected {kind}, found {item[1] or 'the end'}")
        self.pos += 1
        return item

    def expression(self) -> object:
        self.lex()
        if not self.items:
            raise QueryError("empty")
        out = self.either()
        self.take("end")
        return out

    def either(self) -> object:
        out = self.both()
        while self.peek() == ("word", "OR"):
            self.take()
            out = Node("or", out, self.both())
        return out

    def both(self) -> object:
        out = self.negated()
        while self.peek() == ("word", "AND"):
            self.take()
            out = Node("and", out, self.negated())
        return out

    def negated(self) -> object:
        out = self.row()
        while self.peek() == ("word", "NOT"):
            self.take()
            out = Node("not", out, self.row())
        return out

    def row(self) -> object:
        out = self.unit()
        while self.peek()[0] in ("str", "(", "{", "^", "-") or (self.peek()[0] == "word" and self.peek()[1] not in ("AND", "OR", "NOT")):
            out = Node("and", out, self.unit())
        return out

    def unit(self) -> object:
        kind, value = self.peek()
        if kind == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        if kind == "word" and value in ("AND", "OR", "NOT"):
            raise QueryError(f"{value} lacks a side")
        names = self.columns()
        if names is not None:
            return _within(self.unit(), names)
        if kind == "word" and value == "NEAR" and self.pos + 1 < len(self.items) and self.items[self.pos + 1][0] == "(":
            self.take()
            self.take()
            phrases = []
            while self.peek()[0] in ("str", "word", "^"):
                phrases.append(self.phrase())
            distance = 10
            if self.peek()[0] == ",":
                self.take()
                distance = int(self.take("word")[1]) if self.peek()[1].isdigit() else self._fail()
            self.take(")")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def columns(self) -> tuple[str, ...] | None:
        """``name:``, ``{name name}:`` and, for all but these, ``-name:``; None, and nothing taken, if none stands here."""
        begin = self.pos
        others = self.peek()[0] == "-"
        if others:
            self.take()
        names: list[str] = []
        if self.peek()[0] == "{":
            self.take()
            while self.peek()[0] in ("word", "str"):
                names.append(self.take()[1])
            self.take("}")
        elif self.peek()[0] in ("word", "str"):
            names.append(self.take()[1])
        if not names or self.peek()[0] != ":":
            if others or self.items[begin : begin + 1] == [("{", "{")]:
                raise QueryError("a column filter ends with a colon")
            self.pos = begin
            return None
        self.take()
        for n in names:
            if n.lower() not in FIELDS:
                raise QueryError(f"no such column: {n}")
        named = {n.lower() for n in names}
        return tuple(f for f in FIELDS if (f in named) != others)

    def _fail(self) -> int:
        raise QueryError("a distance is a number")

    def phrase(self) -> Phrase:
        first = self.peek()[0] == "^"
        if first:
            self.take()
        words: list[str] = []
        prefixes: list[int] = []
        while True:
            words += self._string()
            if self.peek()[0] == "*":
                self.take()
                prefixes.append(len(words) - 1)
            if self.peek()[0] != "+":
                break
            self.take()
        self.phrases += 1
        return Phrase(tuple(words), tuple(prefixes), FIELDS, first, self.phrases)

    def _string(self) -> list[str]:
        kind, value = self.take()
        if kind not in ("str", "word"):
            raise QueryError(f"unexpected {value or 'end'}")
        if kind == "word" and not re.fullmatch(r"\w+", value):
            raise QueryError(f"{value} must be quoted")
        from ..functions.text import porter

        return [porter(w) for w in plain_tokens(value)]


def _within(node: object, names: tuple[str, ...]) -> object:
    if isinstance(node, Phrase):
        return replace(node, fields=tuple(f for f in node.fields if f in names))
    if isinstance(node, Near):
        return Near(tuple(_within(p, names) for p in node.phrases), node.distance)
    return Node(node.op, _within(node.left, names), _within(node.right, names))


def match_expression(query: str) -> str:
    """What a typed query stands for: raw if it uses operators, else each longer word quoted and all required."""
    if re.search(r'["+*(){}]', query) or re.search(r"\b(?:AND|OR|NOT|NEAR)\b", query):
        return query
    long = [t for t in query.split() if len(t.encode()) > 1]
    return " ".join(f'"{t}"' for t in long) if long else f'"{query}"'


def parse_query(query: str) -> object:
    return _Parser(match_expression(query)).expression()


def phrases_of(node: object) -> list[Phrase]:
    """All phrases with a word, those that must not match included."""
    if isinstance(node, Phrase):
        return [node] if node.words else []
    if isinstance(node, Near):
        return [p for p in node.phrases if p.words]
    return phrases_of(node.left) + phrases_of(node.right)


# --- postings ------------------------------------------------------------------------------------------


#: Words of a block of notes that is counted at once; bounds the memory of the array work. A longer note is its own block.
BLOCK_WORDS = 2_000_000


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``BLOCK_WORDS`` words."""
    upto = np.cumsum(sum(np.diff(batch.column(k + 1).offsets.to_numpy()) for k in range(len(FIELDS))))
    begin = 0
    while begin < batch.num_rows:
        held = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, held + BLOCK_WORDS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch):
            yield from _block_postings(block)


def _block_postings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    from ..functions.text import porter

    n, paths = batch.num_rows, batch.column(0)
    words, docs, at = [], [], []
    for k in range(len(FIELDS)):
        flat, lens = batch.column(k + 1).flatten(), np.diff(batch.column(k + 1).offsets.to_numpy())
        words.append(flat)
        docs.append(np.repeat(np.arange(n), lens))
        at.append(np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) + k * FIELD)
    doc, place = np.concatenate(docs), np.concatenate(at)
    coded = pa.concat_arrays(words).dictionary_encode()
    terms: dict[str, int] = {}
    stem_of = np.fromiter((terms.setdefault(porter(w), len(terms)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    dl = np.bincount(doc, minlength=n).astype(np.int32)
    empty = pa.ListArray.from_arrays(np.zeros(n + 1, np.int32), pa.array([], pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([""] * n, pa.string()), paths, pa.array(dl), empty], ["term", "path", "dl", "at"])
    if len(doc):
        key = doc * len(terms) + stem_of[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(key, kind="stable")  # a term's places in a note stay in order
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        d, t = key[first] // len(terms), key[first] % len(terms)
        lists = pa.ListArray.from_arrays(np.append(first, len(key)).astype(np.int32), pa.array(place[order]))
        yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()).take(pa.array(t)), paths.take(pa.array(d)), pa.array(dl[d]), lists], ["term", "path", "dl", "at"])


def postings_of(notes: DataFrame) -> DataFrame:
    """Postings of notes (path, title, body, tags), one pass over the texts without a shuffle."""
    return notes.select("path", *(tokens(f).alias(f) for f in FIELDS)).mapInArrow(_postings, POSTINGS)


def part_of(term: Column | str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


@dataclass
class FullText:
    """``read(parts)`` gives the postings in those parts (None: in all); ``notes`` are (path, title, body, tags)."""

    notes: DataFrame
    read: Callable[[list[int] | None], DataFrame]
    parts: int = PARTS

    @classmethod
    def of(cls, notes: DataFrame, scratch: Scratch | None = None, parts: int = PARTS) -> FullText:
        """An index of notes at hand, kept in the scratch folder."""
        spark = notes.sparkSession
        scratch = scratch or Scratch(spark, "fulltext")
        rows = postings_of(notes).withColumn("part", part_of("term", parts)).hint("rebalance", F.col("part")).sortWithinPartitions("part", "term")
        path = scratch.partitioned(rows, "postings", "part")
        return cls(notes, lambda wanted: spark.read.schema(POSTINGS + ", part int").parquet(path).filter(F.lit(True) if wanted is None else F.col("part").isin(wanted)), parts)

    def parts_of(self, terms: list[str]) -> list[int]:
        local = self.notes.sparkSession.createDataFrame([(t,) for t in terms], "t string")
        return sorted({r[0] for r in local.select(part_of("t", self.parts)).collect()})

    def terms(self, words: list[str], prefixes: list[str]) -> DataFrame:
        """Postings of the words and of all terms that begin with a prefix."""
        rows = self.read(None if prefixes else self.parts_of(words))
        hit = F.col("term").isin(words) if words else F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith("term", F.lit(p))
        return rows.filter(hit & (F.col("term") != ""))

    def totals(self) -> DataFrame:
        """One row: N, avgdl."""
        docs = self.read(self.parts_of([""])).filter("term = ''")
        return docs.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequency(index: FullText) -> DataFrame:
    """(term, notes) of every term."""
    return index.read(None).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("notes"))


# --- evaluation ----------------------------------------------------------------------------------------


def _slot(phrase: Phrase, k: int) -> tuple[str, bool]:
    return phrase.words[k], k in phrase.prefixes


def _tally(index: FullText, phrases: list[Phrase]) -> tuple[DataFrame, dict[Phrase, str]]:
    """(path, dl, p0, p1, ...) of every note with any of the phrases' words: where each phrase begins."""
    slots = list(dict.fromkeys(_slot(p, k) for p in phrases for k in range(len(p.words))))
    rows = index.terms([w for w, begins in slots if not begins], [w for w, begins in slots if begins])
    held = []
    for i, (w, begins) in enumerate(slots):
        hit = F.startswith("term", F.lit(w)) if begins else F.col("term") == w
        # a word has one row a note, a prefix a few
        held.append(F.array_sort(F.flatten(F.collect_list(F.when(hit, F.col("at"))))).alias(f"w{i}"))
    tok = rows.groupBy("path").agg(F.max("dl").alias("dl"), *held)
    name = {p: f"p{i}" for i, p in enumerate(phrases)}
    number = {s: i for i, s in enumerate(slots)}
    for p, n in name.items():
        at = F.col(f"w{number[_slot(p, 0)]}")
        for k in range(1, len(p.words)):
            at = F.array_intersect(at, _shifted(F.col(f"w{number[_slot(p, k)]}"), k))
        if p.fields != FIELDS:
            at = _in_fields(at, p.fields)
        if p.first:
            at = F.filter(at, lambda x: x.bitwiseAND(FIELD - 1) == 0)
        tok = tok.withColumn(n, at)
    return tok, name


def _shifted(at: Column, k: int) -> Column:
    return F.transform(at, lambda x: x - k)


def _in_fields(at: Column, names: tuple[str, ...]) -> Column:
    return F.filter(at, lambda x: F.shiftright(x, 32).isin([FIELDS.index(f) for f in names]) if names else F.lit(False))


def _stands(at: Column, last: Column, reach: int) -> Column:
    """Whether any place lies at most ``reach`` before the last one."""
    return F.exists(at, lambda s: (s <= last) & (s >= last - reach))


def _standing(at: Column, reach: int) -> Column:
    return F.filter(at, lambda s: F.exists("_last", lambda m: (s <= m) & (s >= m - reach)))


def _near(tok: DataFrame, node: object, name: dict[Phrase, str]) -> DataFrame:
    """The phrases of NEAR groups keep only the places that stand together.

    Phrases stand together if each ends no more than the distance before the last of them begins.
    """
    if isinstance(node, Node):
        return _near(_near(tok, node.left, name), node.right, name)
    if not isinstance(node, Near) or len(node.phrases) < 2 or not all(p.words for p in node.phrases):
        return tok
    cols = [(F.col(name[p]), len(p.words) + node.distance) for p in node.phrases]
    last = F.array_sort(F.array_distinct(F.concat(*(c for c, _ in cols))))
    tok = tok.withColumn("_last", F.filter(last, lambda m: _all(_stands(c, m, r) for c, r in cols)))
    for p, (c, r) in zip(node.phrases, cols):
        tok = tok.withColumn(name[p], _standing(c, r))
    return tok.drop("_last")


def _all(conditions: Iterator[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _holds(node: object, name: dict[Phrase, str]) -> Column:
    if isinstance(node, Phrase):
        return F.size(name[node]) > 0 if node.words else F.lit(False)
    if isinstance(node, Near):
        return _all(F.size(name[p]) > 0 if p.words else F.lit(False) for p in node.phrases) if node.phrases else F.lit(False)
    left, right = _holds(node.left, name), _holds(node.right, name)
    return {"and": left & right, "or": left | right, "not": left & ~right}[node.op]


def with_tag(df: DataFrame, tag: str | None) -> DataFrame:
    """Rows whose joined tags contain the text, whatever its case: ``art`` also finds ``party``; ``_`` and ``%`` are wildcards."""
    return df.filter(F.ilike("tags", F.lit("%" + tag.replace("\\", "\\\\") + "%"))) if tag else df


def below(df: DataFrame, prefix: str | None) -> DataFrame:
    """Rows whose path begins with the text, whatever its case; ``_`` and ``%`` are wildcards."""
    return df.filter(F.ilike("path", F.lit(prefix.replace("\\", "\\\\") + "%"))) if prefix else df


def _nothing(index: FullText) -> DataFrame:
    return index.notes.filter(F.lit(False)).select("path", "title", "tags", F.lit(0.0).alias("rank"))


def as_index(notes: DataFrame | FullText) -> FullText:
    return notes if isinstance(notes, FullText) else FullText.of(notes)


def bm25(notes: DataFrame | FullText, query: str, limit: int | None = 10, tag: str | None = None, prefix: str | None = None) -> DataFrame:
    """(path, title, tags, rank): best matches first, lower rank is better; raises QueryError on bad syntax."""
    index, node = as_index(notes), parse_query(query)
    phrases = phrases_of(node)
    if not phrases:  # no word at all matches nothing
        return _nothing(index)
    tok, name = _tally(index, phrases)
    # document frequencies count all notes with a phrase; filters and NEAR only narrow the result
    counts = tok.agg(*(F.count_if(F.size(c) > 0).alias(f"d{c}") for c in name.values())).select(F.struct("*").alias("c")).scalar()
    totals = index.totals().select(F.struct("*").alias("t")).scalar()
    hits = below(_near(tok, node, name).filter(_holds(node, name)), prefix).withColumn("c", counts).withColumn("t", totals)
    score = F.lit(0.0)
    for c in name.values():
        n = F.col(f"c.d{c}")
        idf = F.log((F.col("t.N") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        tf = F.size(c).cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("t.avgdl")))
    # rounded so that the order of equal ranks doesn't hang on the order of a sum
    hits = hits.select("path", F.round(-score, 9).alias("rank"))
    shown = index.notes.select("path", "title", "tags")
    if limit is None:
        return with_tag(hits.join(shown, "path"), tag).select("path", "title", "tags", "rank")
    if tag:
        hits = hits.join(with_tag(shown, tag), "path", "left_semi")
    best = hits.orderBy("rank", "path").limit(limit)  # ``limit`` rows
    return shown.join(F.broadcast(best), "path").select("path", "title", "tags", "rank").orderBy("rank", "path")


def matches(notes: DataFrame | FullText, query: str, tag: str | None = None, prefix: str | None = None) -> DataFrame:
    """(path) of all notes that satisfy the expression, unranked."""
    index, node = as_index(notes), parse_query(query)
    phrases = phrases_of(node)
    if not phrases:
        return _nothing(index).select("path")
    tok, name = _tally(index, phrases)
    hits = below(_near(tok, node, name).filter(_holds(node, name)), prefix).select("path")
    return hits.join(with_tag(index.notes.select("path", "tags"), tag), "path", "left_semi") if tag else hits


def like_search(notes: DataFrame, query: str, limit: int | None = 10, tag: str | None = None, prefix: str | None = None) -> DataFrame:
    """(path, title, tags, rank): title or body holds the text, rank 0; ``limit`` takes the first paths."""
    q = F.lower(F.lit(query))
    hit = F.coalesce(F.contains(F.lower("title"), q), F.lit(False)) | F.coalesce(F.contains(F.lower("body"), q), F.lit(False))
    out = below(with_tag(notes.filter(hit), tag), prefix).select("path", "title", "tags", F.lit(0.0).alias("rank"))
    return out.orderBy("path").limit(limit) if limit is not None else out


def search(notes: DataFrame | FullText, query: str, limit: int = 10, tag: str | None = None, prefix: str | None = None, snippets: bool = True) -> DataFrame:
    """Ranked search; falls back to plain containment if the query isn't valid. Adds (snippet)."""
    limit = limit if limit > 0 else 10
    index = as_index(notes)
    try:
        node = parse_query(query)
        hits = bm25(index, query, limit, tag, prefix)
        words = sorted({_slot(p, k) for p in phrases_of(node) for k in range(len(p.words))})
    except QueryError:
        hits, words = like_search(index.notes, query, limit, tag, prefix), []
    if not snippets:
        return hits
    from ..functions.text import snippet

    bodies = index.notes.select("path", "body").join(F.broadcast(hits), "path")  # at most ``limit`` rows
    shown = snippet("body", words) if words else F.substring("body", 1, 200)
    return bodies.select("path", "title", shown.alias("snippet"), "tags", "rank").orderBy("rank", "path")
