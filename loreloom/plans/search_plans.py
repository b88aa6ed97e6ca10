"""Full-text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STEP2, STEP3, STEP4
from ..operators import corpus, search
from ..runtime import table
from ..storage import Files
from .sql import CUR

TERMS, TAG, PREFIX = ("budget", "shared"), "re", "2-Areas/"


def notes_of(spark: SparkSession, d: str) -> DataFrame:
    return corpus.current_notes(table(spark, d, "notes"), "title", "body", "tags")


_INDEXES: dict[tuple, search.FullText] = {}


def index_of(spark: SparkSession, d: str) -> search.FullText:
    """The full-text index of a folder's notes: built by the session's first query, read by the others as long as the notes are the same."""
    key = (spark.sparkContext.applicationId, d, Files(spark).state(f"{d}/notes.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = search.FullText.of(notes_of(spark, d))
    return _INDEXES[key]


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """All ranked matches of two words among all notes."""
    return search.bm25(index_of(spark, d), " ".join(TERMS), None).select("path", "title", F.round("rank", 5).alias("rank"))


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The ten best with a tag and a folder."""
    return search.bm25(index_of(spark, d), " ".join(TERMS), 10, TAG, PREFIX).select("path", "title", F.round("rank", 5).alias("rank"))


def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(index_of(spark, d), '"open items" OR "meeting note"')


def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(index_of(spark, d), "proto* NOT survey")


def search_boolean(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(index_of(spark, d), "(budget OR dashboard) AND retro NOT vault")


def search_column(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(index_of(spark, d), "(title: survey OR {title tags}: finance)")


def search_near(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(index_of(spark, d), "NEAR(budget draft, 12)")


def search_like(spark: SparkSession, d: str) -> DataFrame:
    return search.like_search(notes_of(spark, d), "c++ (", None).select("path", "title", "rank").unionByName(
        search.like_search(notes_of(spark, d), "O'", None).select("path", "title", "rank")
    )


def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Ranked matches by stem: ``items`` finds ``item``."""
    return search.bm25(index_of(spark, d), "counted items", None).select("path", F.round("rank", 5).alias("rank"))


def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The ten best, and whether each snippet, without its marks and dots, stands in the note."""
    hits = search.search(index_of(spark, d), "contract draft", 10)
    bodies = notes_of(spark, d).select("path", "body").join(F.broadcast(hits.select("path")), "path", "left_semi")
    bare = F.regexp_replace(F.regexp_replace("snippet", ">>>|<<<", ""), r"^\.\.\.|\.\.\.$", "")
    j = hits.join(bodies, "path")
    return j.select("path", "title", "tags", F.round("rank", 5).alias("rank"), F.contains("body", bare).alias("from_body"))


def stemmed_terms(spark: SparkSession, d: str) -> DataFrame:
    """(term, notes): stems of all notes and in how many they occur."""
    return search.document_frequency(index_of(spark, d))


MARKS = search.marked_letters()
SIGNS = "'[^\\p{L}\\p{N}\\p{Co}]+'"


def _cut(c: str) -> str:
    fold = f"translate(regexp_replace(lower(coalesce({c}, '')), '[\\x{{300}}-\\x{{36F}}]+', '', 'g'), '{MARKS[0]}', '{MARKS[1]}')"
    return f"list_filter(regexp_split_to_array({fold}, {SIGNS}), lambda x: x <> '')"


# Porter's published algorithm (1980) over the distinct words, a step a table. Its conditions on a stem as patterns,
# in which y counts as a vowel after a consonant: a vowel-consonant pair, exactly one, two or more, a vowel, an open end.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M1, IS1, M2 = f"^({C})?{V}{C}", f"^({C})?{V}{C}({V})?$", f"^({C})?{V}{C}{V}{C}"
HAS_V, OPEN = f"^({C})?[aeiouy]", f"^{C}[aeiouy][^aeiouwxy]$"


def _suffixes(table: str, source: str, rules: dict[str, str], condition: str) -> str:
    whens = " ".join(
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches(left(w, -{len(s)}), '{condition}') THEN left(w, -{len(s)}) || '{to}' ELSE w END"
        for s, to in sorted(rules.items(), key=lambda r: -len(r[0]))
    )
    return f"{table} AS (SELECT o, CASE {whens} ELSE w END AS w FROM {source})"


_ION = " ".join(
    f"WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches(left(w, -{len(s)}), '{M2}')" + (" AND regexp_matches(w, '[st]ion$')" if s == "ion" else "") + f" THEN left(w, -{len(s)}) ELSE w END"
    for s in sorted(STEP4, key=len, reverse=True)
)
PORTER = f"""s0 AS (SELECT DISTINCT x AS o, x AS w FROM words WHERE regexp_matches(x, '^[a-z]{{3,}}$')),
s1 AS (SELECT o, CASE WHEN regexp_matches(w, '(ss|i)es$') THEN left(w, -2) WHEN regexp_matches(w, '[^s]s$') THEN left(w, -1) ELSE w END AS w FROM s0),
s2 AS (SELECT o, w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND regexp_matches(left(w, -2), '{HAS_V}') THEN left(w, -2)
  WHEN ends_with(w, 'ing') AND regexp_matches(left(w, -3), '{HAS_V}') THEN left(w, -3) END AS t FROM s1),
s3 AS (SELECT o, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(left(w, -3), '{M1}') THEN left(w, -1) ELSE w END WHEN t IS NULL THEN w
  WHEN regexp_matches(t, '(at|bl|iz)$') THEN t || 'e' WHEN length(t) > 1 AND right(t, 1) = substr(t, -2, 1) AND regexp_matches(t, '[^aeiouylsz]$') THEN left(t, -1)
  WHEN regexp_matches(t, '{OPEN}') THEN t || 'e' ELSE t END AS w FROM s2),
s4 AS (SELECT o, CASE WHEN ends_with(w, 'y') AND regexp_matches(left(w, -1), '{HAS_V}') THEN left(w, -1) || 'i' ELSE w END AS w FROM s3),
{_suffixes("s5", "s4", STEP2, M1)}, {_suffixes("s6", "s5", STEP3, M1)},
s7 AS (SELECT o, CASE {_ION} ELSE w END AS w FROM s6),
s8 AS (SELECT o, CASE WHEN ends_with(w, 'e') AND (regexp_matches(left(w, -1), '{M2}') OR (regexp_matches(left(w, -1), '{IS1}') AND NOT regexp_matches(left(w, -1), '{OPEN}'))) THEN left(w, -1) ELSE w END AS w FROM s7),
stems AS (SELECT o, CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{M2}') THEN left(w, -1) ELSE w END AS w FROM s8)"""
TOK = f"""{CUR}, raw AS (SELECT path, title, body, tags, {_cut("title")} AS tt, {_cut("body")} AS bt, {_cut("tags")} AS gt FROM cur),
words AS (SELECT DISTINCT unnest(list_concat(tt, bt, gt)) AS x FROM raw), {PORTER},
occ AS (SELECT path, 0 AS f, unnest(tt) AS x, generate_subscripts(tt, 1) AS i FROM raw UNION ALL SELECT path, 1, unnest(bt), generate_subscripts(bt, 1) FROM raw
  UNION ALL SELECT path, 2, unnest(gt), generate_subscripts(gt, 1) FROM raw),
pos AS (SELECT path, f, coalesce(w, x) AS x, i FROM occ LEFT JOIN stems ON o = x),
lists AS (SELECT path, f, ' ' || string_agg(x, ' ' ORDER BY i) || ' ' AS l FROM pos GROUP BY path, f),
flat AS (SELECT path, title, tags, body, len(tt) + len(bt) + len(gt) AS dl, coalesce(t.l, '') AS t, coalesce(b.l, '') AS b, coalesce(g.l, '') AS g FROM raw
  LEFT JOIN (SELECT path, l FROM lists WHERE f = 0) t USING (path) LEFT JOIN (SELECT path, l FROM lists WHERE f = 1) b USING (path) LEFT JOIN (SELECT path, l FROM lists WHERE f = 2) g USING (path))"""


def _any(word: str) -> str:
    return f"(contains(t, '{word}') OR contains(b, '{word}') OR contains(g, '{word}'))"


def ranked(stems: tuple[str, str], where: str = "") -> str:
    """CTEs that end in ``r(path, title, tags, rank)``: the notes with both stems."""
    return f"""{TOK}, tf AS (SELECT path, count(*) FILTER (x = '{stems[0]}') AS f0, count(*) FILTER (x = '{stems[1]}') AS f1 FROM pos GROUP BY path),
    s AS (SELECT flat.path, title, tags, dl, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1 FROM flat LEFT JOIN tf USING (path)),
    c AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM s),
    w AS (SELECT CASE WHEN ln((n-d0+0.5)/(d0+0.5)) <= 0 THEN 1e-6 ELSE ln((n-d0+0.5)/(d0+0.5)) END AS i0,
      CASE WHEN ln((n-d1+0.5)/(d1+0.5)) <= 0 THEN 1e-6 ELSE ln((n-d1+0.5)/(d1+0.5)) END AS i1, a FROM c),
    r AS (SELECT path, title, tags, round(-(i0*f0*2.2/(f0+1.2*(0.25+0.75*dl/a)) + i1*f1*2.2/(f1+1.2*(0.25+0.75*dl/a))), 9) AS rank
      FROM s, w WHERE f0 > 0 AND f1 > 0 {where})"""


def _bm25(stems: tuple[str, str], where: str, tail: str, columns: str = "path, title, ") -> str:
    return f"WITH {ranked(stems, where)} SELECT {columns}round(rank, 5) AS rank FROM r {tail}"


QUERIES = {
    f.__name__: f
    for f in (search_bm25, search_filtered, search_phrase, search_prefix, search_boolean, search_column, search_near, search_like, search_stemmed, search_snippets, stemmed_terms)
}
ORACLES = {
    "search_bm25": _bm25(("budget", "share"), "", ""),
    "search_filtered": _bm25(("budget", "share"), f"AND contains(lower(tags), '{TAG}') AND starts_with(lower(path), lower('{PREFIX}'))", "ORDER BY r.rank, path LIMIT 10"),
    "search_stemmed": _bm25(("count", "item"), "", "", "path, "),
    "search_snippets": _bm25(("contract", "draft"), "", "ORDER BY r.rank, path LIMIT 10", "path, title, tags, true AS from_body, "),
    "stemmed_terms": f"WITH {TOK} SELECT x AS term, count(DISTINCT path) AS notes FROM pos GROUP BY x",
    "search_phrase": f"WITH {TOK} SELECT path FROM flat WHERE {_any(' open item ')} OR {_any(' meet note ')}",
    "search_prefix": f"WITH {TOK} SELECT path FROM flat WHERE {_any(' proto')} AND NOT {_any(' survei ')}",
    "search_boolean": f"WITH {TOK} SELECT path FROM flat WHERE ({_any(' budget ')} OR {_any(' dashboard ')}) AND {_any(' retro ')} AND NOT {_any(' vault ')}",
    "search_column": f"WITH {TOK} SELECT path FROM flat WHERE contains(t, ' survei ') OR contains(t, ' financ ') OR contains(g, ' financ ')",
    "search_near": f"WITH {TOK} SELECT path FROM flat WHERE "
    + " OR ".join(f"regexp_matches({c}, ' budget (?:[^ ]+ ){{0,12}}draft ') OR regexp_matches({c}, ' draft (?:[^ ]+ ){{0,12}}budget ')" for c in "tbg"),
    "search_like": f"""WITH {CUR} SELECT path, title, 0.0::DOUBLE AS rank FROM cur WHERE contains(lower(title), 'c++ (') OR contains(lower(body), 'c++ (')
      UNION ALL SELECT path, title, 0.0::DOUBLE FROM cur WHERE contains(lower(title), 'o''') OR contains(lower(body), 'o''')""",
}
