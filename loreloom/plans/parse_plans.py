"""Queries on raw markdown: links, tags, headings, stripped bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..operators import corpus
from ..runtime import table
from ..sources import captions
from .sql import BLANKS, CUR


def raw_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("path", F.concat(F.lit("doc-"), "doc_id", F.lit(".md"))).alias("path"), F.col("text").alias("raw"), "mtime").filter("raw IS NOT NULL")


def parse_notes(spark: SparkSession, d: str) -> DataFrame:
    docs = raw_docs(spark, d)
    return corpus.parse(docs.drop("path").withColumn("path", F.col("doc_id").cast("string"))).select("path", "title", "tags", "frontmatter", "content_hash")


def parse_headings(spark: SparkSession, d: str) -> DataFrame:
    """The first level-one heading of each body, which is the title where frontmatter has none."""
    return raw_docs(spark, d).select("doc_id", md.heading_title(md.body_text("raw")).alias("heading"))


def parse_links(spark: SparkSession, d: str) -> DataFrame:
    return raw_docs(spark, d).select("doc_id", F.posexplode(md.wikilinks("raw")).alias("pos", "target"))


def parse_inline_tags(spark: SparkSession, d: str) -> DataFrame:
    return raw_docs(spark, d).select("doc_id", F.posexplode(md.inline_tags("raw")).alias("pos", "tag"))


def parse_body(spark: SparkSession, d: str) -> DataFrame:
    return raw_docs(spark, d).select("doc_id", F.sha2(md.strip_markdown(md.body_text("raw")), 256).alias("body_hash"))


def parse_sections(spark: SparkSession, d: str) -> DataFrame:
    return raw_docs(spark, d).select("doc_id", md.substantial_sections("raw").alias("sections"))


def note_names(spark: SparkSession, d: str) -> DataFrame:
    """(path, key): everything a link may call a note."""
    notes = corpus.current_notes(table(spark, d, "notes"), "title")
    return notes.select("path", F.explode(md.note_keys("path", "title")).alias("key"))


def note_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions over notes: slug, group, opening link, wiki link, clipped title."""
    notes = corpus.current_notes(table(spark, d, "notes"), "title")
    return notes.select(
        "path", md.slug("title").alias("slug"), md.folder_group("path").alias("grp"), md.wiki_link("path", "title").alias("link"), md.clip("title", 12).alias("clipped"),
        md.note_uri("path", "My vault").alias("uri"),
    )


def flat_captions(spark: SparkSession, d: str) -> DataFrame:
    return raw_docs(spark, d).select("doc_id", captions.flatten("raw").alias("flat"))


def _rep(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


BODY = "CASE WHEN regexp_matches(text, '(?s)\\A---[^\\n]*\\n.*?\\n---') THEN regexp_extract(text, '(?s)\\A---[^\\n]*\\n.*?\\n---[^\\n]*(?:\\n(.*))?\\z', 1) ELSE text END"
_BODY = "b0"
for _p, _t in (
    ("`[^`]+`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"\[\[[^\]|]+\|([^\]]+)\]\]", r"\1"), (r"\[\[([^\]|]+)\]\]", r"\1"),
    (r"(?m)^#{1,6}\s+", ""), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", r"\1"), (r"(?m)^[-*_]{3,}$", ""), (r"\n{3,}", "\n\n"),
):
    _BODY = _rep(_BODY, _p, _t)

QUERIES = {f.__name__: f for f in (parse_notes, parse_headings, parse_links, parse_inline_tags, parse_body, parse_sections, note_names, note_shapes, flat_captions)}
ORACLES = {
    "parse_headings": f"SELECT doc_id, trim(regexp_extract(b, '(?m)^#\\s+([^\\n]+)$', 1), {BLANKS}) AS heading FROM (SELECT doc_id, {BODY} AS b FROM documents WHERE text IS NOT NULL)",
    "flat_captions": f"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), {BLANKS})) AS ls FROM documents WHERE text IS NOT NULL),
      k AS (SELECT doc_id, list_filter(ls, lambda x: x <> '' AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^[0-9]+$')
        AND NOT regexp_matches(x, '^(?:WEBVTT|Kind:|Language:|NOTE\\b|STYLE\\b|REGION\\b)')) AS ks FROM l)
      SELECT doc_id, regexp_replace(array_to_string(list_filter(ks, lambda x, i: i = 1 OR x <> ks[i - 1]), ' '), '[\\x09-\\x0d ]+', ' ', 'g') AS flat FROM k""",
    "parse_links": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, trim(x, {BLANKS}) AS target FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1) AS l FROM documents WHERE text IS NOT NULL))""",
    "parse_inline_tags": """SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, x AS tag FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '(?:^|\\s)#([a-zA-Z][\\w/-]*)', 1) AS l FROM documents WHERE text IS NOT NULL))""",
    "parse_body": f"""WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)\\A---[^\\n]*\\n.*?\\n---') THEN regexp_extract(text, '(?s)\\A---[^\\n]*\\n.*?\\n---[^\\n]*(?:\\n(.*))?\\z', 1) ELSE text END AS body
      FROM documents WHERE text IS NOT NULL),
    ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM r)),
    fl AS (SELECT *, starts_with(trim(line, {BLANKS}), '```') AS fence, sum(CASE WHEN starts_with(trim(line, {BLANKS}), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ln),
    j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fence AND k % 2 = 0), '') AS b0 FROM fl GROUP BY doc_id)
    SELECT doc_id, sha256(trim({_BODY}, {BLANKS})) AS body_hash FROM j""",
    "note_names": f"""WITH {CUR}, p AS (SELECT path, title, regexp_replace(path, '\\.md$', '') AS bare, len(string_split(path, '/')) AS n FROM cur)
      SELECT DISTINCT path, key FROM (SELECT path, path AS key FROM p UNION ALL SELECT path, title FROM p
      UNION ALL SELECT path, unnest(list_transform(range(1, n + 1), lambda i: array_to_string(list_slice(string_split(bare, '/'), i, n), '/'))) FROM p) WHERE key <> ''""",
    "note_shapes": f"""WITH {CUR} SELECT path, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
      CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Vault root' END AS grp, '[[' || regexp_replace(path, '\\.md$', '') || '|' || title || ']]' AS link,
      CASE WHEN length(title) > 12 THEN substr(title, 1, 12) || '...' ELSE title END AS clipped,
      'obsidian://open?vault=My%20vault&file=' || replace(replace(url_encode(regexp_replace(path, '\\.md$', '')), '*', '*'), '~', '%7E') AS uri FROM cur""",
}
