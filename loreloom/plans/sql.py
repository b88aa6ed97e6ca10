"""Pieces of SQL that several reference queries share."""

CUR = """cur AS (SELECT DISTINCT ON (path) path, title, body, tags, frontmatter, mtime, content_hash, content_changed_at, first_indexed_at
  FROM notes WHERE path IS NOT NULL ORDER BY path, mtime DESC NULLS LAST)"""
LNK = """lnk AS (SELECT source_path, target, nullif(target_path, '') AS target_path FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path, target ORDER BY seen_at DESC NULLS LAST, link_id DESC) AS rn
  FROM links WHERE source_path IS NOT NULL AND target IS NOT NULL) WHERE rn = 1)"""
BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


def canon(t: str) -> str:
    return f"trim(split_part({t}, '#', 1), {BLANKS})"


def base(p: str) -> str:
    return f"regexp_replace(regexp_extract({p}, '[^/]*$'), '\\.md$', '')"


def resolved(notes: str, links: str, out: str = "res") -> str:
    """CTEs that end in ``out(target, status, target_path)``."""
    return f"""tg AS (SELECT DISTINCT target, {canon('target')} AS c FROM {links} WHERE target IS NOT NULL),
tl AS (SELECT target, c, lower(c) AS l, regexp_replace(lower(c), '\\.md$', '') AS bare, lower({base('c')}) AS b FROM tg),
hit AS (
  SELECT t.target, 1 AS stage, n.path FROM tl t JOIN {notes} n ON lower(n.path) = t.l WHERE c <> ''
  UNION SELECT t.target, 1, n.path FROM tl t JOIN {notes} n ON lower(n.path) = t.l || '.md' WHERE c <> ''
  UNION SELECT t.target, 2, n.path FROM tl t JOIN {notes} n ON lower({base('n.path')}) = t.b
    WHERE c <> '' AND (NOT contains(t.l, '/') OR lower(n.path) = t.bare || '.md' OR ends_with(lower(n.path), '/' || t.bare || '.md'))
  UNION SELECT t.target, 3, n.path FROM tl t JOIN {notes} n ON lower(n.title) = t.l AND n.title <> '' WHERE c <> ''
),
st AS (SELECT target, stage, count(*) AS k, min(path) AS p, row_number() OVER (PARTITION BY target ORDER BY stage) AS rn FROM hit GROUP BY target, stage),
{out} AS (SELECT tg.target, CASE WHEN st.k IS NULL THEN 'dangling' WHEN st.k = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN st.k = 1 THEN st.p END AS target_path FROM tg LEFT JOIN st ON st.target = tg.target AND st.rn = 1)"""


EDGES = """e AS (SELECT DISTINCT least(source_path, target_path) AS a, greatest(source_path, target_path) AS b FROM lnk
  WHERE target_path IS NOT NULL AND source_path <> target_path
  AND source_path IN (SELECT path FROM cur) AND target_path IN (SELECT path FROM cur)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
deg AS (SELECT cur.path, count(sym.b) AS degree FROM cur LEFT JOIN sym ON sym.a = cur.path GROUP BY cur.path)"""
# label spreading: each round a node takes the least label around it; USING KEY keeps one row a node
COMPONENTS = """reach AS (SELECT path, path AS component FROM cur
  UNION SELECT sym.b, reach.component FROM reach JOIN sym ON sym.a = reach.path WHERE reach.component < sym.b),
comp AS (SELECT path, min(component) AS component FROM reach GROUP BY path)"""
