"""Markdown as column expressions; everything but YAML stays inside the JVM.

Regular expressions use (?md) so that ``^`` and ``$`` know only the line feed, and spell out the
ASCII white space, because the JVM's ``\\s`` also has the vertical tab. The patterns of links, tags and
stripped markup are fixed values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import UNICODE_SPACE

WS = r"[\t\n\f\r ]"
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
TAG = rf"(?:^|{WS})#([a-zA-Z][\w/-]*)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Unicode white space at both ends; ``trim`` alone knows only the blank.
def strip(c: Column | str) -> Column:
    space = f"[{UNICODE_SPACE}]+"
    return F.regexp_replace(_c(c), rf"\A{space}|{space}\z", "")


def has_frontmatter(raw: Column | str) -> Column:
    """A block opens on the first line with three dashes and ends at a later line that begins with them."""
    return F.coalesce(_c(raw).rlike(r"(?s)\A---[^\n]*\n.*?\n---"), F.lit(False))


def frontmatter_text(raw: Column | str) -> Column:
    """The YAML between the dashes; empty if there is no closed block."""
    return F.when(has_frontmatter(raw), F.regexp_extract(_c(raw), r"(?s)\A---[^\n]*\n(.*?)\n---", 1)).otherwise(F.lit(""))


def body_text(raw: Column | str) -> Column:
    """What follows the line that closes the block, or everything if no block is closed."""
    c = _c(raw)
    return F.when(has_frontmatter(c), F.regexp_extract(c, r"(?s)\A---[^\n]*\n.*?\n---[^\n]*(?:\n(.*))?\z", 1)).otherwise(c)


def _yaml_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text: str | None) -> str:
        if not text:
            return "{}"
        try:
            value = yaml.load(text, loader)  # noqa: S506
        except Exception:  # noqa: BLE001  bad YAML counts as none
            return "{}"
        if not isinstance(value, dict):
            return "{}"
        return json.dumps({str(k): v for k, v in value.items()}, ensure_ascii=False, sort_keys=True, default=str)

    for s in texts:
        # few distinct blocks repeat: parse each once
        known = {t: one(t) for t in s.unique()}
        yield s.map(known)


yaml_to_json = F.pandas_udf(_yaml_json, T.StringType())


def frontmatter_json(raw: Column | str) -> Column:
    """The block as JSON with sorted keys; no block, bad YAML and other than a mapping give {}."""
    return yaml_to_json(frontmatter_text(raw))


def basename_no_ext(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(_c(path), "/", -1), r"\.md\z", "")


def heading_title(body: Column | str) -> Column:
    """The first level-one heading; its text may stand on a later line if the heading's own is empty."""
    return strip(F.regexp_extract(_c(body), rf"(?md)^#{WS}+([^\n]+)$", 1))


def title(raw: Column | str, path: Column | str, frontmatter: Column) -> Column:
    """Frontmatter title, else first heading, else file name."""
    own = F.when(_kind(frontmatter, "title") == "STRING", F.get_json_object(frontmatter, "$.title"))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(heading_title(body_text(raw)), F.lit("")), basename_no_ext(path))


def wikilinks(raw: Column | str) -> Column:
    """Targets of all links in the raw text, code and frontmatter included."""
    return F.transform(F.regexp_extract_all(_c(raw), F.lit(WIKILINK), F.lit(1)), strip)


def inline_tags(body: Column | str) -> Column:
    return F.regexp_extract_all(_c(body), F.lit(TAG), F.lit(1))


def _kind(frontmatter: Column, name: str) -> Column:
    """The type of a block's own entry of that name, whatever other entries hold; null without one."""
    value = F.try_variant_get(F.try_parse_json(frontmatter), f"$.{name}", "variant")
    return F.when(value.isNotNull(), F.schema_of_variant(value))


def frontmatter_tags(frontmatter: Column) -> Column:
    """A list's members, or a string's parts between commas and white space."""
    kind, text = _kind(frontmatter, "tags"), F.get_json_object(frontmatter, "$.tags")
    listed = F.from_json(text, "array<string>")
    return F.coalesce(F.when(kind.startswith("ARRAY"), listed).when(kind == "STRING", F.split(text, r"[,\t\n\f\r ]+")), F.array().cast("array<string>"))


def tags(raw: Column | str, frontmatter: Column) -> Column:
    """Frontmatter tags, then inline tags; one leading # goes, first seen stays."""
    clean = lambda t: F.regexp_replace(strip(t), r"\A#", "")
    every = F.transform(F.concat(frontmatter_tags(frontmatter), inline_tags(body_text(raw))), clean)
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != "")))


FENCE = r"[\t\x0B\f\r \x{85}\x{A0}]*```[^\n]*"


def without_fences(text: Column | str) -> Column:
    """No fenced code; an open fence swallows the rest. One pass of one expression, linear in the text."""
    return F.regexp_replace(_c(text), rf"(?s)(?:\A|\n){FENCE}(?:\n.*?)??(?:\n{FENCE}|\z)", "")


def strip_markdown(text: Column | str) -> Column:
    c = without_fences(text)
    for pattern, to in (
        (r"`[^`]+`", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
        (r"\[\[([^\]|]+)\]\]", "$1"),
        (rf"(?md)^#{{1,6}}{WS}+", ""),
        (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
        (r"(?md)^[-*_]{3,}$", ""),
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def canonical_target(target: Column | str) -> Column:
    return strip(F.substring_index(_c(target), "#", 1))


def canonical_link_target(target: Column | str) -> Column:
    return strip(F.substring_index(canonical_target(target), "^", 1))


def note_keys(path: Column | str, title_: Column | str) -> Column:
    """Path, every trailing part of it without extension, and the title: what a link may call the note."""
    bare = F.regexp_replace(_c(path), r"\.md\z", "")
    parts = F.split(bare, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.array_distinct(F.filter(F.concat(F.array(_c(path)), tails, F.array(_c(title_))), lambda k: k.isNotNull() & (k != "")))


def content_hash(title_: Column | str, body: Column | str, tags_: Column | str, frontmatter: Column | str) -> Column:
    parts = [F.coalesce(_c(c), F.lit("")) for c in (title_, body, tags_, frontmatter)]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def folder_group(path: Column | str) -> Column:
    return F.when(F.instr(_c(path), "/") > 0, F.substring_index(_c(path), "/", 1)).otherwise("Vault root")


def substantial_sections(raw: Column | str) -> Column:
    """Second- and third-level headings with a filled line before the next heading of level one to three."""
    lines = F.split(_c(raw), "\n")
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("counted"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        t = strip(line)
        section, top = line.rlike(rf"\A#{{2,3}}{WS}+[^\t\n\f\r ]"), line.startswith("# ")
        fills = acc["open"] & ~acc["counted"] & (t != "") & ~section & ~top
        return F.struct(
            F.when(section, True).when(top, False).otherwise(acc["open"]).alias("open"),
            F.when(section | top, False).otherwise(acc["counted"] | fills).alias("counted"),
            (acc["n"] + fills.cast("int")).alias("n"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["n"])


def clip(text: Column | str, n: int) -> Column:
    """At most n characters, with dots where something is cut."""
    c = _c(text)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def note_uri(path: Column | str, vault: str) -> Column:
    """An application link that opens the note; blanks as %20."""
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("obsidian://open?vault="), enc(F.lit(vault)), F.lit("&file="), enc(F.regexp_replace(_c(path), r"\.md\z", "")))


def wiki_link(path: Column | str, label: Column | str) -> Column:
    return F.concat(F.lit("[["), F.regexp_replace(_c(path), r"\.md\z", ""), F.lit("|"), _c(label), F.lit("]]"))
