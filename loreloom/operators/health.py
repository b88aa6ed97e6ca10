"""Advisory findings on notes and links: (type, path, detail, severity)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..runtime import Scratch, skew_join
from . import graph, links as link_ops

DAY_MS = 86_400_000
# File name endings of attachments, states that close a project, and the texts of findings below: fixed values.
ATTACHMENTS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp",
    "pdf", "ppt", "pptx", "doc", "docx", "xls", "xlsx", "csv",
    "mp4", "mov", "webm", "mp3", "wav", "m4a", "vtt",
    "html", "htm", "zip", "excalidraw", "canvas",
)
DONE = ("done", "closed", "complete", "archived")
ORDER = ("dangling_link", "ambiguous_link", "para_drift", "oversized", "stub", "orphan", "leaf", "island")


@dataclass(frozen=True)
class HealthConfig:
    """Thresholds; values that are zero, negative or empty mean the default."""

    project_stale_days: int = 180
    size_threshold: int = 4000
    stub_threshold: int = 20
    connective_folders: tuple[str, ...] = ("2-Areas", "3-Resources")
    expected_orphan_folders: tuple[str, ...] = ("Journal", "Notes", "4-Archives")
    orphan_stale_days: int = 90
    island_max_size: int = 3
    archive_folders: tuple[str, ...] = ("4-Archives",)
    attachment_extensions: tuple[str, ...] = ATTACHMENTS
    exclude_from_graph: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for name, f in self.__dataclass_fields__.items():
            value = getattr(self, name)
            if name != "exclude_from_graph" and (not value or (isinstance(value, int) and value <= 0)):
                object.__setattr__(self, name, f.default)


def cutoff_ms(now: datetime, days: int) -> float:
    return (now - timedelta(days=days)).replace(tzinfo=now.tzinfo or timezone.utc).timestamp() * 1000


def now_ms(now: datetime) -> float:
    return now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp() * 1000


def under(path: Column | str, folders: tuple[str, ...], itself: bool) -> Column:
    """Below any of the folders; ``itself`` also accepts a path equal to one."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for f in folders:
        f = f.rstrip("/")
        out = out | p.startswith(f + "/")
        if itself:
            out = out | (p == f)
    return out


def age_days(mtime: Column | str, now: datetime) -> Column:
    m = F.col(mtime) if isinstance(mtime, str) else mtime
    age = (F.lit(now_ms(now)) - m) / DAY_MS
    return F.when(age < 0, F.ceil(age)).otherwise(F.floor(age)).cast("long")


def finding(kind: str | Column, path: str, *detail: Column | str) -> list[Column]:
    parts = [F.lit(d) if isinstance(d, str) else d.cast("string") for d in detail]
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.col(path).alias("path"), F.concat(*parts).alias("detail"), F.lit("warn").alias("severity")]


def is_attachment(canon: Column, extensions: tuple[str, ...] = ATTACHMENTS) -> Column:
    ends = [e.lower().removeprefix(".") for e in extensions]
    return (F.instr(canon, ".") > 0) & F.lower(F.substring_index(canon, ".", -1)).isin(ends)


def unresolved_links(links: DataFrame, notes: DataFrame, config: HealthConfig, folders: DataFrame | None = None) -> DataFrame:
    """(source_path, target, kind) of links without a target path; kind: attachment, folder, ambiguous or dangling.

    ``folders`` (path) are the vault's directories; without it they are those that hold a note.
    """
    if folders is None:
        parts = F.split("path", "/")
        ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        folders = notes.filter(F.instr("path", "/") > 0).select(F.explode(ups).alias("path")).distinct()
    open_links = links.filter("target_path IS NULL").select("source_path", "target")
    targets = open_links.select("target").distinct().withColumn("canon", md.canonical_link_target("target"))
    dirs = folders.select(F.col("path").alias("canon"), F.lit(True).alias("is_dir")).distinct()
    # ./ and a closing slash name the same directory
    targets = targets.withColumn("canon_dir", F.regexp_replace("canon", r"^(?:\./)+|/+$", "")).join(dirs.withColumnRenamed("canon", "canon_dir"), "canon_dir", "left")
    status = link_ops.resolve_targets(targets, notes).select("target", "status")
    kinds = targets.join(status, "target").select(
        "target",
        F.when(is_attachment(F.col("canon"), config.attachment_extensions), "attachment")
        .when(md.strip("target").endswith("/") | (F.coalesce("is_dir", F.lit(False)) & (F.col("canon") != "")), "folder")
        .when(F.col("status") == link_ops.AMBIGUOUS, "ambiguous")
        .otherwise("dangling")
        .alias("kind"),
    )
    return skew_join(open_links, kinds, "target")


def link_findings(links: DataFrame, notes: DataFrame, config: HealthConfig, report_unresolved: bool = False, folders: DataFrame | None = None) -> DataFrame:
    kinds = unresolved_links(links, notes, config, folders)
    vague = kinds.filter("kind = 'ambiguous'").select(*finding("ambiguous_link", "source_path", "[[", F.col("target"), "]] is ambiguous (matches multiple notes)"))
    if not report_unresolved:
        return vague
    lost = kinds.filter("kind = 'dangling'").select(*finding("dangling_link", "source_path", "[[", F.col("target"), "]] resolves to no note"))
    return vague.unionByName(lost)


def suppressed_unresolved(links: DataFrame, notes: DataFrame, config: HealthConfig, folders: DataFrame | None = None) -> DataFrame:
    return unresolved_links(links, notes, config, folders).agg(F.count_if(F.col("kind") == "dangling").alias("suppressed"))


def para_drift(notes: DataFrame, now: datetime, config: HealthConfig) -> DataFrame:
    """Projects that are finished but not moved, else untouched for too long."""
    p = notes.filter(F.lower("path").startswith("1-projects/"))
    status = F.lower(md.strip(F.get_json_object("frontmatter", "$.status")))
    stale = F.col("mtime") < cutoff_ms(now, config.project_stale_days)
    done = F.coalesce(status.isin(*DONE), F.lit(False))
    detail = F.when(done, F.concat(F.lit("status: "), status, F.lit(", still in 1-Projects"))).otherwise(
        F.concat(F.lit("untouched "), age_days("mtime", now).cast("string"), F.lit(f" days (threshold {config.project_stale_days})"))
    )
    return p.filter(done | stale).select(*finding("para_drift", "path", detail))


def measured(notes: DataFrame) -> DataFrame:
    """Notes with (tokens, shown) instead of their bodies: characters by four, which the thresholds use, and bytes by four, which the findings show."""
    if "tokens" in notes.columns:
        return notes
    body = F.coalesce("body", F.lit(""))
    return notes.withColumn("tokens", F.floor(F.length(body) / 4)).withColumn("shown", F.floor(F.octet_length(body) / 4).cast("long")).drop("body")


def oversized(notes: DataFrame, raw: DataFrame, config: HealthConfig) -> DataFrame:
    """Long notes with at least three filled sections; raw is (path, raw), read only for long notes."""
    big = measured(notes).filter(F.col("tokens") > config.size_threshold).select("path", F.col("shown").alias("tokens"))
    n = raw.select("path", "raw").join(big, "path").select("path", "tokens", md.substantial_sections("raw").alias("n"))
    return n.filter("n >= 3").select(*finding("oversized", "path", "~", F.col("tokens"), " tokens, ", F.col("n"), " sections - split candidate"))


def stubs(notes: DataFrame, links: DataFrame, config: HealthConfig) -> DataFrame:
    """Nearly empty notes that link nowhere."""
    small = measured(notes).filter((F.col("tokens") < config.stub_threshold) & ~under("path", config.expected_orphan_folders, False))
    linked = links.filter("target_path IS NOT NULL").select(F.col("source_path").alias("path")).distinct()
    return small.join(linked, "path", "left_anti").select(*finding("stub", "path", "near-empty (~", F.col("shown"), " tokens), links nowhere - merge or archive?"))


def note_graph(notes: DataFrame, links: DataFrame, config: HealthConfig) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that the detectors look at."""
    nodes = graph.graph_nodes(notes, list(config.exclude_from_graph))
    return nodes, graph.graph_edges(links, nodes)


def orphans_and_leaves(notes: DataFrame, links: DataFrame, now: datetime, config: HealthConfig, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Old notes in connective folders with no or one neighbour."""
    degree = graph.degrees(*(known or note_graph(notes, links, config))).filter("degree <= 1")
    old = notes.filter(
        ~under("path", config.expected_orphan_folders, True) & under("path", config.connective_folders, True) & (F.col("mtime") < cutoff_ms(now, config.orphan_stale_days))
    ).select("path", age_days("mtime", now).alias("age"))
    d = old.join(degree, "path")
    kind = F.when(F.col("degree") == 0, "orphan").otherwise("leaf")
    text = F.when(F.col("degree") == 0, "degree 0 (no resolved links), age ").otherwise("degree 1 (single resolved link), age ")
    return d.select(*finding(kind, "path", text, F.col("age"), " days"))


def islands(notes: DataFrame, links: DataFrame, config: HealthConfig, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Small components, except the largest ones and those that are wholly archived; smallest first, then by first member."""
    comp = graph.components(*(known or note_graph(notes, links, config)))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).scalar()
    few = sizes.filter((F.col("n") >= 2) & (F.col("n") <= config.island_max_size) & (F.col("n") < most)).select("component")
    # only components within the size limit are gathered
    members = comp.join(few, "component").groupBy("component").agg(
        F.sort_array(F.collect_list("path")).alias("m"), F.bool_and(under("path", config.archive_folders, True)).alias("archived")
    )
    return members.filter("NOT archived").orderBy(F.size("m"), "component").select(*finding("island", "component", "isolated cluster of ", F.size("m"), ": ", F.array_join("m", ", ")))


def audit(notes: DataFrame, links: DataFrame, raw: DataFrame, now: datetime, config: HealthConfig | None = None, report_unresolved: bool = False, folders: DataFrame | None = None) -> DataFrame:
    """All findings, in the fixed order of their types, then by path (islands by size first)."""
    c = config or HealthConfig()
    # what the detectors share is computed once: sizes instead of bodies, and the graph
    scratch = Scratch(notes.sparkSession, "audit")
    notes, links = scratch.write(measured(notes), "notes"), scratch.write(links.select("source_path", "target", "target_path"), "links")
    known = tuple(scratch.write(x, name) for x, name in zip(note_graph(notes, links, c), ("nodes", "edges")))
    parts = [
        link_findings(links, notes, c, report_unresolved, folders), para_drift(notes, now, c), oversized(notes, raw, c), stubs(notes, links, c),
        orphans_and_leaves(notes, links, now, c, known), islands(notes, links, c, known),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # islands go by their size, which their detail begins with, then by their first member
    size = F.when(F.col("type") == "island", F.regexp_extract("detail", r"^isolated cluster of (\d+)", 1).cast("int"))
    return out.orderBy(F.array_position(F.array(*map(F.lit, ORDER)), F.col("type")), size, "path", "detail")


def counts_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def findings_json(findings: DataFrame) -> str:
    """A JSON array, also of nothing. Findings are a report for people; the caller bounds them."""
    import json

    return json.dumps([r.asDict() for r in findings.collect()], ensure_ascii=False, indent=2)
