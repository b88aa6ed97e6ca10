"""What changed since the last digest: watermark, grouping and the rolling document."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md

# System notes that stay out of the digest, folders shown first, and the cap of dated sections: fixed values.
SYSTEM_NOTES = ("_DAILY-DIGEST.md", "_ACTION-REVIEW.md", "_INGEST-LOG.md")
FIRST_FOLDERS = ("1-Projects", "2-Areas", "3-Resources", "4-Archives")
MAX_SECTIONS = 30
WINDOW_START, WINDOW_DATE, LAST_RUN = "digest_window_start", "digest_window_date", "digest_last_run_at"
HEADER = "# Vault Daily Digest\n\nAutomated digest of vault activity, newest first.\n"


def excluded(path: Column | str) -> Column:
    """System notes, anything below an assets folder, and dotted parts."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.exists(parts, lambda p: (p == "assets") | p.startswith(".")) | F.element_at(parts, -1).isin(*SYSTEM_NOTES)


def changed_since(notes: DataFrame, cutoff: float) -> DataFrame:
    """(path, title, changed_at, is_new, grp), oldest change first."""
    out = notes.filter((F.col("content_changed_at") > cutoff) & ~excluded("path"))
    return out.select(
        "path", "title", F.col("content_changed_at").alias("changed_at"),
        F.coalesce(F.col("first_indexed_at") > cutoff, F.lit(False)).alias("is_new"), md.folder_group("path").alias("grp"),
    ).orderBy("changed_at", "path")


def group_rank(grp: Column | str) -> Column:
    """First the fixed folders, then the others by name, the root last."""
    g = F.col(grp) if isinstance(grp, str) else grp
    rank = F.when(g == "Vault root", len(FIRST_FOLDERS) + 1)
    for i, f in enumerate(FIRST_FOLDERS):
        rank = rank.when(g == f, i)
    return rank.otherwise(len(FIRST_FOLDERS))


def groups(changed: DataFrame) -> DataFrame:
    """(grp, rank, touched, new)."""
    return changed.groupBy("grp").agg(F.count(F.lit(1)).alias("touched"), F.count_if("is_new").alias("new")).withColumn("rank", group_rank("grp"))


def window(today: date) -> tuple[date, str]:
    """Where the first window starts, and its label: on Mondays from Friday on, else the day before."""
    before = today - timedelta(days=1)
    start = today - timedelta(days=3) if today.weekday() == 0 else before
    name = lambda d: f"{d:%Y-%m-%d} ({d:%a})"
    return start, name(start) if start == before else f"{name(start)} to {name(before)}"


def cutoff(meta: dict[str, str], today: date, zone: tzinfo | None = None) -> float:
    """A rerun on the same date keeps its window, a new date starts at the last run, the very first at the wall clock."""
    if meta.get(WINDOW_DATE) == today.isoformat() and WINDOW_START in meta:
        return float(meta[WINDOW_START])
    if LAST_RUN in meta:
        return float(meta[LAST_RUN])
    start, _ = window(today)
    return datetime(start.year, start.month, start.day, tzinfo=zone or timezone.utc).timestamp() * 1000


def advance(meta: dict[str, str], cut: float, today: date, now_ms: float) -> dict[str, str]:
    """The watermark after a digest was written."""
    return meta | {WINDOW_START: repr(cut), WINDOW_DATE: today.isoformat(), LAST_RUN: repr(now_ms)}


def _zone_name(zone: tzinfo | None) -> str:
    """A zone's name as Spark takes it; zones without one go by their offset of today."""
    if zone is None or zone is timezone.utc:
        return "UTC"
    offset = datetime.now(zone).strftime("%z")
    return getattr(zone, "key", None) or f"{offset[:3]}:{offset[3:5]}"


def lines(changed: DataFrame, zone: tzinfo | None = None) -> DataFrame:
    """(rank, grp, changed_at, path, line) of each note's entry in the document, with the zone's times (UTC without one)."""
    wall = F.timestamp_millis(F.col("changed_at").cast("long")).cast("timestamp_ntz")
    stamp = F.date_format(F.convert_timezone(F.current_timezone(), F.lit(_zone_name(zone)), wall), "yyyy-MM-dd HH:mm")
    marker = F.when(F.col("is_new"), "new").otherwise("updated")
    line = F.concat(F.lit("- "), md.wiki_link("path", "title"), F.lit(" — "), marker, F.lit(", "), stamp)
    return changed.select(group_rank("grp").alias("rank"), "grp", "changed_at", "path", line.alias("line"))


def render(changed: DataFrame, today: date, label: str, zone: tzinfo | None = None) -> str:
    """The dated section. One window's notes are read by people, so they fit on the driver."""
    head = f"## {today:%Y-%m-%d} — activity for {label}"
    rows = lines(changed, zone).orderBy("rank", F.lower("grp"), "grp", "changed_at", "path").collect()
    if not rows:
        return head + "\n\n_No vault activity in this window._\n"
    out, by = [head, "", f"**Notes touched:** {len(rows)}", ""], {}
    for r in rows:
        by.setdefault(r["grp"], []).append(r["line"])
    for grp, ls in by.items():
        out += [f"### {grp} ({len(ls)})", *ls, ""]
    return "\n".join(out).rstrip("\n") + "\n"


def sections(text: str) -> list[str]:
    """The dated sections of a document; third-level headings don't part it."""
    first, *rest = ("\n" + text).split("\n## ")
    return [("## " + r).strip() for r in rest if r.strip()]


def document(entry: str, existing: str, today: date) -> str:
    """Newest first; a section of the same date is replaced, at most ``MAX_SECTIONS`` stay."""
    old = [s.removesuffix("---").strip() for s in sections(existing)]
    kept = [entry.strip(), *(s for s in old if not s.startswith(f"## {today:%Y-%m-%d} "))][:MAX_SECTIONS]
    return HEADER + "\n---\n\n" + "\n\n---\n\n".join(kept) + "\n"
