"""Action registers: parsing markdown tables, states, ordering, review and personal worklist."""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import markdown as md

ARCHIVE = "4-Archives"
REGISTER_NAME = "OPEN-ACTIONS.md"
FIELDS = ("status", "action", "owner", "review_due", "first_raised", "latest_source")
# Order of states in the review: fixed values.
STATUS_RANK = {"overdue": 0, "needs review": 1, "waiting": 2, "open": 3, "done": 9}
UNKNOWN_RANK = 5
DEFAULT_PRIORITIES = "Choose here what gets attention; the tables below only show the work.\n\n- [ ]\n- [ ]\n- [ ]\n"


def registers(files: DataFrame, name: str = REGISTER_NAME, output: str | None = None) -> DataFrame:
    """The rows (path, raw, ...) that are action registers: named so, not archived, not the review itself."""
    parts = F.split("path", "/")
    out = files.filter((F.element_at(parts, -1) == name) & ~F.array_contains(parts, ARCHIVE))
    return out.filter(F.col("path") != output) if output else out


def register_title(raw: Column | str, path: Column | str) -> Column:
    """The first level-one heading, else the folder's name."""
    p = F.col(path) if isinstance(path, str) else path
    head = md.strip(F.regexp_extract(F.col(raw) if isinstance(raw, str) else raw, r"(?md)^# ([^\r\n]*)", 1))
    parts = F.split(p, "/")
    return F.coalesce(F.nullif(head, F.lit("")), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("")))


def parse_registers(files: DataFrame) -> DataFrame:
    """(register_path, register_title, line_no, six fields): rows after a Status header up to the first line that isn't a table's."""
    lines = files.select("path", "raw", register_title("raw", "path").alias("register_title"), F.posexplode(F.split("raw", r"\r\n|\n|\r")).alias("line_no", "line"))
    t = md.strip("line")
    is_row = t.startswith("|") & t.endswith("|")
    cells = F.when(is_row, F.transform(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|"), md.strip))
    lines = lines.select("path", "register_title", "line_no", cells.alias("cells"))
    lines = lines.withColumn("header", F.coalesce(F.lower(F.col("cells")[0]) == "status", F.lit(False)))
    # a note's lines stay together: a register is one file
    w = W.Window.partitionBy("path").orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, 0)
    lines = lines.withColumn("started", F.max("header").over(w))
    lines = lines.withColumn("ended", F.max(F.col("started") & F.col("cells").isNull()).over(w))
    rule = F.regexp_replace(F.col("cells")[0], " ", "").rlike(r"^-*$")
    rows = lines.filter(F.col("started") & ~F.col("ended") & ~F.col("header") & ~rule & (F.size("cells") >= 6))
    return rows.select(F.col("path").alias("register_path"), "register_title", "line_no", *(F.col("cells")[i].alias(f) for i, f in enumerate(FIELDS)))


def normal_status(status: Column | str) -> Column:
    """Lower case without leading signs; a state may be decorated."""
    s = F.col(status) if isinstance(status, str) else status
    return md.strip(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"(?s)^[^a-z]+", ""))


def due_date(text: Column | str) -> Column:
    """An ISO date, else null."""
    t = md.strip(text)
    plain = F.regexp_replace(t, "-", "")
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}$") | t.rlike(r"^\d{8}$")
    return F.when(iso, F.try_to_date(plain, "yyyyMMdd"))


def with_derived(actions: DataFrame, today: date, owner: str = "") -> DataFrame:
    """Adds due, state, is_mine, is_overdue and stable_id; an empty owner matches nothing."""
    mine = F.contains(F.lower("owner"), F.lower(F.lit(owner))) if owner else F.lit(False)
    raw = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (F.col("register_path"), F.col("first_raised"), F.lower("action"), F.lower("owner"))))
    out = actions.withColumn("due", due_date("review_due")).withColumn("state", normal_status("status"))
    return (
        out.withColumn("is_mine", F.coalesce(mine, F.lit(False)))
        .withColumn("is_overdue", F.coalesce(F.col("due") <= F.lit(today), F.lit(False)) & (F.col("state") != "done"))
        .withColumn("stable_id", F.substring(F.sha1(raw), 1, 12))
    )


def open_actions(actions: DataFrame, today: date, owner: str = "") -> DataFrame:
    return with_derived(actions, today, owner).filter("state <> 'done'")


def status_rank(status: Column | str) -> Column:
    """By the undecorated text only: a decorated state ranks with the unknown ones."""
    s = F.lower(F.col(status) if isinstance(status, str) else status)
    rank = F.lit(UNKNOWN_RANK)
    for name, r in STATUS_RANK.items():
        rank = F.when(s == name, r).otherwise(rank)
    return rank


def review_order() -> list[Column]:
    return [status_rank("status"), F.coalesce("due", F.lit(date.max)), F.col("register_title"), F.lower("action")]


def due_order() -> list[Column]:
    return review_order()[1:]


def bucket() -> Column:
    """Disjoint buckets of the personal worklist."""
    return F.when(F.col("is_overdue") | (F.col("state") == "overdue"), "overdue").when(F.col("state") == "waiting", "waiting").otherwise("current")


def worklist(actions: DataFrame, today: date, owner: str) -> DataFrame:
    """The owner's open actions with their bucket, by due date within it."""
    mine = open_actions(actions, today, owner).filter("is_mine").withColumn("bucket", bucket())
    return mine.orderBy(F.array_position(F.array(F.lit("overdue"), F.lit("current"), F.lit("waiting")), F.col("bucket")), *due_order())


def sections(actions: DataFrame, today: date, owner: str = "") -> DataFrame:
    """(section, stable_id, ...): a row for each section an open action belongs to; sections overlap."""
    a = open_actions(actions, today, owner)
    wanted = F.array_compact(
        F.array(
            F.when((F.col("state") == "overdue") | F.col("is_overdue"), "overdue"), F.when(F.col("is_mine"), "mine"),
            F.when(F.col("state") == "needs review", "needs review"), F.when(F.col("state") == "waiting", "waiting"),
        )
    )
    return a.select(F.explode(wanted).alias("section"), *a.columns)


def counts(actions: DataFrame, today: date, owner: str = "") -> DataFrame:
    """One row: open, overdue, waiting, needs_review, mine."""
    a = open_actions(actions, today, owner)
    return a.agg(
        F.count(F.lit(1)).alias("open"), F.count_if((F.col("state") == "overdue") | F.col("is_overdue")).alias("overdue"),
        F.count_if(F.col("state") == "waiting").alias("waiting"), F.count_if(F.col("state") == "needs review").alias("needs_review"),
        F.count_if("is_mine").alias("mine"),
    )


def as_json(actions: DataFrame) -> DataFrame:
    """(json): each action as a JSON object."""
    names = {"stable_id": "id", "is_mine": "mine", "is_overdue": "overdue"}
    order = ("stable_id", *FIELDS, "register_path", "register_title", "is_mine", "is_overdue")
    return actions.select(F.to_json(F.struct(*(F.col(c).alias(names.get(c, c)) for c in order)), {"ignoreNullFields": "false"}).alias("json"))


# Headings that the human block may stand under: fixed values.
PRIORITY_HEADINGS = ("Priority List", "Prioritise Today")
PRIORITIES = re.compile(r"^## (" + "|".join(PRIORITY_HEADINGS) + r")\n\n(.*?)\n---", re.S | re.M)


def priority_block(existing: str) -> str:
    """What a person wrote under the priorities, kept when the review is made anew."""
    found = {m[1]: m[2].strip() for m in reversed(list(PRIORITIES.finditer(existing)))}
    return next((found[h] + "\n" for h in PRIORITY_HEADINGS if found.get(h)), DEFAULT_PRIORITIES)


def markdown_table(rows: list) -> str:
    """A table of collected rows."""
    if not rows:
        return "_None._\n"
    out = ["| Status | Action | Owner | Review / Due | Register | Latest Source |", "| --- | --- | --- | --- | --- | --- |"]
    for r in rows:
        link = f"[[{(r['register_path'] or '').removesuffix('.md')}|{(r['register_title'] or '').replace('Open Actions - ', '')}]]"
        out.append("| " + " | ".join([r["status"] or "", r["action"] or "", r["owner"] or "", r["review_due"] or "", link, r["latest_source"] or ""]) + " |")
    return "\n".join(out) + "\n"


SYNC_NOTE = "Only the priorities and one's own actions are meant for other task lists; what others owe stays here, and the registers remain the source.\n"


def review_document(actions: DataFrame, today: date, owner: str = "", existing: str = "", registers: list[str] | None = None) -> str:
    """The review of all open actions; a report for people, of which one vault's rows fit on the driver.

    ``registers`` are the paths of the registers read; without them those that have an open action are listed."""
    rows = sections(actions, today, owner).orderBy(*review_order()).collect()
    of = lambda s: markdown_table([r for r in rows if r["section"] == s])
    n = counts(actions, today, owner).first()
    named = f"My Actions ({owner})" if owner else "My Actions"
    if registers is None:
        registers = [r[0] for r in open_actions(actions, today, owner).select("register_path").distinct().orderBy("register_path").collect() if r[0]]
    listed = "".join(f"- [[{p.removesuffix('.md')}]]\n" for p in registers) or "_No action registers found._\n"
    head = f"# Action Review\n\n**Generated:** {today.isoformat()}\n**Registers found:** {len(registers)}\n**Open actions:** {n['open']}\n"
    parts = [head, f"## Priority List\n\n{priority_block(existing)}", f"## Overdue / Due Now\n\n{of('overdue')}", f"## {named}\n\n{of('mine')}"]
    parts += [f"## Needs Review\n\n{of('needs review')}", f"## Waiting On Others\n\n{of('waiting')}"]
    parts += [f"## Registers Included\n\n{listed}", f"## External Todo Sync\n\n{SYNC_NOTE}"]
    return "\n---\n\n".join(parts)


def worklist_document(actions: DataFrame, today: date, owner: str) -> str:
    rows = worklist(actions, today, owner).collect()
    by = {b: [r for r in rows if r["bucket"] == b] for b in ("overdue", "current", "waiting")}
    head = f"# My Open Actions\n\n**Open actions:** {len(rows)} open ({len(by['overdue'])} overdue, {len(by['current'])} current, {len(by['waiting'])} waiting)\n"
    return "\n---\n\n".join([head, *(f"## {b.title()}\n\n{markdown_table(r)}" for b, r in by.items())])


def review_json(actions: DataFrame, today: date, owner: str = "") -> str:
    rows = as_json(open_actions(actions, today, owner).orderBy(*review_order())).collect()
    return json.dumps({"generated": today.isoformat(), "actions": [json.loads(r["json"]) for r in rows]}, ensure_ascii=False, indent=2) + "\n"
