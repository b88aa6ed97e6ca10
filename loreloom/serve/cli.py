"""The command line: ``python -m loreloom.serve.cli [--vault FOLDER] COMMAND``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from ..engine import Engine
from ..operators import actions, health
from ..runtime import local_session
from ..sources.config import Registry, resolve_vault

REGISTRY = os.path.join("~", ".config", "loreloom", "vaults.toml")


def _index(e: Engine, a: argparse.Namespace) -> str:
    done = e.reindex(force=a.force)
    return f"indexed {done.indexed} notes ({done.removed} removed), {e.stats().first()['links']} links"


def _search(e: Engine, a: argparse.Namespace) -> str:
    rows = e.search(" ".join(a.query), a.limit, a.tag, a.path_prefix).orderBy("rank", "path").collect()
    return "\n".join([*(f"{r['title']}  {r['path']}" for r in rows), f"({len(rows)} results)"])


def _expand(e: Engine, a: argparse.Namespace) -> str:
    return "\n".join(f"{r['relationship']}  {r['path']}" for r in e.expand(" ".join(a.note), a.depth, a.limit).collect())


def _topic(e: Engine, a: argparse.Namespace) -> str:
    return "\n".join(f"{r['relevance']}  {r['path']}" for r in e.topic(" ".join(a.text), a.limit, a.path_prefix).collect())


def _stats(e: Engine, a: argparse.Namespace) -> str:
    n, full = e.stats().first(), e.last_full_reindex()
    tags = ", ".join(f"{r['tag']} ({r['n']})" for r in e.top_tags().collect())
    return f"{n['notes']} notes, {n['links']} links\nlast full index: {full.isoformat() if full else 'never'}\ntags: {tags}"


def _health(e: Engine, a: argparse.Namespace) -> str:
    found = e.audit(a.unresolved)
    if a.json:
        return health.findings_json(found)
    rows = found.collect()
    return "\n".join([*(f"{r['type']}  {r['path']}  {r['detail']}" for r in rows), f"({len(rows)} findings)"])


def _graph(e: Engine, a: argparse.Namespace) -> str:
    return "\n".join(f"{k}: {v}" for k, v in e.graph_stats().first().asDict().items())


def _digest(e: Engine, a: argparse.Namespace) -> str:
    return e.digest(a.output, datetime.now(ZoneInfo(a.zone) if a.zone else timezone.utc).astimezone(None if not a.zone else ZoneInfo(a.zone)))


def _actions(e: Engine, a: argparse.Namespace) -> str:
    rows = e.actions(date.today(), a.owner)
    if a.json:
        return actions.review_json(rows, date.today(), a.owner)
    if a.mine:
        return actions.worklist_document(rows, date.today(), a.owner)
    return actions.review_document(rows, date.today(), a.owner, registers=e.register_paths())


def _vaults(e: Engine | None, a: argparse.Namespace) -> str:
    registry = Registry(os.path.expanduser(a.registry))
    if a.action == "add":
        registry.add(a.name or os.path.basename(os.path.abspath(a.folder)), a.folder)
    elif a.action == "remove":
        registry.remove(a.folder)
    if a.action != "list":
        registry.save()
    return "\n".join(f"{slug}  {name}  {path}" for slug, name, path in registry.slugs())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loreloom")
    top.add_argument("--vault", help="folder of the vault; else the environment's, else the marked folder above")
    top.add_argument("--registry", default=REGISTRY, help="file that lists the vaults")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *arguments: tuple[str, dict]) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag, options in arguments:
            p.add_argument(flag, **options)
        p.set_defaults(run=run)
        return p

    limit, prefix = ("--limit", {"type": int, "default": 10}), ("--path-prefix", {"default": None})
    words = {"nargs": "+"}
    command("index", _index, ("--force", {"action": "store_true"}))
    command("search", _search, ("query", words), limit, ("--tag", {"default": None}), prefix)
    command("expand", _expand, ("note", words), ("--depth", {"type": int, "default": 1}), limit)
    command("topic", _topic, ("text", words), limit, prefix)
    command("stats", _stats)
    command("health", _health, ("--unresolved", {"action": "store_true"}), ("--json", {"action": "store_true"}))
    command("graph", _graph)
    command("digest", _digest, ("--output", {"default": "2-Areas/_DAILY-DIGEST.md"}), ("--zone", {"default": None}))
    command("actions", _actions, ("--owner", {"default": ""}), ("--mine", {"action": "store_true"}), ("--json", {"action": "store_true"}))
    vaults = command("vaults", _vaults, ("action", {"choices": ("list", "add", "remove"), "nargs": "?", "default": "list"}), ("folder", {"nargs": "?"}), ("--name", {"default": None}))
    vaults.set_defaults(no_engine=True)
    command("serve", lambda e, a: "", ("--port", {"type": int, "default": 8420})).set_defaults(no_engine=True, serves=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs one command; returns what it printed."""
    a = parser().parse_args(argv)
    if getattr(a, "serves", False):
        from .http import serve

        known = Registry(os.path.expanduser(a.registry)).slugs()
        targets = known if known and not a.vault else [("vault", os.path.basename(root := resolve_vault(a.vault)), root)]
        serve(spark or local_session(), targets, a.port).serve_forever()
    engine = None if getattr(a, "no_engine", False) else Engine(spark or local_session(), resolve_vault(a.vault))
    text = a.run(engine, a)
    print(text)
    return text


if __name__ == "__main__":
    main(sys.argv[1:])
