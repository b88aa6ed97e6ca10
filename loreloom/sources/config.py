"""Vault settings, the registry of vaults, and finding the vault one is in."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.health import HealthConfig
from .vault import DEFAULT_EXCLUDES

MARKER = ".loreloom"
VAULT_ENV = "LORELOOM_VAULT"


@dataclass(frozen=True)
class VaultConfig:
    root: str
    exclude_dirs: tuple[str, ...] = DEFAULT_EXCLUDES
    health: HealthConfig = HealthConfig()
    auto_refresh: bool = True
    debounce_ms: int = 400
    sync_debounce_s: int = 10

    @property
    def index_dir(self) -> str:
        return os.path.join(self.root, MARKER, "index")


def find_up(start: str) -> str | None:
    """The nearest folder at or above ``start`` that has the marker."""
    here = Path(start).resolve()
    return next((str(p) for p in (here, *here.parents) if (p / MARKER).is_dir()), None)


def resolve_vault(explicit: str | None = None, cwd: str | None = None) -> str:
    """An explicit folder, else the environment's, else the nearest marked one above."""
    root = explicit or os.environ.get(VAULT_ENV) or find_up(cwd or os.getcwd())
    if not root:
        raise FileNotFoundError(f"no vault: give one, set {VAULT_ENV}, or work inside a folder with {MARKER}")
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    return os.path.abspath(root)


def load_config(root: str) -> VaultConfig:
    """The vault's config.toml; absent means defaults, malformed raises."""
    path = Path(root, MARKER, "config.toml")
    if not path.exists():
        return VaultConfig(root)
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    known = {f.name for f in fields(HealthConfig)}
    health = {k: tuple(v) if isinstance(v, list) else v for k, v in data.get("health", {}).items() if k in known}
    excludes = tuple(data.get("index", {}).get("exclude_dirs") or DEFAULT_EXCLUDES)
    watch = data.get("watch", {})
    return VaultConfig(
        root, excludes, HealthConfig(**health), bool(data.get("search", {}).get("auto_refresh", True)), int(watch.get("debounce_ms") or 400), int(watch.get("sync_debounce_s") or 10)
    )


def save_config(config: VaultConfig) -> None:
    """Writes config.toml; writing the same settings again changes nothing."""
    value = lambda v: json.dumps(list(v) if isinstance(v, tuple) else v)
    out = ["[index]", f"exclude_dirs = {value(config.exclude_dirs)}", "", "[search]", f"auto_refresh = {value(config.auto_refresh)}", ""]
    out += ["[watch]", f"debounce_ms = {config.debounce_ms}", f"sync_debounce_s = {config.sync_debounce_s}", "", "[health]"]
    out += [f"{f.name} = {value(getattr(config.health, f.name))}" for f in fields(HealthConfig)]
    path = Path(config.root, MARKER, "config.toml")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(out) + "\n", encoding="utf-8")


class Registry:
    """Named vaults in one TOML file; an absent file is an empty registry."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.vaults: list[tuple[str, str]] = []
        if self.path.exists():
            self.vaults = [(v["name"], v["path"]) for v in tomllib.loads(self.path.read_text(encoding="utf-8")).get("vaults", [])]

    def add(self, name: str, root: str) -> bool:
        root = os.path.realpath(root)
        if any(p == root for _, p in self.vaults):
            return False
        self.vaults.append((name, root))
        return True

    def remove(self, root: str) -> bool:
        before = len(self.vaults)
        self.vaults = [(n, p) for n, p in self.vaults if p != os.path.realpath(root)]
        return len(self.vaults) < before

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        out = [f"[[vaults]]\nname = {json.dumps(n)}\npath = {json.dumps(p)}\n" for n, p in self.vaults]
        self.path.write_text("\n".join(out), encoding="utf-8")

    def slugs(self) -> list[tuple[str, str, str]]:
        """(slug, name, path), slugs made distinct by number."""
        seen: dict[str, int] = {}
        out = []
        for name, path in self.vaults:
            s = "-".join(w for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in name).split()) or "vault"
            seen[s] = seen.get(s, 0) + 1
            out.append((s if seen[s] == 1 else f"{s}-{seen[s]}", name, path))
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *v) for i, v in enumerate(self.slugs())], "vault_id int, slug string, name string, path string")
