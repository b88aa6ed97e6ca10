"""JSON over HTTP for one or several vaults, for programs on the same machine.

``/api/search`` (q, limit, tag, path_prefix), ``/api/stats``, ``/api/health``, ``/api/vaults`` and, by POST,
``/api/reindex``. The parameter ``vault`` names a vault by its slug and is remembered in a cookie; without
either the first vault answers. Only hosts that mean this machine are served, so that a foreign page which
points its name here cannot read notes.
"""

from __future__ import annotations

import json
import threading
import time
from http.cookies import CookieError, SimpleCookie
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import markdown as md
from ..operators import search

LOOPBACK = ("127.0.0.1", "localhost", "::1")
COOKIE = "loreloom_vault"


class Vaults:
    """Engines by slug, opened and built when first asked."""

    def __init__(self, spark: SparkSession, targets: list[tuple[str, str, str]]):
        if not targets:
            raise ValueError("no vault to serve")
        self.spark, self._engines, self._lock = spark, {}, threading.Lock()
        self.targets: dict[str, tuple[str, str]] = {}
        for slug, name, root in targets:
            self.targets.setdefault(slug, (name, root))

    def active(self, asked: str | None, remembered: str | None) -> str:
        return next((s for s in (asked, remembered) if s in self.targets), next(iter(self.targets)))

    def engine(self, slug: str) -> Engine:
        with self._lock:
            if slug not in self._engines:
                engine = Engine(self.spark, self.targets[slug][1])
                engine.reindex()
                self._engines[slug] = engine
            return self._engines[slug]

    # --- answers ---

    def search(self, slug: str, p: dict[str, str]) -> dict:
        q = p.get("q", "").strip()
        if len(q) < 2:
            return {"query": q, "count": 0, "ms": 0.0, "results": []}
        try:
            limit = min(50, max(1, int(p.get("limit", 20))))
        except ValueError:
            limit = 20
        t = time.time()
        hits = search.search(self.engine(slug).index.full_text(), q, limit, p.get("tag"), p.get("path_prefix"))
        rows = hits.withColumn("uri", md.note_uri("path", self.targets[slug][0])).orderBy("rank", "path").collect()  # ``limit`` rows
        items = [{"title": r["title"], "path": r["path"], "snippet": r["snippet"], "tags": (r["tags"] or "").split(), "obsidian": r["uri"]} for r in rows]
        return {"query": q, "count": len(items), "ms": round((time.time() - t) * 1000, 1), "results": items}

    def stats(self, slug: str, p: dict[str, str]) -> dict:
        row = self.engine(slug).stats().first()
        return {"note_count": row["notes"], "link_count": row["links"], "vault_name": self.targets[slug][0]}

    def health(self, slug: str, p: dict[str, str]) -> dict:
        engine = self.engine(slug)
        findings = [r.asDict() for r in engine.audit().collect()]  # a report for people
        return {"findings": findings, "stats": engine.graph_stats().first().asDict()}

    def reindex(self, slug: str, p: dict[str, str]) -> dict:
        return {"indexed": self.engine(slug).reindex(force=True).indexed}


class Handler(BaseHTTPRequestHandler):
    vaults: Vaults
    READ, WRITE = ("search", "stats", "health"), ("reindex",)

    def do_GET(self) -> None:  # noqa: N802
        self._answer()

    do_POST = do_GET  # noqa: N815

    def _answer(self) -> None:
        host = urlsplit(f"//{self.headers.get('Host', '')}").hostname
        if host not in LOOPBACK:
            return self._send(403, {"error": "only this machine is served"})
        url = urlsplit(self.path)
        params = {k: v[0] for k, v in parse_qs(url.query).items()}
        jar = SimpleCookie()
        try:
            jar.load(self.headers.get("Cookie", ""))
        except CookieError:
            pass
        asked = params.get("vault")
        slug = self.vaults.active(asked, jar[COOKIE].value if COOKIE in jar else None)
        cookie = f"{COOKIE}={slug}; Path=/; HttpOnly; SameSite=Strict" if asked == slug else None
        part = url.path.removeprefix("/api/") if url.path.startswith("/api/") else ""
        if part == "vaults":
            known = [{"slug": s, "name": n} for s, (n, _) in self.vaults.targets.items()]
            return self._send(200, {"active": slug, "vaults": known}, cookie)
        if part not in self.READ + self.WRITE:
            return self._send(404, {"error": "no such path"})
        if part in self.WRITE and self.command != "POST":
            return self._send(405, {"error": "POST only"})
        try:
            self._send(200, getattr(self.vaults, part)(slug, params), cookie)
        except Exception as e:  # noqa: BLE001  told to the caller, the server goes on
            self._send(500, {"error": type(e).__name__})

    def _send(self, status: int, body: dict, cookie: str | None = None) -> None:
        data = json.dumps(body, ensure_ascii=False, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json; charset=utf-8")
        self.send_header("Cache-Control", "no-store")
        self.send_header("Content-Length", str(len(data)))
        if cookie:
            self.send_header("Set-Cookie", cookie)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args: object) -> None:
        pass


def serve(spark: SparkSession, targets: list[tuple[str, str, str]], port: int = 0) -> ThreadingHTTPServer:
    """A server of the (slug, name, root) vaults on the loopback address; the caller runs ``serve_forever``."""
    handler = type("VaultHandler", (Handler,), {"vaults": Vaults(spark, targets)})
    return ThreadingHTTPServer(("127.0.0.1", port), handler)
