import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from loreloom.serve import cli
from loreloom.serve.http import serve

FILES = {
    "a.md": "# Alpha\n\na quick fox #animals", "sub/b.md": "---\ntitle: Beta\n---\nsee [[Alpha]] and [[Gone]]",
    "2-Areas/OPEN-ACTIONS.md": "# Open Actions - Areas\n\n| Status | Action | Owner | Review / Due | First | Source |\n|---|---|---|---|---|---|\n| Open | call | kim | 2020-01-01 | w | x |\n",
}


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("vaults")
    for v, files in (("one", FILES), ("two", {"only.md": "# Only\n\nzebra"})):
        for rel, text in files.items():
            p = base / v / rel
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    return base


def test_commands(spark, roots, tmp_path):
    run = lambda *args: cli.main(["--vault", str(roots / "one"), "--registry", str(tmp_path / "r.toml"), *args], spark)
    assert run("index").startswith("indexed 3 notes (0 removed), 2 links")
    assert run("search", "quick", "fox") == "Alpha  a.md\n(1 results)"
    assert "incoming_link  sub/b.md" in run("expand", "Alpha") and "direct_match  a.md" in run("topic", "fox")
    assert "3 notes, 2 links" in run("stats") and "edge_count: 1" in run("graph")
    assert "dangling_link  sub/b.md" in run("health", "--unresolved") and isinstance(json.loads(run("health", "--json")), list)
    review = run("actions", "--owner", "kim")
    assert "## My Actions (kim)" in review and "**Registers found:** 1" in review and "- [[2-Areas/OPEN-ACTIONS]]" in review
    assert "1 open (1 overdue, 0 current, 0 waiting)" in run("actions", "--owner", "kim", "--mine") and json.loads(run("actions", "--json"))["actions"][0]["action"] == "call"
    assert "# " in run("digest", "--zone", "Asia/Tokyo") and os.path.exists(roots / "one" / "2-Areas" / "_DAILY-DIGEST.md")
    assert run("vaults", "add", str(roots / "one"), "--name", "First one").startswith("first-one  First one")
    assert run("vaults", "remove", str(roots / "one")) == ""


def test_http(spark, roots):
    server = serve(spark, [("one", "One", str(roots / "one")), ("two", "Two", str(roots / "two")), ("one", "again", "nowhere")])
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, method="GET", **headers):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method, headers=headers)
        with urllib.request.urlopen(request, timeout=120) as reply:
            return json.loads(reply.read()), reply.headers

    def status(path, method="GET", **headers):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path, method, **headers)
        return e.value.code

    assert ask("/api/vaults")[0] == {"active": "one", "vaults": [{"slug": "one", "name": "One"}, {"slug": "two", "name": "Two"}]}
    hit = ask("/api/search?q=fox&limit=500")[0]
    assert hit["count"] == 1 and hit["results"][0]["path"] == "a.md" and ">>>fox<<<" in hit["results"][0]["snippet"] and hit["results"][0]["tags"] == ["animals"]
    assert ask("/api/search?q=f")[0]["results"] == []
    other, headers = ask("/api/search?q=zebra&vault=two")
    assert other["count"] == 1 and "loreloom_vault=two" in headers["Set-Cookie"]
    assert ask("/api/stats", Cookie="loreloom_vault=two")[0] == {"note_count": 1, "link_count": 0, "vault_name": "Two"}
    assert ask("/api/stats?vault=nope")[0]["vault_name"] == "One"
    assert ask("/api/health")[0]["stats"]["edge_count"] >= 1
    assert ask("/api/reindex?vault=two", "POST")[0] == {"indexed": 1}
    assert (status("/api/reindex"), status("/api/other"), status("/"), status("/api/stats", Host="evil.example")) == (405, 404, 404, 403)
    server.shutdown()
    server.server_close()
