import os
from datetime import datetime, timezone

import pytest

from loreloom.engine import Engine
from loreloom.sources import captions, config
from loreloom.sources.vault import read_vault
from loreloom.streaming.watch import watch


def put(root, rel, text, mtime=None):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    if mtime:
        os.utime(p, (mtime, mtime))


@pytest.fixture
def vault(tmp_path):
    root = str(tmp_path / "vault")
    put(root, "a.md", "# Alpha\n\na fox #animals", 1_700_000_000)
    put(root, "sub/b.md", "---\ntitle: Beta\n---\nsee [[Alpha]] and [[Missing]]", 1_700_000_001)
    put(root, ".obsidian/skip.md", "secretcanary")
    put(root, "_DAILY.md", "kept despite its name")
    put(root, "no.MD", "not a note")
    os.symlink("/etc/hostname", os.path.join(root, "leak.md"))
    os.symlink(os.path.join(root, "sub"), os.path.join(root, "loop"))
    return root


def state(engine):
    notes = sorted((r["path"], r["title"], r["content_hash"]) for r in engine.notes.collect())
    links = sorted((r["source_path"], r["target"], str(r["target_path"])) for r in engine.links.collect())
    return notes, links


def test_listing(spark, vault):
    rows = {r["path"]: r["raw"] for r in read_vault(spark, vault).collect()}
    assert sorted(rows) == ["_DAILY.md", "a.md", "sub/b.md"]
    listed = read_vault(spark, vault, content=False).filter("path = 'a.md'").first()
    assert listed["mtime"] == 1_700_000_000_000.0


def test_full_incremental_and_streamed_builds_agree(spark, vault, tmp_path):
    e = Engine(spark, config.VaultConfig(vault, auto_refresh=False))
    r = e.reindex()
    assert (r.indexed, r.removed) == (3, 0)
    assert state(e)[1] == [("sub/b.md", "Alpha", "a.md"), ("sub/b.md", "Missing", "None")]
    assert (e.refresh().indexed, e.refresh().removed) == (0, 0)
    put(vault, "Missing.md", "now here [[Beta]]")
    put(vault, "x/Alpha.md", "another alpha")
    os.remove(os.path.join(vault, "_DAILY.md"))
    r = e.refresh()
    assert (r.indexed, r.removed) == (2, 1)
    links = state(e)[1]
    # the base name of the new note comes before the title of the old one
    assert ("sub/b.md", "Alpha", "x/Alpha.md") in links and ("sub/b.md", "Missing", "Missing.md") in links
    full = Engine(spark, config.VaultConfig(vault, auto_refresh=False))
    full.index.dir = str(tmp_path / "other")
    full.reindex(force=True)
    assert state(full) == state(e)
    os.remove(os.path.join(vault, "x/Alpha.md"))
    q = watch(spark, vault, e.index, str(tmp_path / "ckpt"), once=True)
    q.awaitTermination(120)
    assert q.exception() is None
    put(vault, "a.md", "# Alpha\n\nedited")
    watch(spark, vault, e.index, str(tmp_path / "ckpt"), once=True).awaitTermination(120)
    full.reindex(force=True)
    assert state(full)[1] == state(e)[1] and "edited" in e.notes.filter("path = 'a.md'").first()["body"]
    assert e.last_full_reindex() is not None and not e.is_stale()


def test_engine_answers(spark, vault):
    e = Engine(spark, vault)
    e.reindex()
    assert [r["path"] for r in e.search("fox").collect()] == ["a.md"]
    assert e.search("secretcanary").collect() == []
    assert e.web_search("f").collect() == []
    assert {r["path"]: r["relationship"] for r in e.expand("Alpha").collect()} == {"sub/b.md": "incoming_link"}
    assert e.stats().first().asDict() == {"notes": 3, "links": 2}
    assert e.top_tags().first()["tag"] == "animals"
    assert e.resolve("beta").first()["target_path"] == "sub/b.md"
    assert {r["type"] for r in e.audit(True).collect()} >= {"dangling_link"}
    assert e.graph_stats().first()["edge_count"] == 1


def test_digest_reports_content_changes_once(spark, vault):
    e = Engine(spark, config.VaultConfig(vault, auto_refresh=False))
    first = e.digest(now=datetime(2023, 11, 15, 12, tzinfo=timezone.utc))
    assert "[[a|Alpha]] — new" in first
    os.utime(os.path.join(vault, "a.md"), (1_700_100_000, 1_700_100_000))
    assert "No vault activity" in e.digest(now=datetime(2023, 11, 16, 12, tzinfo=timezone.utc))
    put(vault, "a.md", "# Alpha\n\nchanged", 1_700_200_000)
    assert "[[a|Alpha]] — updated" in e.digest(now=datetime(2023, 11, 17, 12, tzinfo=timezone.utc))


def test_settings_and_registry(spark, vault, tmp_path, monkeypatch):
    c = config.load_config(vault)
    assert c.health.stub_threshold == 20
    config.save_config(config.VaultConfig(vault, health=c.health.__class__(stub_threshold=7, exclude_from_graph=("Home",))))
    assert config.load_config(vault).health.stub_threshold == 7 and config.load_config(vault).health.exclude_from_graph == ("Home",)
    monkeypatch.delenv(config.VAULT_ENV, raising=False)
    assert config.resolve_vault(cwd=os.path.join(vault, "sub")) == os.path.realpath(vault)
    with pytest.raises(FileNotFoundError):
        config.resolve_vault(cwd=str(tmp_path))
    reg = config.Registry(str(tmp_path / "r.toml"))
    assert reg.add("My Vault", vault) and not reg.add("again", vault) and reg.add("my vault!", str(tmp_path))
    reg.save()
    again = config.Registry(str(tmp_path / "r.toml"))
    assert [s for s, *_ in again.slugs()] == ["my-vault", "my-vault-2"] and again.to_df(spark).count() == 2
    assert again.remove(vault) and not again.remove(vault)


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:01.000 --> 00:02.000\n<c>hello</c> there\n\n00:02.000 --> 00:03.000\nhello there\nnext line\n"
    df = spark.createDataFrame([(vtt,), (None,), ("",)], "raw string")
    assert [r[0] for r in df.select(captions.flatten("raw")).collect()] == ["hello there next line", None, ""]


def test_a_refresh_writes_the_touched_buckets_alone(spark, vault):
    for i in range(40):
        put(vault, f"n/{i}.md", f"# Note {i}\n\nword{i} [[Alpha]]", 1_700_000_000 + i)
    e = Engine(spark, config.VaultConfig(vault, auto_refresh=False))
    e.reindex()
    before = e.index.store.manifest()
    put(vault, "n/7.md", "# Seven\n\nnewword", 1_700_100_000)
    os.remove(os.path.join(vault, "n/8.md"))
    assert tuple(vars(e.refresh()).values()) == (1, 1)
    after = e.index.store.manifest()
    moved = [b for b, f in after["tables"]["notes"].items() if before["tables"]["notes"].get(b) != f]
    assert 1 <= len(moved) <= 2 and len(after["segments"]["postings"]) == 2
    find = lambda q: sorted(r["path"] for r in e.search(q).collect())
    assert find("newword") == ["n/7.md"] and find("word7") == [] and find("word8") == [] and find("word9") == ["n/9.md"]
    for k in range(9):  # segments are joined when they get many
        put(vault, "n/7.md", f"# Seven\n\nlater{k}", 1_700_200_000 + k)
        e.refresh()
    assert len(e.index.store.manifest()["segments"]["postings"]) <= 9
    assert find("later8") == ["n/7.md"] and find("later7") == [] and find("newword") == [] and find("word9") == ["n/9.md"]
    with pytest.raises(FileExistsError):
        stale, fresh = e.index.store.begin(), e.index.store.begin()
        fresh.commit({})
        stale.commit({})


def test_links_of_an_older_index(spark, vault):
    e = Engine(spark, config.VaultConfig(vault, auto_refresh=False))
    e.reindex()
    e.index.migrate_links(spark.createDataFrame([("sub/b.md", "Alpha"), ("sub/b.md", "Missing")], "source_path string, target string"))
    assert state(e)[1] == [("sub/b.md", "Alpha", "a.md"), ("sub/b.md", "Missing", "None")]
    kept = [("sub/b.md", "Alpha", "elsewhere.md")]
    e.index.migrate_links(spark.createDataFrame(kept, "source_path string, target string, target_path string"))
    assert state(e)[1] == kept


def test_writes_wait_each_for_itself_and_deletions_do_not(vault, tmp_path):
    from loreloom.sources.vault import VaultStream

    s = VaultStream({"path": vault, "state": str(tmp_path / "state"), "debounce_ms": "60000"})
    off = s.initialOffset()

    def look():
        nonlocal off
        end = s.latestOffset()
        rows = [(r[0], r[1]) for p in s.partitions(off, end) for r in s.read(p)]
        again = [(r[0], r[1]) for p in s.partitions(off, end) for r in s.read(p)]
        assert rows == again  # a batch that runs again tells the same
        s.commit(off)
        off = end
        return sorted(rows)

    assert look() == [("_DAILY.md", "write")][:0] + [("a.md", "write"), ("sub/b.md", "write")]  # _DAILY.md was just written
    os.utime(os.path.join(vault, "_DAILY.md"), (1_700_000_000, 1_700_000_000))
    put(vault, "deep/er/still/new.md", "x", 1_700_000_009)
    put(vault, "a.md", "busy")
    os.remove(os.path.join(vault, "sub/b.md"))
    os.rmdir(os.path.join(vault, "sub"))
    assert look() == [("_DAILY.md", "write"), ("deep/er/still/new.md", "write"), ("sub/b.md", "delete")]
    os.utime(os.path.join(vault, "a.md"), (1_700_000_500, 1_700_000_500))
    assert look() == [("a.md", "write")]
    assert look() == []


def test_one_call_after_a_quiet_spell():
    from loreloom.streaming.sync import AfterQuiet

    now, calls, busy = [0.0], [], iter([True, False, True, False, False, False, True, False])
    step = AfterQuiet(lambda df, e: next(busy), lambda: calls.append(now[0]), 10, lambda: now[0])
    for at in (0, 9, 12, 15, 22, 40, 50, 61):
        now[0] = at
        step(None, at)
    assert calls == [22, 61]


def test_git_sync(vault, tmp_path):
    import shutil
    import subprocess

    from loreloom.streaming.sync import git_sync

    if not shutil.which("git"):
        pytest.skip("no git")
    git = lambda root, *a: subprocess.run(("git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a), check=True, capture_output=True)
    with pytest.raises(NotADirectoryError):
        git_sync(vault)
    far, other = str(tmp_path / "far.git"), str(tmp_path / "other")
    subprocess.run(("git", "init", "-q", "--bare", far), check=True)
    for root in (vault,):
        git(root, "init", "-q")
        git(root, "config", "user.name", "n")
        git(root, "config", "user.email", "e@x")
    assert git_sync(vault) == "committed" and git_sync(vault) == "clean"
    git(vault, "remote", "add", "origin", far)
    git(vault, "push", "-q", "-u", "origin", "HEAD")
    subprocess.run(("git", "clone", "-q", far, other), check=True)
    put(other, "from-far.md", "x")
    git(other, "add", "-A")
    git(other, "commit", "-q", "-m", "far")
    git(other, "push", "-q")
    put(vault, "near.md", "y")
    assert git_sync(vault) == "exchanged" and os.path.exists(os.path.join(vault, "from-far.md"))
    put(other, "a.md", "theirs")
    git(other, "commit", "-qam", "theirs")
    git(other, "pull", "-q", "--rebase")
    git(other, "push", "-q")
    put(vault, "a.md", "ours")
    assert git_sync(vault) == "conflict" and open(os.path.join(vault, "a.md")).read() == "ours"
