import random

import pytest

from loreloom.operators import orphans

LINKS = "link_id long, source_path string, target string, target_path string, seen_at double, state string"
NOTES = "path string, mtime double, first_indexed_at double, removed boolean"
REMOVED = "path string, removed_at double"


def tables(spark, links, notes, removed):
    return spark.createDataFrame(links, LINKS), spark.createDataFrame(notes, NOTES), spark.createDataFrame(removed, REMOVED)


def brute(links, notes, removed):
    first, gone = {}, {p for p, _ in removed if p}
    for p, _, f, _ in notes:
        if p:
            first.setdefault(p, None)
            if f is not None:
                first[p] = f if first[p] is None else min(f, first[p])
    out = set()
    for i, s, _, t, seen, _ in links:
        for field, path in (("source_path", s), ("target_path", t)):
            if not path:
                continue
            if path in first:
                if first[path] is not None and seen is not None and first[path] > seen:
                    out.add((i, field, "late"))
            else:
                out.add((i, field, "deleted" if path in gone else "missing"))
    return out


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_equals_brute_force_in_any_batches(spark, batches):
    rng = random.Random(batches)
    names = [f"p{i}" for i in range(14)] + ["", None]
    when = lambda: rng.choice([None, *map(float, range(50))])
    links = [(i, rng.choice(names), "t", rng.choice([*names, *["p0"] * 8]), when(), "x") for i in range(200)]
    notes = [(rng.choice(names[:10] + [None]), when(), when(), False) for _ in range(25)]
    removed = [(rng.choice(names), when()) for _ in range(12)]
    got = [tuple(r) for r in orphans.orphan_links(*tables(spark, links, notes, removed), batches).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(links, notes, removed)


def test_arrivals_settle_and_withdrawals_reopen(spark, tmp_path):
    links, notes, _ = tables(spark, [(1, "a", "t", "b", 5.0, ""), (2, None, "t", "b", 9.0, "")], [("b", 6.0, 7.0, False)], [])
    ledger = orphans.OrphanLedger(spark, str(tmp_path / "ledger"))
    state = lambda: {(r["ref_id"], r["field"]): r["state"] for r in ledger.orphans().collect()}
    ledger.apply(orphans.references(links))
    assert state() == {(1, "source_path"): "missing", (1, "target_path"): "missing", (2, "target_path"): "missing"}
    ledger.apply(parent_events=orphans.arrivals(notes))
    assert state() == {(1, "source_path"): "missing", (1, "target_path"): "late"}
    gone = spark.createDataFrame([("b", 20.0)], REMOVED)
    ledger = orphans.OrphanLedger(spark, str(tmp_path / "ledger"))  # another session goes on with the folder
    ledger.apply(parent_events=orphans.withdrawals(gone))
    assert state() == {(1, "source_path"): "missing", (1, "target_path"): "deleted", (2, "target_path"): "deleted"}
    ledger.apply(parent_events=orphans.withdrawals(gone))  # repeated events are harmless
    again = spark.createDataFrame([("b", 30.0, 30.0, False)], NOTES)
    ledger.apply(parent_events=orphans.arrivals(again))
    assert state() == {(1, "source_path"): "missing", (1, "target_path"): "late"}
    assert {(r["field"], r["state"], r["month"]): r["refs"] for r in ledger.snapshot().collect()} == {("source_path", "missing", "1970-01"): 1, ("target_path", "late", "1970-01"): 1}


def test_empty_tables(spark):
    assert orphans.orphan_links(*tables(spark, [], [], [])).collect() == []
    assert len(orphans.orphan_links(*tables(spark, [(1, "a", "", "", None, "")], [], [])).collect()) == 1


def test_a_stream_feeds_the_ledger_and_touches_few_buckets(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "ledger")
    ledger = orphans.OrphanLedger(spark, folder, [])
    batches = [
        [("reference", i, "target_path", f"p{i % 30}", 5.0) for i in range(90)],
        [("arrival", None, None, "p3", 4.0), ("arrival", None, None, "p4", 9.0)],
        [("removal", None, None, "p5", 6.0), ("withdrawal", None, None, "p3", 20.0)],
    ]
    states, manifests = [], []
    for rows in batches:
        spark.createDataFrame(rows, orphans.FEED).write.mode("append").parquet(src)
        q = spark.readStream.schema(orphans.FEED).parquet(src).writeStream.foreachBatch(ledger.feed()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        states.append({r["path"]: r["state"] for r in ledger.orphans().collect()})
        manifests.append(ledger.store.manifest())
    assert set(states[0].values()) == {"missing"} and len(states[0]) == 30
    assert "p3" not in states[1] and states[1]["p4"] == "late"
    assert states[2]["p3"] == "deleted" and states[2]["p5"] == "deleted" and states[2]["p6"] == "missing"
    moved = [b for b, f in manifests[2]["tables"]["refs"].items() if manifests[1]["tables"]["refs"].get(b) != f]
    assert 1 <= len(moved) <= 2
    assert {r["batch"]: r["n"] for r in ledger.snapshots().groupBy("batch").agg({"refs": "sum"}).withColumnRenamed("sum(refs)", "n").collect()} == {1: 90, 2: 87, 3: 90}
    before = ledger.store.manifest()["n"]
    ledger.apply(epoch=2)  # told again
    assert ledger.store.manifest()["n"] == before
