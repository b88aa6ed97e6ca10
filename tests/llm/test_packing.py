from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.llm import packing as pk


def squared(sizes, bins):
    return sum(int(sizes[b].sum()) ** 2 for b in bins)


@pytest.mark.parametrize("seed,low,high", [(1, 1, 400), (2, 300, 1500), (3, 900, 1300), (4, 1, 2047)])
def test_local_search_improves_and_keeps_all(seed, low, high):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(low, high, 400)
    start = [[i] for i in range(400)]  # one document a container
    before = squared(sizes, start)
    bins = pk.local_search(sizes, [list(b) for b in start], 2048)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(sizes[b].sum() <= 2048 for b in bins)
    assert squared(sizes, bins) > before and len(bins) < 400
    best = pk.pack_group(sizes)
    assert len(best) <= len(bins) * 1.05
    if low != 900:  # there most documents are over half a container
        assert len(best) <= 1.05 * -(-sizes.sum() // 2048) + 1


def test_two_for_one_exchange_is_found():
    sizes = np.array([600, 700, 1200, 747])  # 1200 + 747 leaves 101; 600 + 700 for 1200 fills the container
    gain, out, back = pk.best_trade(sizes[[0, 1]], sizes[[2, 3]], 101, -647)
    assert gain == 100 and out == (0, 1) and back == (0,)


def brute_trade(donor, taker, gap, ahead):
    gives = [(x, 1) for x in donor] + [(x + y, 2) for x, y in combinations(donor, 2)]
    backs = [(0, 0)] + [(x, 1) for x in taker] + [(x + y, 2) for x, y in combinations(taker, 2)]
    gains = [g - r for g, n in gives for r, m in backs if (n, m) in {(1, 0), (1, 1), (2, 1), (1, 2)} and max(0, ahead) < g - r <= gap]
    return max(gains, default=max(0, ahead))


def test_best_trade_is_best_of_all():
    rng = np.random.default_rng(11)
    for _ in range(300):
        donor, taker = rng.integers(1, 90, rng.integers(1, 45)), rng.integers(1, 90, rng.integers(1, 45))
        gap, ahead = int(rng.integers(1, 60)), int(rng.integers(-80, 40))
        gain, out, back = pk.best_trade(donor, taker, gap, ahead)
        assert gain == brute_trade(donor.tolist(), taker.tolist(), gap, ahead)
        if out:
            assert len(set(out)) == len(out) and len(set(back)) == len(back) and gain == donor[list(out)].sum() - taker[list(back)].sum()


def test_documents_after_the_64th_take_part_in_pairs():
    donor = np.array([2] * 70 + [5, 7])  # only 5 + 7 gives 12
    assert pk.best_trade(donor, np.array([1, 1]), 11, -100) == (11, (70, 71), (0,))


@pytest.mark.parametrize("seed,low,high", [(1, 500, 1500), (2, 300, 900), (3, 850, 1020)])
def test_no_trade_is_left(seed, low, high):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(low, high, 300)
    bins = pk.local_search(sizes, [[i] for i in range(300)], 2048, neighbours=4)
    fill = [int(sizes[b].sum()) for b in bins]
    for a in range(len(bins)):
        for b in range(len(bins)):
            if a != b and fill[a] < 2048 and fill[b] < 2048:
                ahead = fill[a] - fill[b]
                assert brute_trade(sizes[bins[a]].tolist(), sizes[bins[b]].tolist(), 2048 - fill[b], ahead) == max(0, ahead)


def test_degenerate_groups():
    assert pk.pack_group(np.zeros(0, int)) == []
    assert pk.pack_group(np.array([0, 0])) == [[0, 1]]
    assert sorted(map(len, pk.pack_group(np.array([0, 2047, 2047])))) == [1, 2]


def test_documents(spark):
    text = "word " * 300  # about 300 tokens
    rows = [(i, text, "x") for i in range(40)] + [(100, "word " * 5000, "x"), (101, None, "x"), (102, "", "x"), (103, "word " * 2047 + "word", "x"), (5, text, "x"), (None, "tiny", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container_id string")
    out = pk.fill_containers(df, group_items=8).collect()
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in out:
        fill[r["container_id"]] += r["n_tokens"]
        pieces[r["doc_id"]].append((r["piece_no"], r["start_token"], r["n_tokens"]))
    assert max(fill.values()) <= 2048
    assert len(pieces) == 45 and len(pieces[5]) == 2 and len(pieces[101]) == 1
    big = sorted(pieces[100])
    assert [p[1] for p in big] == [0, 2048, 4096] and big[0][2] == 2048
    assert [p[2] for p in pieces[103]] == [2048]  # exactly one container, not split
    s = pk.container_summary(pk.fill_containers(df)).first()
    assert s["fullest"] <= 2048 and s["containers"] <= s["least_containers"] + 2


def test_regrouping_goes_on_while_items_are_settled(spark, monkeypatch):
    def first_two_of_group(sizes, capacity, neighbours, every):  # settles one pair a group, whatever there is
        return [[0, 1], *([i] for i in range(2, len(sizes)))]

    monkeypatch.setattr(pk, "pack_group", first_two_of_group)
    monkeypatch.setattr(pk.bpe, "token_counts", lambda docs, key, text, vocabulary: docs.withColumn("n_tokens", F.lit(1024).cast("long")))
    df = spark.createDataFrame([(i, "x") for i in range(38)], "doc_id long, text string")
    out = pk.fill_containers(df.coalesce(1), group_items=20).collect()
    assert len(out) == 38 and len({r["doc_id"] for r in out}) == 38
    # two groups at first and, with 34 items left, two again: the old end; now on to a single group
    assert len({r["container_id"].split("-")[0] for r in out}) > 2


def test_few_levels_as_every_group_is_searched_in_full(spark, monkeypatch):
    monkeypatch.setattr(pk.bpe, "token_counts", lambda docs, key, text, vocabulary: docs.withColumn("n_tokens", F.length("text").cast("long")))
    sizes = np.random.default_rng(5).integers(120, 1100, 6000)
    df = spark.createDataFrame([(i, "x" * int(n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    out = pk.fill_containers(df, group_items=1000).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(6000))
    levels = [int(r["container_id"].split("-")[0]) for r in out]
    assert max(levels) <= 2 and sum(level > 0 for level in levels) < 1200  # 1,884 with 48 partners each
    assert len({r["container_id"] for r in out}) <= -(-int(sizes.sum()) // 2048) + 2


def test_a_task_packs_one_group(spark, monkeypatch, tmp_path):
    folder = str(tmp_path)

    def alone(sizes, capacity, neighbours, every):  # notes its task; nothing fits, so there is one level
        import os
        import uuid

        from pyspark import TaskContext

        context = TaskContext.get()
        open(os.path.join(folder, f"{context.stageId()}-{context.partitionId()}-{uuid.uuid4().hex}"), "w").close()
        return [[i] for i in range(len(sizes))]

    monkeypatch.setattr(pk, "pack_group", alone)
    monkeypatch.setattr(pk.bpe, "token_counts", lambda docs, key, text, vocabulary: docs.withColumn("n_tokens", F.lit(1500).cast("long")))
    df = spark.createDataFrame([(i, "x") for i in range(320)], "doc_id long, text string")
    assert len(pk.fill_containers(df, group_items=20).collect()) == 320
    tasks = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()]
    assert len(tasks) == len(set(tasks)) == 16


def test_documents_without_tokens_join_the_fullest():
    bins = pk.pack_group(np.array([0, 1500, 1000, 1048, 0]))
    assert sorted(map(sorted, bins)) == [[0, 2, 3, 4], [1]]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pk.fill_containers(df).collect() == []
