import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loreloom.llm import components

SCHEMA = "source_path string, target_path string, id int, seed string"


def brute(pairs):
    lead = {}

    def find(x):
        lead.setdefault(x, x)
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in pairs:
        if a and b:
            ra, rb = find(a), find(b)
            lead[max(ra, rb)] = min(ra, rb)
    return {(find(x), x) for x in lead}


def groups(spark, pairs):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in pairs], SCHEMA)
    return [(r[0], r[1]) for r in components.note_groups(df).collect()]


def test_chains_hubs_cycles_and_dirt(spark):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(160)]
    pairs = [(names[i], names[i + 1]) for i in range(60)]  # a long chain of ordered names
    pairs += [("hub", n) for n in names[70:110]] + [(n, "hub") for n in names[70:80]]
    pairs += [(rng.choice(names[110:]), rng.choice(names[110:])) for _ in range(40)]
    pairs += [("self", "self"), (None, "x"), ("x", ""), ("", ""), (None, None), ("aé", "b")] * 2
    got = groups(spark, pairs)
    assert len(got) == len(set(got))
    assert set(got) == brute(pairs)


def test_no_pairs(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(None, "a"), ("", "b")]) == []


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_random_graphs(spark, pairs):
    pairs = [(f"v{a}", f"v{b}") for a, b in pairs]
    assert set(groups(spark, pairs)) == brute(pairs)


def test_hot_keys_are_joined_apart(spark):
    from loreloom.runtime import heavy_keys, skew_join

    left = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 5) END AS k", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    hot = heavy_keys(left, "k", 5, 10)
    assert "hot" in hot
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, skew_join(left, right, "k", how, hot).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect())), how


def test_names_whose_hashes_meet_are_parted(spark):
    from pyspark.sql import functions as F

    from loreloom.runtime import Scratch

    def few(c, seed=0):  # four hashes only, and more with each further seed
        return F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(4 + 400 * seed))

    pairs = [(f"n{i}", f"n{i + 1}") for i in range(30)]
    df = spark.createDataFrame(pairs, "a string, b string")
    vertices, edges = components._hashed(df, Scratch(spark, "meet"), few)
    name = {r["id"]: r["name"] for r in vertices.collect()}
    assert len(name) == 31
    assert {frozenset((name[r["u"]], name[r["v"]])) for r in edges.collect()} == {frozenset(p) for p in pairs}
