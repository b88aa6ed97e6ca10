import pytest

from loreloom.llm import canonical

TOPICS = [
    (1, "Noustor Inventory", None, None), (2, "Umilöth Harbor Review", None, "UHR"), (3, "Movant Council 1", None, None), (4, "Movant Council 2", None, " "),
    (5, "Thaustum Gearbox Sandbox", "team", "Code ORE119"), (6, "Briltard Harbor", None, None), (7, "Thaustum Gearbox", None, None), (8, "Brul Hothouse Index", None, "BHI"), (9, "Heindix Beacon", None, None),
]
CASES = {
    "Noustor Inventory": 1, "noustor inventory.md": 1, "2-Areas/NOUSTOR INVENTORY#Scope": 1, "Inventory, Noustor": 1, "Nuostor Inventoory": 1, "Nоustor Inventory": 1,
    "Nous-tor Inventory": 1, "[[Noustor Inventory|x]]": 1, "\U0001f4cc noustor  inventory": 1, "noustor inv.": 1, "see Noustor Inventory": 1, "Noustor/Inventory.md": 1, "3-Resources/misc/Noustor/Inventory": 1, "2-Areas/Noustor Inventory": 1, "../Movant/Council/2": 4, "Topics/": -1,
    "Umilth Harbor Review": 2, "Umiloth Review": 2, "u.h.r.": 2, "Umil-vi": -1, "b.h.i.": 8, "Heind ix Beacon": 9, "heind-ix beacon": 9, "UHR#notes": 2, "Umiloeth Harbor Review": 2, "Movant Council I": 3, "movant council no. 2": 4, "Movant Council 02": 4,
    "Movant Council": -1, "Movant Council 7": -1, "Harbor": -1, "Noustor Inventory Eclipse": -1, "Noustor Harbor": -1, "2024-05-01": -1, "clip-12.mp4": -1, "...": -1,
    "ore119": 5, "ORE118": -1, "Thaustum Gearbox": 7, "Thaustum Gearbox Sandbox": 5, "Thaustum": -1, "x" * 5000: -1,
}


@pytest.fixture(scope="module")
def mapped(spark):
    links = [(i, None if i % 2 else "", t, 1, "w") for i, t in enumerate(CASES)]
    links += [(1000, None, None, 1, "w"), (1001, None, "  ", 1, "w"), (1002, "somewhere.md", "Noustor Inventory", 1, "w"), (1003, None, "Noustor Inventory", 1, "w")]
    df = spark.createDataFrame(links, "link_id long, target_path string, target string, entry int, words string")
    topics = spark.createDataFrame(TOPICS, "topic_id long, name string, kind string, aka string")
    rows = canonical.unresolved_topics(df, topics).collect()
    assert len(rows) == len(CASES) + 1
    return {r["link_id"]: r["topic_id"] for r in rows}


@pytest.mark.parametrize("i,typed", list(enumerate(CASES)))
def test_each_writing(mapped, i, typed):
    assert mapped[i] == CASES[typed], typed


def test_repeated_rows_keep_their_row(mapped):
    assert mapped[1003] == 1


def test_empty_tables(spark):
    links = spark.createDataFrame([(1, None, "Noustor")], "link_id long, target_path string, target string")
    topics = spark.createDataFrame(TOPICS, "topic_id long, name string, kind string, aka string")
    assert [r["topic_id"] for r in canonical.unresolved_topics(links, topics.limit(0)).collect()] == [-1]
    assert canonical.unresolved_topics(links.limit(0), topics).collect() == []


def test_the_segment_join_misses_no_pair(spark):
    import random

    rng = random.Random(5)
    ref = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    typed = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(120)]
    r, t = spark.createDataFrame([(x,) for x in ref], "ref string"), spark.createDataFrame([(x,) for x in typed], "typed string")
    got = {(x["typed"], x["ref"]) for x in canonical.similar_pairs(t, r, canonical.edits).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    allowed = lambda n: 0 if n <= 3 else 1 if n == 4 else 2
    want = {(a, b) for a in typed for b in ref if (d := distance(a, b)) <= allowed(len(b)) and (d < 2 or sorted(a) == sorted(b) or len(b) >= 7)}
    assert got == want


def test_exact_writings_come_before_folded_ones(spark):
    topics = spark.createDataFrame([(1, "Coed", None), (2, "Cod", None), (3, "Value Poem", None)], "topic_id long, name string, aka string")
    typed = ["Coed", "cod", "Value poem", "Valü Pom", "a/" * 40 + "Cod", "x/" * 5000 + "Value Poem", "Cod 5", "Cod/5/5", " ".join(["cod"] * 1500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "id long, target string")
    got = {r["value"]: r["entry"] for r in canonical.map_values(rows, "target", topics, "topic_id", ["name", "aka"]).collect()}
    assert [got[t] for t in typed] == [1, 2, 3, 3, 2, 3, -1, -1, -1]
