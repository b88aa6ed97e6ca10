from loreloom.llm import term_frequency as tf


def rows(df):
    return {(r["tag"], r["uses"], r["records"], r["mark"]) for r in df.collect()}


def test_current_rows_marks_and_dirt(spark):
    notes = spark.createDataFrame(
        [(f"p{i}", "common  common　both" if i < 5 else "rest", 1.0, 7) for i in range(30)]
        + [("p0", "old tags", 0.5, 1), ("p1", "common  common　both", 1.0, 1), ("p40", None, None, 1), ("p41", "  ", 1.0, 1), (None, "lost", 1.0, 1), ("p42", "", 3.0, 1)],
        "path string, tags string, mtime double, term int",
    )
    runs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, None), (None, "zz")], "run_id long, tag string")
    got = rows(tf.tag_frequency(notes, runs))
    assert ("common", 10, 5, "common") in got and ("both", 5, 5, "common") in got
    assert ("rest", 25, 25, "common") in got
    assert ("a", 2, 1, "rare") in got and ("b", 1, 1, "rare") in got
    assert not [r for r in got if r[0] in ("old", "lost", "zz", "")]


def test_rare_comes_before_common_and_nothing_gives_nothing(spark):
    two = spark.createDataFrame([("a", "x"), ("b", "x")], "r string, t string")
    assert [r["mark"] for r in tf.term_frequency(two, "r", "t").collect()] == ["rare"]
    assert tf.term_frequency(two.limit(0), "r", "t").collect() == []


def test_words_are_kept_as_written(spark):
    df = spark.createDataFrame([("r", "#A/b, Ünï\u0085x\u001cy")], "r string, t string")
    assert {r["term"] for r in tf.term_frequency(df, "r", "t").collect()} == {"#A/b,", "Ünï", "x\u001cy"}
