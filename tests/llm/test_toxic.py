import random

import numpy as np
import pytest

from loreloom.llm import toxic as tx

GOOD = ["the budget sheet is late today", "we counted 14 items in the index", "compare the draft with the old survey", "the pig weighs 90 kilos", "this stupid printer ate 12 pages", "word list for the filter: shit, bastard, moron"]
BAD = ["you are a worthless bastard", "shut up you filthy moron", "nobody would miss you, scumbag", "i will break your legs"]


def make(n, seed, noise=0.0):
    rng = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        bad = i % 5 == 0
        parts = [rng.choice(GOOD) for _ in range(rng.randint(2, 8))] + ([rng.choice(BAD)] if bad else [])
        rng.shuffle(parts)
        texts.append(". ".join(parts) + ".")
        y.append(bad != (rng.random() < noise))
    return texts, y


@pytest.fixture(scope="module")
def model():
    return tx.fit(*make(600, 1, 0.04))


def test_held_out_texts(model):
    texts, y = make(400, 2)
    _, found, ranges = tx.score_block(model, texts)
    y = np.array(y)
    assert (found & y).sum() >= 0.95 * y.sum() and (found & ~y).sum() <= 2
    hit = next(i for i in range(400) if found[i] and y[i])
    assert any(w in texts[hit][a:b] for a, b in ranges[hit] for w in ("worthless", "filthy", "miss you", "legs"))


@pytest.mark.parametrize("text", ["YOU ARE A WORTHLESS BASTARD!!", "you are a w0rthless b4stard", "you are a worthless b-a-s-t-a-r-d", "you are a worthless bаstаrd", "you are a wor​thless bastard", "you are a worthless b*****d"])
def test_spellings(model, text):
    assert tx.score_block(model, ["The budget sheet is late today. " + text])[1][0]


def test_words_seen_twice_keep_their_score_at_every_size(monkeypatch):
    texts, y = make(1200, 5)
    texts[0] += " you vile gorbag."
    texts[5] += " you vile gorbag."
    assert "gorbag" in tx.fit(texts, y).ids
    used, inner = [], tx.fit
    monkeypatch.setattr(tx, "fit", lambda t, b, least, **more: used.append((len(t), least)) or inner(t, b, least, **more))
    tx.fit_with_cut(texts, y)
    first = sum(not tx.in_second_half(t) for t in texts)
    assert used == [(1200, tx.LEAST), (first, tx.LEAST), (1200 - first, tx.LEAST)] and 0 < first < 1200
    # copies, whatever their case and layout, share a half
    assert all(tx.in_second_half(t) == tx.in_second_half("  " + t.upper().replace(" ", "\n")) for t in texts[:50])


def test_linear_scan_finds_all_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(1, 14))]
        got = tx.maximal_segments(s)

        def brute(lo, hi):  # the best segment, then the same left and right of it
            best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            top = [(a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1) if sum(s[a:b]) == best[0]]
            return best[0], top

        if got:
            total, top = brute(0, len(s))
            assert max(x[2] for x in got) == total and any((b, e) in top for b, e, t in got if t == total)
            for (_, e, _), (b2, _, _) in zip(got, got[1:]):
                assert e <= b2
        else:
            assert max(s) <= 0
        whole = tx.best_segments(np.array(s, float), np.zeros(len(s), int), 1)[0]
        assert whole == max([0, *(x[2] for x in got)])


def test_best_segments_do_not_cross_texts():
    s = np.array([1.0, 2.0, -5.0, 4.0, 3.0, -1.0, 2.0])
    text = np.array([0, 0, 0, 2, 2, 3, 3])
    assert tx.best_segments(s, text, 5).tolist() == [3.0, 0.0, 7.0, 2.0, 0.0]


def test_bounds_of_the_fit(monkeypatch):
    monkeypatch.setattr(tx, "MAX_WORDS", 12)
    m = tx.fit(*make(200, 1))
    assert len(m.ids) == 12 and "the" in m.ids


def test_tables(spark):
    texts, y = make(200, 3)
    docs = [(i, t, "s1" if i % 2 else "s2", 1) for i, t in enumerate(texts)] + [(900, None, "s1", 1), (901, "", None, 1), (902, "​ \n", "s1", 1), (903, "ok " * 40000, "s1", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, toxic int")
    labels = spark.createDataFrame([(i, int(v), "r") for i, v in enumerate(y)] + [(0, 0, "r"), (0, 1, "q"), (None, 1, "r"), (5, None, "r"), (901, 1, None)], "doc_id long, toxic int, reviewer string")
    rows = {r["doc_id"]: r for r in tx.toxic_scores(df, labels).collect()}
    assert len(rows) == 204
    assert not any(rows[i]["toxic"] for i in (900, 901, 902, 903)) and rows[900]["score"] == 0
    wrong = sum(rows[i]["toxic"] != v for i, v in enumerate(y))
    assert wrong <= 6
    rates = {r["source"]: r for r in tx.source_rates(tx.toxic_scores(df, labels)).collect()}
    assert set(rates) == {"s1", "s2", None} and sum(r["docs"] for r in rates.values()) == 204


def test_without_reviews_or_documents(spark):
    df = spark.createDataFrame([(1, "you fucking asshole, go to hell you whore", "s"), (2, "the plan is late", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, reviewer string")
    rows = {r["doc_id"]: r["toxic"] for r in tx.toxic_scores(df, labels, seed_words=["fucking", "asshole", "whore"]).collect()}
    assert rows == {1: True, 2: False}
    assert all(r["score"] == 0 and not r["toxic"] for r in tx.toxic_scores(df, labels).collect())
    assert tx.toxic_scores(df.limit(0), labels).collect() == []
