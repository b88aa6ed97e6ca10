from functools import lru_cache
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreloom.llm import bpe
from loreloom.llm import chunking as ch


def check(text, limit, overlap):
    pieces = ch.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, _), (s2, e2, _) in zip(pieces, pieces[1:]):
        assert s < s2 <= e < e2 and e - s2 <= overlap
    assert all(0 < e - s <= limit for s, e, _ in pieces)
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n#あ。\r", min_size=1, max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = check(text, limit, overlap)
    run = max(map(len, ch.regex.split(r"\s+", text)))
    assert ch.Boundaries(text).longest_run == run
    if run <= limit:
        assert all(kind != "hard" for _, _, kind in pieces)


def test_headings_come_first_and_words_begin_pieces():
    text = "word " * 500 + "\n## Head\n" + "more " * 700
    pieces = check(text, 4000, 200)
    assert pieces[0][2] == "heading" and text[pieces[0][1] :].startswith("## Head")
    assert 180 < pieces[0][1] - pieces[1][0] <= 200 and text[pieces[1][0] - 1] == " "


def test_hard_cuts_step_back_the_whole_overlap():
    pieces = check("x" * 9000, 4000, 200)
    assert [p[:2] for p in pieces] == [(0, 4000), (3800, 7800), (7600, 9000)]


def test_windows_lines_and_very_long_text():
    text = ("line of words here\r\n" * 40 + "\r\n") * 600
    pieces = check(text, 4000, 200)
    assert {k for _, _, k in pieces} == {"paragraph", "end"}


def test_table_with_dirt(spark):
    long, run = "word " * 1000, "y" * 4001 + " z"
    notes = spark.createDataFrame(
        [("a", long, 2.0, "k"), ("a", "short now", 1.0, "k"), ("a", long, 2.0, "k"), ("b", "short", 2.0, "k"), ("b", long, 1.0, "k"), ("c", None, 1.0, "k"), ("d", "", 1.0, "k"), (None, long, 1.0, "k"), ("e", run, None, "k"), ("f", "z" * 4000, 1.0, "k")],
        "path string, body string, mtime double, key string",
    )
    found = {tuple(r) for r in ch.oversized_notes(notes).collect()}
    assert found == {("a", "soft"), ("e", "hard")}
    assert ch.note_pieces(notes.limit(0)).collect() == []
    rows = sorted(ch.note_pieces(notes).filter("path = 'a'").collect(), key=lambda r: r["piece_no"])
    assert all(long[r["start"] : r["end"]] == r["piece"] for r in rows) and len(rows) == 2


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        ch.split_oversized(None, "k", "t", 100, 100)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n#あ\U0001f600。\r", min_size=1, max_size=200), st.integers(6, 30), st.integers(0, 5))
def test_pieces_measured_in_tokens(text, limit, overlap):
    units = ch.token_starts(encoder(), text)
    count = lambda s, e: int(((units >= s) & (units < e)).sum())
    pieces = ch.split_text(text, limit, overlap, units)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, _), (s2, e2, _) in zip(pieces, pieces[1:]):
        assert s < s2 <= e < e2 and count(s2, e) <= overlap
    assert all(0 < count(s, e) <= limit for s, e, _ in pieces)


@lru_cache
def encoder():
    return bpe.SpeculativeBpe()


def test_token_starts_are_prefix_sums():
    text = "naïve \U0001f600 text"
    ids, _ = encoder().encode_block([text])
    begin, at = [], 0
    for i in ids.tolist():
        begin.append(len(text.encode()[:at].decode("utf-8", "ignore")))
        at += len(encoder().bytes_of[i])
    assert ch.token_starts(encoder(), text).tolist() == begin


def test_table_in_tokens_and_checks(spark):
    rows = [("a", "word and words " * 900), ("b", "short"), ("c", None), ("d", "x" * 9000 + " " + "y z. " * 900), ("e", "q" * 3900 + " " + "r" * 3950 + " s")]
    df = spark.createDataFrame(rows, "path string, body string")
    toks = ch.split_oversized(df, "path", "body", 500, 50, "tokens").collect()
    assert {r["key"] for r in toks} == {"a", "d", "e"} and all(0 < r["units"] <= 500 for r in toks)
    pieces = ch.split_oversized(df, "path", "body").withColumnRenamed("key", "path")
    for r in ch.piece_checks(pieces).collect():
        text = dict(rows)[r["path"]]
        assert r["n_chars"] == len(text) and r["text_hash"] == sha256(text.encode()).hexdigest(), r
        assert (r["pieces_over"], r["gaps"], r["overlaps_over"], r["overlaps_short"], r["hard_cuts_in_soft"]) == (0, 0, 0, 0, 0), r
    with pytest.raises(ValueError):
        ch.split_oversized(df, "path", "body", measure="lines")
