import random

import pytest

from loreloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def enc():
    return bpe.SpeculativeBpe()


@pytest.fixture(scope="module")
def truth(enc):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def encode(enc, texts):
    out = []
    for a, b in bpe.blocks(texts, 5000):
        ids, ends = enc.encode_block([t or "" for t in texts[a:b]])
        at = [0, *ends.tolist()]
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    return out


def test_every_token_is_its_own_encoding(enc):
    assert all(enc.merge(t) == [i] for t, i in list(enc.ranks.items())[::7])


def test_random_texts_match_the_exact_encoder(enc, truth):
    rng = random.Random(1)
    signs = "ab'sStT dlrevm  \n\t\r\u0085 　１½éñЖ中\U0001f600̀‍.,!-_<|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|>", "don't we'll x'S ''re '", "a" * 9000, "\U0001f600" * 500, " " * 700 + "x", "\r\n \r\n", "ab" * 3000 + " 'd"]
    assert encode(enc, texts) == [truth.encode_ordinary(t) for t in texts]


def test_failing_proposals_are_merged_exactly(enc, truth):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 14))) for _ in range(3000)]
    wrong = sum(enc.propose(w.encode()) != truth.encode_ordinary(w) for w in words)
    assert wrong > 0  # longest match alone is not the encoding
    assert encode(enc, words) == [truth.encode_ordinary(w) for w in words]


def test_caches_restart(enc, truth, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    texts = [f"zq{i} wv{i}" for i in range(50)]
    assert encode(enc, texts) == [truth.encode_ordinary(t) for t in texts]


def test_known_pairs_are_kept_in_order_and_restart(enc, truth, monkeypatch):
    fresh = bpe.SpeculativeBpe()
    texts = [f"zq{i}wvé{i * i}" for i in range(60)]
    want = [truth.encode_ordinary(t) for t in texts]
    assert encode(fresh, texts[:30]) == want[:30] and len(fresh.pair_keys)
    assert encode(fresh, texts) == want
    assert (fresh.pair_keys[1:] > fresh.pair_keys[:-1]).all()
    assert all(fits == (fresh.merge(fresh.bytes_of[k >> 20] + fresh.bytes_of[k & 0xFFFFF]) == [k >> 20, k & 0xFFFFF]) for k, fits in zip(fresh.pair_keys.tolist(), fresh.pair_fits.tolist()))
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    assert encode(bpe.SpeculativeBpe(), texts) == want


def test_tables(spark, truth):
    rows = [(1, "Hello world", 0), (2, None, 0), (3, "", 0), (None, "x y", 0), (1, "Hello world", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out int")
    got = sorted(((r["doc_id"] or -1, r["ids"]) for r in bpe.encode(df).collect()))
    assert got == sorted((i or -1, truth.encode_ordinary(t or "")) for i, t, _ in rows)
    counts = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in bpe.token_counts(df).collect())
    assert counts == sorted((i or -1, len(truth.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert bpe.encode(df.limit(0)).collect() == []


def test_round_trip(spark, data_dir, enc):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in bpe.encode(docs).collect():
        assert b"".join(enc.bytes_of[i] for i in r["ids"]).decode() == (texts[r["doc_id"]] or "")
