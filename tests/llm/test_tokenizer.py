"""The transducer against the public libraries, and the way back."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landweave.llm.tokenizer import PATTERN, TOKENIZER_PATH, Decoder, Encoder, Merges, RunEncoder, count_tokens, decode_ids, encode_texts, load_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER_PATH), reason="no tokenizer file")
PIECES = ["a", "b", "the ", "ing", "=", "-", " ", "\n", "é", "日", "😀", "'ll", "'s", "0", "12", "  ", "\t", "zzzz", "ab", "​", "\x00"]


@pytest.fixture(scope="module")
def tools():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = load_ranks(open(TOKENIZER_PATH, "rb").read())
    return Encoder(Merges(ranks)), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Decoder(ranks)


def test_random_texts_and_blocks(tools):
    enc, ref, _ = tools
    rng = random.Random(2)
    for _ in range(400):
        some = rng.sample(PIECES, rng.choice([1, 2, 4, len(PIECES)]))
        x = "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 10, 60, 300])))
        want = ref.encode_ordinary(x)
        assert list(enc.encode(x)) == want
        k = rng.choice([1, 2, 3, 7, 64])
        assert list(enc.stream((x[i : i + k] for i in range(0, len(x), k)), longest_piece=rng.choice([4, 20, 100]))) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(tools, x):
    enc, ref, dec = tools
    ids = enc.encode(x)
    assert list(ids) == ref.encode_ordinary(x)
    assert "".join(dec.feed([i]) for i in ids) + dec.finish() == x


def test_memory_is_bounded(tools):
    enc, ref, _ = tools
    for unit in ("ab", "a", "=", "hello"):
        run, out, most = RunEncoder(enc.m), [], 0
        for _ in range(3000):
            out += run.feed(unit.encode())
            most = max(most, len(run.text))
        out += run.finish()
        assert out == [i for i in ref.encode_ordinary(unit * 3000)]
        assert most <= 2 * enc.m.lookahead + enc.m.longest


def test_cache_is_bounded(tools):
    enc = Encoder(tools[0].m, kept=10)
    assert enc.encode(" ".join(f"w{i}" for i in range(99))) == tools[0].encode(" ".join(f"w{i}" for i in range(99)))
    assert len(enc) <= 10


def test_unfinished_characters(tools):
    _, _, dec = tools
    ids = tools[0].encode("😀")
    assert len(ids) > 1 and dec.feed(ids[:1]) == "" and dec.feed(ids[1:]) == "😀" and dec.finish() == ""
    dec.feed(ids[:1])
    assert dec.finish() == "�"


def test_frames(spark, tools):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a  b", "x"), (4, "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_texts(df).collect()), key=str)
    assert got == sorted(((k, tools[1].encode_ordinary(t or "")) for k, t, _ in rows), key=str)
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df).where("doc_id is not null").collect()) == sorted((k, len(i)) for k, i in got if k)
    assert {r.doc_id: r.text for r in decode_ids(encode_texts(df.where("doc_id < 4"))).collect()} == {1: "Hello world", 2: "", 3: ""}
    assert encode_texts(df.limit(0)).count() == 0


def test_every_token_comes_from_the_transducer(tools, monkeypatch):
    enc = Encoder(tools[0].m, kept=0)  # remembers nothing
    rng = random.Random(4)
    for n in (1, 30, 3000, 30_000):
        x = "".join(rng.choice(PIECES) for _ in range(n))
        before = enc.emitted
        assert len(enc.encode(x)) == enc.emitted - before == len(tools[1].encode_ordinary(x))


def test_memory_over_a_long_run(tools):
    import tracemalloc

    enc = Encoder(tools[0].m)
    peaks = []
    for n in (4, 32):
        tracemalloc.start()
        assert sum(1 for _ in enc.stream("abcab" * 100 for _ in range(n))) > n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 100_000


def test_lookahead_suffices(tools):
    """Whatever follows, the tokens that end before the lookahead stay as they are."""
    enc, ref, _ = tools
    rng = random.Random(9)
    ranks = enc.m.ranks
    words = rng.sample(sorted(ranks), 4000)
    tiny = {bytes([b]): i for i, b in enumerate(b"ab")} | {t: 2 + i for i, t in enumerate([b"ab", b"aba", b"ba", b"abab", b"baba", b"bab", b"aa"])}
    for merges, parts in ((enc.m, words), (Merges(tiny), [b"a", b"b", b"ab", b"ba", b"bb"])):
        for _ in range(60):
            text = b"".join(rng.choice(parts) for _ in range(60))
            whole, at, end = merges._merge_strictly(text), rng.randrange(len(text)), 0
            for a, b in zip(merges._merge_strictly(text[:at]), whole, strict=False):
                end += len(a)
                if end > at - merges.lookahead:
                    break
                assert a == b
