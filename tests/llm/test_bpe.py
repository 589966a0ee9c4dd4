import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import bpe, token_ids
from stratalog.llm.bpe import CHUNK, Bpe, Encoder

from ..conftest import rows

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def enc():
    return Encoder(Bpe.load(token_ids.public_path(token_ids.VOCABULARY)))


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "a", " ", "Hello  world\n\n\tx ", "it's they're WE'LL 'd", "日本語 ünï 🙂👩‍👩‍👧 e\u0301\u200b", "<|endoftext|> x", "x" * 5000, " " * 3000 + "y", "\r\n" * 100, "1234567890" * 30, "a'" * 300, "\ufeff\u00a0x"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_agree_with_the_library(enc, other, text):
    assert enc.encode(text) == other(text)
    assert "".join(enc.decode(enc.encode(text))) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=120))
def test_round_trip(text):
    e = Encoder(Bpe.load(token_ids.public_path(token_ids.VOCABULARY))) if not hasattr(test_round_trip, "e") else test_round_trip.e
    test_round_trip.e = e
    assert "".join(e.decode(e.encode(text))) == text


def joined(parts):
    """Pieces of what pieces() gives."""
    out, open_part = [], ""
    for found, part, ends in parts:
        out += found
        open_part += part
        if ends:
            out.append(open_part)
            open_part = ""
    assert not open_part
    return out


def test_pieces_do_not_depend_on_chunks(enc, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 16)
    rng = random.Random(2)
    texts = ["they're  a\n\n b'll x   " * 30, "aaa " * 50 + " " * 40 + "'" + "s" * 9, "x" * 90 + "'re " + "1" * 50 + "!?'" * 30 + "s", "a" + " \n\t " * 20 + "b" + " " * 60, " " * 50 + "b" * 50 + "\n" * 50]
    for text in texts:
        for k in range(20):
            cuts = sorted(rng.sample(range(len(text)), 12 if k % 2 else 40))
            chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
            assert joined(enc.pieces(chunks)) == enc.findall(text)
            assert [i for ids in enc.stream(chunks) for i in ids] == enc.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1 \n\t'slre!-é", max_size=120), st.integers(1, 30))
def test_any_chunks_give_the_same(enc, text, size):
    was, bpe.CHUNK = bpe.CHUNK, 16
    try:
        assert joined(enc.pieces(text[i : i + size] for i in range(0, len(text), size))) == enc.findall(text)
    finally:
        bpe.CHUNK = was


def test_pairs_that_fit(enc):
    """Undoing merges at the border says the same as merging all."""
    b, rng = enc.bpe, random.Random(3)
    tokens = [t for t in b.ranks if b.is_token(t)]
    assert all(len(b.merge(t)) == 1 for t in rng.sample(tokens, 2000))
    pairs = [tuple(rng.sample(tokens, 2)) for _ in range(6000)] + [(t[:k], t[k:]) for t in rng.sample(tokens, 3000) for k in range(1, len(t))]
    pairs = [(x, y) for x, y in pairs if b.is_token(x) and b.is_token(y)]
    assert [p for p in pairs if b._fits(*p) != (b.merge(p[0] + p[1]) == list(p))] == []


def test_a_long_piece_in_linear_time_and_bounded_memory(enc):
    """One piece of 400,000 and one of 800,000 letters, made as it is read."""
    held, took = 0, []

    def chunks(n):
        for i in range(n):
            yield "".join("abcdefghij"[(i * 7 + k * k) % 10] for k in range(1000)) * 50

    for n in (8, 16):
        began, count = time.process_time(), 0
        t = bpe.Transducer(enc.bpe)
        for found, part, ends in enc.pieces(chunks(n)):
            assert not found and len(part) <= 2 * CHUNK
            for ids in t.feed(part.encode()):
                count += len(ids)
                held = max(held, len(t.buf))
        count += len(t.end())
        took.append(time.process_time() - began)
        assert count > 50_000 * n / 10
    assert held < enc.bpe.lookahead + 6 * t.every
    assert took[1] < 3 * took[0]


def test_stream_is_the_encoding_in_bounded_memory(enc, other):
    rng = random.Random(4)
    for text in ("z" * 2000, "".join(rng.choice("abcdefgh") for _ in range(3000)), "".join(rng.choice(["the", "ing", "token", "é", "中"]) for _ in range(700))):
        data = text.encode()
        sizes = [rng.randrange(1, 90) for _ in range(3000)]
        chunks, at = [], 0
        for n in sizes:
            chunks.append(data[at : at + n])
            at += n
        parts = list(enc.bpe.stream(chunks))
        assert [i for p in parts for i in p] == other(text)
        assert len(parts) > 3  # it came out by and by
    assert 128 <= enc.bpe.lookahead < 4096


def test_text_longer_than_a_chunk(enc, other):
    text = "word " * (CHUNK // 4) + "ab" * CHUNK
    assert enc.encode(text) == other(text)


def test_over_tables(spark, enc):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "é", None)], "doc_id long, text string, ids string")
    got = rows(token_ids.encode(df))
    assert got == sorted([(1, enc.encode("a b"))] * 2 + [(2, []), (3, []), (None, enc.encode("é"))], key=repr)
    assert rows(token_ids.decode(token_ids.encode(df)))[0] == (1, "a b")
    assert rows(token_ids.encode(df.limit(0))) == []
    assert rows(token_ids.verify(df, "ids").where("not same")) == [] and token_ids.verify(df, "ids").count() == 5
