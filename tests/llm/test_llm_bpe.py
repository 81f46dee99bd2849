import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from tramline.llm import bpe

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(NAME), "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "a", "It's we'll  done\n\n x\t y ", "naïve Übermut 123abc--!!", "<|endoftext|>", "日本語 テキスト 🙂", "x" * 5000, " \n" * 300, "word " * 30_000, "ab\x1c \x85 c " * 20_000, "no" * 60_000]


def test_pieces_give_the_ids_of_the_uncut_text(plain):
    enc = bpe.encoding(NAME, public_tokenizers.PATTERN)
    for text in TEXTS:
        whole = plain.encode_ordinary(text or "")
        for most in (10, 1000, bpe.LONG):
            assert bpe.encode_text(enc, text, most).tolist() == whole
        assert "".join(bpe.safe_pieces(text or "", 10)) == (text or "")


def test_queries_shape_and_round_trip(spark, plain):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "tie", "x"), (1, "", "x"), (1, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a clashing extra column
    ids = bpe.encode(df, ["doc_id"], NAME, public_tokenizers.PATTERN)
    got = bpe.decode(ids, ["doc_id", "n_tokens", "token_ids"], NAME, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted(((i is None, i or 0, len(plain.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, hashlib.sha256(r.decoded).hexdigest()) for r in got) == want
    assert bpe.encode(df.limit(0), ["doc_id"], NAME, public_tokenizers.PATTERN).count() == 0


def test_decoding_gives_raw_bytes(spark, plain):
    half = plain.encode_ordinary("🙂")[:1]
    packed = b"".join(i.to_bytes(4, "little") for i in half)
    df = spark.createDataFrame([(packed,), (None,)], "token_ids binary")
    out = [r.decoded for r in bpe.decode(df, [], NAME, public_tokenizers.PATTERN).collect()]
    assert out == [plain.decode_bytes(half), b""]


def test_long_white_space_is_encoded_as_the_pattern_would(plain):
    enc = bpe.encoding(NAME, public_tokenizers.PATTERN)
    mixed = " \n\t\r\x0b\x85\xa0\u2003\u3000"
    for n in [*range(1, 64), *range(64, 2001, 37), 2000]:
        for run in (" " * n, "\n" * n, "\u3000" * n, (mixed * n)[:n]):
            for text in (run, run + "word", "word" + run, f"a{run}b{run}", f".{run}1 {run}\u00e9", f"{run}'s{run}\x1c{run}"):
                assert bpe.encode_text(enc, text, run=8).tolist() == plain.encode_ordinary(text), (n, text[:5])


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, "\u3000" * 1_000_000, " \n\t" * 400_000, " " * 20_000_000])
def test_very_long_white_space_survives(plain, run):
    enc = bpe.encoding(NAME, public_tokenizers.PATTERN)
    for text in (run, "a" + run, run + "a", "a" + run + "b" + run + "c") if len(run) < 2_000_000 else ("a" + run + "b",):
        ids = bpe.encode_text(enc, text)
        assert plain.decode_bytes(ids.tolist()) == text.encode()
        # What is put before or behind a run changes no id far from it.
        short = text.replace(run, run[:60_000])
        assert ids[:1000].tolist() == plain.encode_ordinary(short)[:1000]


def test_long_white_space_through_spark(spark, plain):
    texts = [" " * 3_000_000, "x" + "\n" * 2_000_000 + "y", "word " * 400_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode(df, ["doc_id"], NAME, public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, ["doc_id", "token_ids"], NAME, public_tokenizers.PATTERN).collect()}
    assert got == {i: t.encode() for i, t in enumerate(texts)}
    other = bpe.encoding(NAME, r"\p{L}+|\s*[\r\n]+|\s+(?!\S)|\s+")
    with pytest.raises(ValueError):
        bpe.encode_text(other, "\n" * 10_000)
