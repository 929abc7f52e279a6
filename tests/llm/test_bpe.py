import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrank.llm import bpe

ENC = bpe.encoder(bpe.read_ranks(bpe.RANK_FILE), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n\t.'séé中 \r", max_size=60), st.integers(1, 12))
def test_pieces_keep_the_ids_of_the_whole(text, size):
    parts = list(bpe.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_round_trip_equals_the_library(spark):
    texts = [None, "", "Hello wörld", "x" * 5000, "word " * 100_000, "<|endoftext|>", "🦊 a\u0000b", "same", "same"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in bpe.round_trip(df).collect()}
    assert set(got[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC._mergeable_ranks, special_tokens={})
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_white_space(spark, monkeypatch):
    """Runs that the matcher cannot take; short limits against the library, long runs by their bytes."""
    for text in ("a  \n\n  b", "  \t\t\x0b  x", "x \u00a0\u3000\u2003 y", "\n\n\n\n", "a \x1c\x1d  \x85\x85 b", "    ", "é\u2028\u2029  \n"):
        monkeypatch.setattr(bpe, "LONG_SPACE", 2)
        monkeypatch.setattr(bpe, "_SPACES", re.compile(r"[^\S\x1c-\x1f]{2,}"))
        assert bpe.encode_text(ENC, text) == ENC.encode_ordinary(text), text
    monkeypatch.undo()
    big = [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 2_000_000 + "b" + "\n" * 1_500_000, "\t " * 1_000_000 + "."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(big)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(df).collect()}
    for i, t in enumerate(big):
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        middle = " ".join(map(str, bpe.encode_text(ENC, t)))
        assert got[i]["ids_sha256"] == hashlib.sha256(middle.encode()).hexdigest()
    for size in (9_999, 10_000, 10_001, 200_000):  # around the limit, where the library still answers
        for text in (" " * size, "x" + "\n" * size + "y", "1" + " \n" * size, " " * size + "1" + "\t" * size):
            assert bpe.encode_text(ENC, text) == ENC.encode_ordinary(text)


def test_encode_and_decode_lists(spark):
    df = spark.createDataFrame([(1, "naïve café"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(df)
    out = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(ids).collect()}
    assert out == {1: "naïve café".encode(), 2: b""}


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_rank_file_is_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_RANK_BYTES", 3)
    f = tmp_path / "ranks"
    f.write_bytes(b"abcd")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(f))
