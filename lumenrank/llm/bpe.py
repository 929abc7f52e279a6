"""Byte-level BPE encoding and decoding with a local rank file (operator 2).

The driver reads the rank file once and broadcasts its bytes (checked against
``MAX_RANK_BYTES``), so executors need no copy of it. Each Python worker builds one
``tiktoken.Encoding`` and encodes Arrow batches. A text over ``PIECE_CHARS``
characters is first cut at safe boundaries, so no call holds the tokens of an
unbounded text; the ids are the same as for the whole text. A run of ``LONG_SPACE``
white-space characters, which the pattern matcher could not take, is cut out by the
pattern's own rule and encoded as the one piece that it is.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to
empty bytes; repeated rows are encoded each; texts of any length, and any run of one
character in them, are encoded whole; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A rank file is a vocabulary, not data; larger files than this are refused.
MAX_RANK_BYTES = 64 * 1024 * 1024
#: Texts above this length are cut at safe boundaries before encoding.
PIECE_CHARS = 1 << 18

# Between an ASCII letter or digit and white space the splitting pattern always
# ends a match: runs of letters and of digits hold no white space, and a run of
# white space starts afresh there. Cutting there changes neither side.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \t\n])")

#: White-space characters in a row that are not left to the pattern matcher.
LONG_SPACE = 10_000
# White space as the pattern has it: Python's, without the four separators of ASCII.
_SPACES = re.compile(rf"[^\S\x1c-\x1f]{{{LONG_SPACE},}}")

_ENCODERS: dict[str, tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes: {path}")
    return data


def encoder(data: bytes, pattern: str) -> tiktoken.Encoding:
    """The worker's encoding for these ranks, built once per process."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding(
            key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary at or after each ``size`` characters."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) < LONG_SPACE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _SPACES.finditer(text):
        # A match of the pattern ends where white space begins. The run is one match; of one that
        # text follows, the last character is left to what follows.
        end = run.end() - (run.end() < len(text))
        for piece in pieces(text[start:run.start()]):
            ids.extend(enc.encode_ordinary(piece))
        ids.extend(enc._encode_single_piece(text[run.start():end]))
        start = end
    for piece in pieces(text[start:]):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(id_col, ids array<int>)``: the token ids of every whole text."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for b in batches:
            ids = [encode_text(enc, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kept = df.select(id_col, text_col)
    return kept.mapInArrow(run, f"{_typed(kept, id_col)}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str = RANK_FILE,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(id_col, decoded binary)``: the raw bytes of each id list (null ids: empty).
    Bytes, not text: a list may end inside a character."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for b in batches:
            raw = [enc.decode_bytes(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=[id_col, "decoded"])

    kept = df.select(id_col, ids_col)
    return kept.mapInArrow(run, f"{_typed(kept, id_col)}, decoded binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode in one pass and return digests instead of the lists:
    ``(id_col, n_tokens, ids_sha256, decoded_sha256)``. The ids never leave the
    worker, so the pass ships texts in and three short columns out."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            for t in b.column(1):
                ids = encode_text(enc, t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = df.select(id_col, text_col)
    return kept.mapInArrow(run, f"{_typed(kept, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _typed(df: DataFrame, col: str) -> str:
    return f"`{col}` {df.schema[col].dataType.simpleString()}"


def op2(spark, sf_dir: str) -> DataFrame:
    """Query: the round trip of every whole text of ``documents``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
