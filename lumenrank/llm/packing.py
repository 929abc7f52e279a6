"""Best-fit decreasing packing of tokenised documents into sequences (operator 13).

1. One pass tokenises, as the ``tokenizers`` library does. A document is its token ids and then the separator; one longer than
   a sequence is cut into pieces as long as a sequence, of which the first may be shorter.
   Each task numbers its pieces per length. Only lengths and checksums are kept.
2. Counts per length and task, summed up over the tasks, number all pieces of a length
   from 0 on without a gap. Pieces of one length are alike to any packer.
3. Best-fit decreasing over the counts per length: from the longest on, each piece goes to
   the tightest open bin that holds it. A segment tree over remaining capacities finds that
   bin in logarithmic time. Bins of one history and pieces of one length go in runs, so the
   packer takes a run where one document at a time would take as many equal steps; the
   result is the same packing, and its size depends on the capacity alone, not on the data.
4. Each piece looks up its sequence and place by length and number.

Bounds: the driver gets one count per length, and the plan that is broadcast has at most
4 bins' intervals per length, each filled by pieces of at most sqrt(2 * capacity) different
lengths: half a million rows for 2048 tokens at the very worst, some thousands in practice.
No task holds more than one text and one batch of rows; a length that a third of all pieces
share is one count per task.

Edge cases: a null text counts as empty; an empty text is the separator alone; null ids and
repeated rows are packed each; of equal lengths, pieces are numbered by task and place in
it; a text of any length is tokenised whole; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenrank.llm.common import documents, written

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, SEPARATOR = 2048, 0
#: A tokenizer file is a vocabulary, not data; larger ones are refused.
MAX_TOKENIZER_BYTES = 64 * 1024 * 1024
#: White space in a row from which the fast way leaves a text to the tokenizer itself.
LONG_SPACE = re.compile(r"\s{10000}")


# ------------------------------------------------------------------ tokens
def byte_ranks(tokenizer: Tokenizer, data: bytes) -> dict[bytes, int] | None:
    """The merge ranks of a plain byte-level BPE, for which ``tiktoken`` gives the same ids;
    None for any other tokenizer.

    It merges two neighbours whenever their concatenation is a token, the tokenizer only
    listed pairs. Where every token's own bytes merge to that token, the state before its
    last merge is the listed pair, so that no other pair of the token is ever met."""
    conf = json.loads(data)
    model, split = conf["model"], conf.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or conf.get("normalizer") or conf.get("truncation") or conf.get("padding"):
        return None
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made, vocab = [model["vocab"]["".join(x)] for x in merges], tokenizer.get_vocab(with_added_tokens=False)
    if made != sorted(made) or any([x.id for x in tokenizer.model.tokenize(t)] != [i] for t, i in vocab.items()):
        return None
    # Bytes that print stand for themselves, the others for the code points from 256 on.
    print_as = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in print_as]
    byte = {chr(b): b for b in print_as} | {chr(256 + k): b for k, b in enumerate(other)}
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class TokenIds:
    """Ids as the ``tokenizers`` library gives them for a file, added tokens included but
    none put in. Where ``ranks`` allow it, most texts take the faster ``tiktoken`` way."""

    def __init__(self, data: bytes, ranks: dict[bytes, int] | None):
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = ranks and tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if self.fast and not any(a in text for a in self.added) and not LONG_SPACE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_LOADED: dict[str, TokenIds] = {}


def loaded(data: bytes, ranks: dict[bytes, int] | None) -> TokenIds:
    """The worker's tokenizer for this file, built once per process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = TokenIds(data, ranks)
    return _LOADED[key]


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file over {MAX_TOKENIZER_BYTES} bytes: {path}")
    return data


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = TOKENIZER_FILE,
           capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, part, nth)``: ``nth`` numbers the pieces of one
    length within the task ``part``."""
    data = read_tokenizer(tokenizer_file)
    shared = df.sparkSession.sparkContext.broadcast((data, byte_ranks(Tokenizer.from_str(data.decode()), data)))

    def run(batches):
        ids, part, seen = loaded(*shared.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            out: list[tuple] = []
            for i, t in enumerate(b.column(1)):
                stream = np.append(ids.of(t.as_py() or ""), np.uint32(separator)).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cuts(len(stream), capacity)):
                    out.append((i, k, start, length, zlib.crc32(stream[start:start + length]), seen[length]))
                    seen[length] += 1
            at, k, start, length, crc, nth = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()),
                 pa.array(nth, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, piece int, start long, length int, "
                           "ids_crc32 long, part int, nth long")


# ------------------------------------------------------------------ best fit
class Capacities:
    """Segment tree over remaining capacities 0 to ``most``: a node counts the open
    intervals of bins below it, a leaf holds those of one remaining capacity."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def _add(self, r: int, d: int) -> None:
        node = self.size + r
        while node:
            self.count[node] += d
            node >>= 1

    def put(self, r: int, first: int, bins: int) -> None:
        if bins and r:
            self.open[r].append((first, bins))
            self._add(r, 1)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """An interval of the smallest remaining capacity from ``least`` on, or None."""
        node = self.size + least
        if not self.count[node]:
            # Up to the first ancestor with open bins to the right, then down its left side.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.count[node]:
                    node += 1
        r = node - self.size
        self._add(r, -1)
        return (r, *self.open[r].pop())


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces: rows ``(length, number, bin, each,
    used)``. From piece ``number`` of the length on, ``each`` pieces go to each bin from
    ``bin`` on, which held ``used`` tokens, up to the next row of that length."""
    tree, bins, out = Capacities(capacity), 0, []
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            found = tree.take(length)
            if found is None:
                need = -(-left // (capacity // length))
                found, bins = (capacity, bins, need), bins + need
            r, first, open_bins = found
            # A bin that took a piece is the tightest for the next one while that fits.
            each = min(r // length, left)
            full = min(open_bins, left // each)
            out.append((length, number, first, each, capacity - r))
            number, left = number + full * each, left - full * each
            tree.put(r - each * length, first, full)
            tree.put(r, first + full, open_bins - full)
    return out


# ------------------------------------------------------------------ the job
def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = TOKENIZER_FILE,
         capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Per piece: ``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``."""
    spark = df.sparkSession
    cut = written(pieces(df, id_col, text_col, tokenizer_file, capacity, separator), "pieces")
    per_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = written(per_task.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "numbers")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = sorted(best_fit(counts, capacity))  # at most ``capacity`` counts in; see the module for the bound
    length, number, bin_, each, used = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5))
    first = np.searchsorted(length, np.arange(capacity + 2))
    plan = spark.sparkContext.broadcast((first, number, bin_, each, used))

    def place(batches):
        first, number, bin_, each, used = plan.value
        for b in batches:
            size, nth = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
            row = np.empty(len(size), np.int64)
            for x in np.unique(size):
                own = size == x
                lo, hi = first[x], first[x + 1]
                row[own] = lo + np.searchsorted(number[lo:hi], nth[own], "right") - 1
            nth = nth - number[row]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "piece", "start")), pa.array(size, pa.int64()), b.column("ids_crc32"),
                 pa.array(bin_[row] + nth // each[row], pa.int64()), pa.array(used[row] + nth % each[row] * size, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.join(before.select("length", "part", "before"), ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    out = numbered.mapInArrow(place, f"id {cut.schema['id'].dataType.simpleString()}, piece int, start long, length long, "
                              "ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op13(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` in sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir))
