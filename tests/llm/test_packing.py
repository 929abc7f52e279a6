import json
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenrank.llm import packing as P
from tests.conftest import SF001


def by_hand(lengths, capacity):
    """Best-fit decreasing, one piece at a time: how full the bins are. (Which of several
    equally tight bins takes a piece is open, and changes nothing of that.)"""
    bins, rest = [], []  # rest: sorted (remaining, bin)
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rest, (n, -1))
        if at == len(rest):
            bins.append([])
            insort(rest, (capacity, len(bins) - 1))
            at = bisect_left(rest, (n, -1))
        r, b = rest.pop(at)
        bins[b].append(n)
        insort(rest, (r - n, b))
    return Counter(map(sum, bins))


def unrolled(counts, capacity):
    """Every piece of a plan: (bin, offset, length)."""
    rows = sorted(P.best_fit(counts, capacity))
    for i, (length, number, first, each, used) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else counts[length]
        for nth in range(end - number):
            yield first + nth // each, used + nth % each * length, length


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    bins = defaultdict(list)
    for b, offset, length in unrolled(Counter(lengths), capacity):
        bins[b].append((offset, length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(sum(n for _, n in c) for c in bins.values()) == by_hand(lengths, capacity)


def test_plan_size_does_not_follow_the_counts():
    rng = np.random.default_rng(5)
    counts = {int(n): int(c) for n, c in zip(range(1, 2049), rng.integers(1, 1000, 2048))}
    small, large = len(P.best_fit(counts)), len(P.best_fit({n: c * 10_000_019 for n, c in counts.items()}))
    assert large < 2 * small + 2048


def test_cuts():
    assert P.cuts(1) == [(0, 1)] and P.cuts(2048) == [(0, 2048)]
    assert P.cuts(2049) == [(0, 1), (1, 2048)] and P.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)]


WHOLE = Tokenizer.from_file(P.TOKENIZER_FILE)
AWKWARD = ["a\t\n\nb", "a \t b c\x1cd", "x \n\n y  ", "  lead", "it's we'll I'd", "<|endoftext|>", "a <|endoftext|> b",
           "é　ü 12 345!?", "tail \n", "\n\n", " ", "\x85a \x85", "a  b", "1 000,50 €", "don't\n'll"]


DATA = P.read_tokenizer(P.TOKENIZER_FILE)
IDS = P.TokenIds(DATA, P.byte_ranks(WHOLE, DATA))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'lI1 \n\t\x1cé.,<|", max_size=40))
def test_ids_are_the_tokenizers(text):
    assert IDS.fast
    for t in (text, *AWKWARD):
        assert IDS.of(t).tolist() == WHOLE.encode(t, add_special_tokens=False).ids, t


def test_every_code_point_is_split_alike():
    for lo in range(0, 0x30000, 256):
        chars = [chr(c) for c in range(lo, lo + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c} {c}  {c}b\n" for c in chars)
        assert IDS.of(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids, hex(lo)


def test_other_tokenizers_take_the_slow_way():
    conf = json.loads(DATA)
    conf["model"]["merges"] = conf["model"]["merges"][:-1]  # the last token is out of reach
    data = json.dumps(conf).encode()
    assert P.byte_ranks(Tokenizer.from_str(data.decode()), data) is None
    other = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    assert P.byte_ranks(Tokenizer.from_str(other.decode()), other) is None


def checked(rows, texts):
    """Every row against ids made here: pieces complete, checksums, places, number of sequences."""
    ids = {d: WHOLE.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts}
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert found.keys() == ids.keys()
    for d, x in ids.items():
        assert sorted(found[d]) == [(k, *c) for k, c in enumerate(P.cuts(len(x)))]
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in places.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))]
        assert sum(n for _, n in content) <= 2048
    assert Counter(sum(n for _, n in c) for c in places.values()) == by_hand([r["length"] for r in rows], 2048)


def test_whole_table(spark):
    from lumenrank.llm.queries import QUERIES

    texts = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    checked(QUERIES["op13_best_fit_packing"](spark, SF001).collect(), texts)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_edge_cases(spark, batch):
    texts = [None, "", "a", "word " * 3000, " " * 2_000_000, "x " + "\n" * 1_000_000 + "y", "x" * 100_000, *AWKWARD, *["same copy"] * 30, "word " * 3000]
    rows = [(i, t, -1) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
        checked(P.pack(df).collect(), [(i, t) for i, t, _ in rows])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "t"), (1, "t"), (None, "u")], "doc_id long, text string")
    got = P.pack(df).collect()
    assert [r["doc_id"] for r in got].count(1) == 2 and len(got) == 3 and {r["sequence_id"] for r in got} == {0}
    assert P.pack(df.limit(0)).collect() == []
