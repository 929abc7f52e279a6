import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrank.llm import collocations as K
from lumenrank.llm import quotient as Q

U = np.uint64


# ------------------------------------------------------------------ filters
@settings(max_examples=200, deadline=None)
@given(st.integers(1, 42), st.data())
def test_pack_and_permute_can_be_undone(bits, data):
    ids = st.integers(0, (1 << bits) - 1)
    rows = data.draw(st.lists(st.tuples(ids, ids, ids), min_size=1, max_size=30))
    a, b, c = (np.array(x, U) for x in zip(*rows))
    half = Q.half_bits(bits)
    high, low = Q.pack(a, b, c, bits)
    assert (high >> U(half)).max() == 0 and (low >> U(half)).max() == 0
    again = Q.unpack(*Q.restore(*Q.permute(high, low, half), half), bits)
    assert [x.tolist() for x in again] == [a.tolist(), b.tolist(), c.tolist()]


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 63), st.integers(0, 6), st.data())
def test_filters_hold_what_went_in(half, shard_bits, data):
    shard_bits = min(shard_bits, half)
    part = st.integers(0, (1 << half) - 1)
    numbers = data.draw(st.lists(st.tuples(part, part), min_size=1, max_size=60))
    weights = data.draw(st.lists(st.sampled_from([1, 2, 254, 255, 256, 10**12]), min_size=len(numbers), max_size=len(numbers)))
    pieces = []
    for lo in range(0, len(numbers), 20):
        high, low = (np.array(x, U) for x in zip(*numbers[lo:lo + 20]))
        one = Q.Filter.of(half, high, low, np.array(weights[lo:lo + 20], np.int64))
        pieces += [(s, f.encode(shard_bits)) for s, f in one.shards(shard_bits)]
    got = Counter()
    for shard in {s for s, _ in pieces}:
        merged = Q.Filter.merged([Q.Filter.decode(x) for s, x in pieces if s == shard])
        for h, x, n in zip(merged.high.tolist(), merged.low.tolist(), merged.counts.tolist()):
            assert h >> (half - shard_bits) == shard and (h, x) not in got
            got[h, x] = n
    want = Counter()
    for number, n in zip(numbers, weights):
        want[number] += n
    assert got == want


def test_a_filter_is_compact():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 57, 100_000, dtype=np.uint64)
    one = Q.Filter.of(29, x >> U(29), x & U((1 << 29) - 1))
    assert len(one.encode(0)) < 6.6 * len(one.high)


# ------------------------------------------------------------------ the whole result
def brute(rows, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 10}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (l2, q), b in candidates.items() if len(p) == 2):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, x in out.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    rng = np.random.default_rng(11)
    rows = []
    for k in range(400):
        words = rng.choice(["of", "the", "New", "york", "city", "a\tb", "x y", "é", "\x01", "und", "q" + "w" * int(rng.integers(1, 3))], 30)
        text = "".join(w + str(rng.choice([" ", "  ", ", ", "! ", "\n", " \t", "\x0b", ""], p=[.6, .1, .1, .05, .05, .04, .03, .03])) for w in words)
        rows.append((str(rng.choice(["en", "de", "und", "", "a\nb"])) if k % 9 else None, text, k))
    return rows + [("en", None, 1), ("en", "", 2), ("fr", "one word", 3), ("en", "new york city. " * 3000, 4), ("en", "no end " * 3000, 5)] + [
        ("de", "hot copy of the same text", 6)] * 40


@pytest.mark.parametrize("tokens,long_text,fan", [(1_500_000, 1 << 23, 8), (300, 1000, 1), (700, 5000, 2)])
def test_against_brute_force(spark, monkeypatch, tokens, long_text, fan):
    """Also with many small chunks, cut texts and several rounds of merging."""
    monkeypatch.setattr(K, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(K, "LONG_TEXT", long_text)
    monkeypatch.setattr(K, "SLICE", 100 if fan == 2 else 1 << 22)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string, word int").repartition(3)
    want = brute([r[:2] for r in rows])
    assert len(want) > 60 and any(" " in w[2] and len(w[2].split(" ")) == 3 for w in want)
    assert result(K.collocations(df, fan_bits=fan)) == want


def test_a_small_top_and_ties(spark):
    rows = [("en", f"tie{k} pair{k}. " * 10) for k in range(30)]
    got = result(K.collocations(spark.createDataFrame(rows, "lang string, text string"), top=7))
    assert got == brute(rows, 7) and len(got) == 7


def test_empty_tables(spark):
    assert K.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert K.collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")).collect() == []


def test_words_that_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = corpus()[:60]
        df = spark.createDataFrame(rows, "lang string, text string, n int").repartition(20)
        assert result(K.collocations(df)) == brute([r[:2] for r in rows])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
