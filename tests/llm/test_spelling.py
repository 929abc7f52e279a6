import re
import zlib
from collections import Counter

import pytest

from lumenrank.llm import spelling as S
from tests.conftest import SF001


def one_edit(a, b):
    """Whether one inserted, deleted or replaced letter makes ``b`` of ``a``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_count=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= min_count}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near, form = {}, {}
    for w, n in words.items():
        others = [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, []) if one_edit(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        near[w], form[w] = len(others), best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, near[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def result(df):
    got = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def test_whole_table(spark):
    from lumenrank.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert len(want) > 100 and any(v[0] for v in want.values()) and any(v[3] > 1 for v in want.values())
    assert result(QUERIES["op12_spelling_variants"](spark, SF001)) == want


EDITS = ["abcdef", "abcdeg", "abcdefg", "bcdefg", "xabcdef", "abcxdef", "abdcef", "abcdeff", "abccdef", "aabcdef", "abcdéf",
         "àbcdef", "bcdefx", "ABCDEF", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "abaaaa"]


@pytest.mark.parametrize("block,tile,held", [(1024, 192, 200_000), (2, 3, 4), (3, 1, 1)])
def test_edits_at_every_place(spark, monkeypatch, block, tile, held):
    """Also with tiny blocks, so that every bucket is cut and pairs stand across blocks."""
    for name, value in (("BLOCK_WORDS", block), ("TILE_ROWS", tile), ("HELD_WORDS", held)):
        monkeypatch.setattr(S, name, value)
    rows = []
    for k, w in enumerate(EDITS):
        rows += [(k, f"{w} " * (5 ** (k % 3 + 1)) + "short ab-cdefgh 12", "x")]
    rows += [(100, None, "x"), (101, "", "x"), (None, "abcdef abcdeg", "x"), (102, "quitelong" * 20_000, "x")] + [(103, "abcdef", "x")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    assert result(S.variants(df)) == brute([r[:2] for r in rows])


def test_chain_of_forms_and_long_words(spark):
    long = "q" * 40_000
    chain = ["words" + "abcdefgh"[:k] for k in range(1, 8)]
    rows = [(1000 + k, f"{w} " * 5 ** (k + 1)) for k, w in enumerate(chain[:5])]
    rows += [(2000, f"{long}x {long}y {long} " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(S.variants(df))
    assert got == brute(rows)
    assert got[chain[0]][1] == chain[4]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(empty).collect() == []
    assert S.variants(spark.createDataFrame([(1, "few words here")], "doc_id long, text string")).collect() == []
