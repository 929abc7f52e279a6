import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrank.llm import decontaminate as D

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return _WORD.findall(lower)


def brute(text, items):
    ws = brute_words(text)
    hit, names = set(), set()
    for name, item in items:
        iw = brute_words(item)
        if not iw:
            continue
        m = min(13, len(iw))
        for j in range(len(iw) - m + 1):
            for i in range(len(ws) - m + 1):
                if ws[i:i + m] == iw[j:j + m]:
                    hit.update(range(i, i + m))
                    if name is not None:
                        names.add(str(name))
    return len(ws), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(ws)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_words(text):
    assert [w.decode() for w in D.words(text)] == brute_words(text)


LONG = " ".join(f"w{i % 7}" for i in range(40))
ITEMS = [(1, LONG), (2, "alpha beta"), (10, "Solo"), (3, None), (4, ""), (None, "nameless one"), (2, "alpha beta"),
         (5, " ".join("abcdefghijklm")), (6, "é ü")]
DOCS = [None, "", "no match here", "x " * 5 + LONG.upper() + " y" * 30, "Alpha, BETA! alpha beta", "solo",
        "a b c d e f g h i j k l m " * 3, "nameless one", "pad " * 50 + "é-ü", "filler " * 20_000 + "solo", "alpha  beta"]


@pytest.mark.parametrize("block_bytes", [D.ITEM_BLOCK_BYTES, 100])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "ITEM_BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(DOCS)], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in D.scan(docs, items).collect()}
    assert got == {i: brute(t, ITEMS) for i, t in enumerate(DOCS)}
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(DOCS) if not brute(t, ITEMS)[3]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in D.scan(docs, items).collect()] == [(2, 0)]
    assert D.scan(docs.limit(0), items).collect() == []
