import random
import re

import pytest

from lumenrank.llm import line_dedup as L


def brute(rows, min_words):
    """From the definition: wherever two places of the corpus begin with equal lines, take the
    longest common run; with ``min_words`` words, its later copy goes. Blank lines do not
    count, and go with the lines around them."""
    docs = sorted(((i is None, i or 0, t) for i, t in rows if t is not None))
    raw = [t.split("\n") for _, _, t in docs]
    at = [[i for i, x in enumerate(ls) if re.search(r"[^ \t\n\x0b\x0c\r]", x)] for ls in raw]
    lines = [[raw[k][i].strip(" \t\x0b\x0c\r") for i in idx] for k, idx in enumerate(at)]
    places = [(k, a) for k, ls in enumerate(lines) for a in range(len(ls))]
    gone = [set() for _ in docs]
    for p, (k, a) in enumerate(places):
        for k2, a2 in places[p + 1:]:
            n = 0
            while a + n < len(lines[k]) and a2 + n < len(lines[k2]) and lines[k][a + n] == lines[k2][a2 + n]:
                n += 1
            if sum(len(re.findall(r"[^ \t\x0b\x0c\r]+", x)) for x in lines[k2][a2:a2 + n]) >= min_words:
                gone[k2].update(range(a2, a2 + n))
    out = {}
    for k, ls in enumerate(raw):
        cut = {at[k][j] for j in gone[k]}
        for j in gone[k]:
            if j + 1 in gone[k]:
                cut.update(range(at[k][j], at[k][j + 1]))
        out[docs[k][:2]] = ("\n".join(x for i, x in enumerate(ls) if i not in cut), len(ls), len(cut))
    return out


def made(seed):
    r = random.Random(seed)
    pool = ["a b c", "d", "e f", "", "g h i j k", "l m", " d ", "n o p q", "\t", "a\tb\x0bc", "e    f ", " \x0c"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 14)))) for i in range(40)]
    return rows + [(100, "x y\n" * 40), (101, "z"), (102, "x y\n" * 5 + "tail")]


@pytest.mark.parametrize("seed,min_words", [(1, 6), (3, 13)])
def test_against_brute_force(spark, seed, min_words):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, name string").repartition(4)
    got = {(r["row"]["doc_id"] is None, r["row"]["doc_id"] or 0): (r["text"], r["n_lines"], r["n_deleted"])
           for r in L.dedup_lines(docs, min_words=min_words).collect()}
    assert got == brute(rows, min_words)


def deleted(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["n_deleted"] for r in sorted(L.dedup_lines(docs).collect(), key=lambda r: r["row"]["doc_id"])]


def test_words_are_what_counts(spark):
    tabs = "\t".join(f"w{i}" for i in range(60))
    assert deleted(spark, tabs, "own\n" + tabs) == [0, 1]
    padded = "two" + " " * 58 + "words"
    assert deleted(spark, padded, padded) == [0, 0]
    assert deleted(spark, "\n" * 55, "\n" * 55, " \n\t\n" * 60) == [0, 0, 0]
    few = "\n".join(f"{i} word" for i in range(24))  # 48 words, and as many blank lines
    assert deleted(spark, few.replace("\n", "\n\n"), few.replace("\n", "\n\n")) == [0, 0]
    enough = "\n".join(f"{i} word" for i in range(25))
    assert deleted(spark, enough, "x\n\n" + enough.replace("\n", "\n \n") + "\n\ny") == [0, 49]


def test_hot_names_take_the_same_way_out(spark, monkeypatch):
    rows = made(5) + [(200 + i, "a b c\nd\ne f\ng h i j k\nn o p q\nown %d" % i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_name = L._by_name
    for limit in (1, 20):
        monkeypatch.setattr(L, "_by_name", lambda rows, names, _, how, limit=limit: by_name(rows, names, limit, how))
        got = {(False, r["row"]["doc_id"]): (r["text"], r["n_lines"], r["n_deleted"]) for r in L.dedup_lines(docs, min_words=7).collect()}
        assert got == brute(rows, 7)


def test_edge_cases(spark):
    passage = "\n".join(f"line {i} of a passage that many documents share" for i in range(12))
    rows = [(1, passage, 5), (2, "own words\n" + passage + "\nmore", 6), (3, passage, 7), (None, passage + "\nlast", 8),
            (4, None, 0), (5, "", 0), (6, "short line\nshort line", 3), (1, passage, 5), (7, "w " * 100_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = L.clean(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    want = [(1, passage, 5), (1, passage, 5), (2, "own words\nmore", 14), (None, "last", 4), (4, None, 0), (5, "", 0),
            (6, "short line\nshort line", 3), (7, "w " * 100_000, 9)]
    assert got == sorted(want, key=str)
    assert L.clean(docs.limit(0)).collect() == []
