import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenrank.llm import graph
from lumenrank.llm import near_dup as N

from tests.conftest import SF01


def gram_set(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset(), tuple(ws)


def brute(rows):
    """Links between different word sequences, and classes as components."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[gram_set(t)[1] or ("", i)].append(i)
    keys = [k for k in texts if k[0] != ""]
    sets = {k: gram_set(b" ".join(k).decode())[0] for k in keys}
    by_gram = defaultdict(list)
    for k in keys:
        for g in sets[k]:
            by_gram[g].append(k)
    links, root = Counter(), {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in keys:
        shared = Counter(o for g in sets[k] for o in by_gram[g] if o > k)
        for o, n in shared.items():
            if 5 * n >= 4 * len(sets[k] | sets[o]):
                links[k] += 1
                links[o] += 1
                root[find(k)] = find(o)
    members = defaultdict(list)
    for k, ids in texts.items():
        members[find(k)] += ids
    return {i: (min(members[find(k)]), links[k], len(members[find(k)])) for k, ids in texts.items() for i in ids}


def variants(r, base, n):
    for _ in range(n):
        ws = list(base)
        for _ in range(r.randrange(1, 4)):
            ws[r.randrange(len(ws))] = f"v{r.randrange(1000)}"
        yield " ".join(ws)


def made():
    r = random.Random(5)
    line = [f"c{i}" for i in range(30)]
    out = [None, "", " \n", "one two", "ONE  two", "solo", "x " * 30_000]
    for g, n in enumerate((300, 40, 12, 5)):
        base = [f"g{g}w{i}" for i in range(200)]
        out += [" ".join(base)] * 3 + list(variants(r, base, n))
    out += [" ".join(line + [f"d{i}_{j}" for j in range(60)]) for i in range(60)]
    return list(enumerate(out))


@pytest.mark.parametrize("batch", [50, 10_000])
def test_against_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(N, "BLOCK_TEXTS", 64)
    rows = made()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, node string").repartition(3)
        out = N.near_classes(docs).collect()
        got = {r["id"]: (r["class_id"], r["n_links"], r["class_rows"]) for r in out}
        assert got == brute(rows)
        assert {r["id"] for r in out if r["kept"]} == {c for c, _, _ in got.values()}
        kept = N.clean(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in got.values()})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["class_rows"]) for r in N.op8(spark, SF01).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t + " end"), (None, None), (None, ""), (8, ""), (8, "")],
                                 "doc_id long, text string")
    out = N.near_classes(docs).collect()
    assert [(r["class_id"], r["class_rows"]) for r in out if r["class_rows"] > 1] == [(5, 4)] * 4
    assert sorted(map(str, (tuple(r) for r in N.clean(docs).collect()))) == sorted(
        map(str, [(5, t), (None, None), (None, ""), (8, ""), (8, "")]))
    assert N.near_classes(docs.limit(0)).collect() == [] and N.clean(docs.limit(0)).collect() == []


def test_pruning_follows_the_posterior():
    least = N.least_matches()
    assert least == sorted(least) and least[-1] / N.COMPARED < 0.7
    same = np.ones((1, N.COMPARED), np.uint16)
    i, _ = N.survivors(same, same, np.array([0]), np.array([0]), least)
    assert len(i) == 1
    i, _ = N.survivors(same, same * 2, np.array([0]), np.array([0]), least)
    assert len(i) == 0


def test_common_grams_both_ways():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert N.common_grams(sets, i, j).tolist() == want
    assert N.common_grams(sets * 8, i, j).tolist() == want
    many_i, many_j = np.triu_indices(96, 1)
    got = N.common_grams(sets * 8, many_i, many_j)
    assert got[:5].tolist() == [len(np.intersect1d((sets * 8)[a], (sets * 8)[b])) for a, b in zip(many_i[:5], many_j[:5])]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)] + [(300, i) for i in range(301, 350)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x["node"]: x["component"] for x in graph.components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
