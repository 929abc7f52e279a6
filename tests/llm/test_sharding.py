import bisect
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenrank.llm import sharding as S

from tests.conftest import SF01


def check(rows, shards, tolerance):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for s, members in by.items():
        assert 0 <= s < shards
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    total = sum(r["size"] for r in rows)
    largest = max((r["size"] for r in rows), default=0)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= tolerance * total / shards + 2 * largest


def test_range_of(spark):
    cuts = [-5, 0, 3, 10, 11, 40]
    df = spark.range(-10, 50).select("id", S.range_of(F.col("id"), cuts).alias("r"))
    assert all(r["r"] == bisect.bisect_left(cuts, r["id"]) for r in df.collect())


def test_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = S.shard(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["law"] == "bytes" and r["grown_shard"] is None
    check(rows, 16, 0.03)


@pytest.mark.parametrize("max_rows", [50, S.MAX_ROWS])
def test_hot_group_is_cut_and_small_groups_are_not(spark, max_rows):
    texts = ["hot text " * 10] * 700 + [f"doc {i // 2} " * 12 for i in range(1400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = S.shard(docs, max_rows=max_rows).collect()
    check(rows, 16, 0.05)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert len(where[texts[0]]) > 3
    assert all(len(v) == 1 for t, v in where.items() if t != texts[0])


@pytest.mark.parametrize("max_rows", [40, S.MAX_ROWS])
def test_law_and_group_rule_by_bytes(spark, max_rows):
    """Every group up to the share stands in one shard, whether its rows are many or few, short or
    long; sizes, checksums, slots and shard sizes from the definition. 60 groups lie around
    the boundaries, half of them with more rows than a task may order."""
    texts = [""] * 1500 + [None] * 20 + ["big group " * 40] * 300
    texts += [f"short {k}" for k in range(60) for _ in range(45 if k % 2 else 7)] + [f"single {k} " * 30 for k in range(900)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, size int").repartition(5)
    rows = S.shard(docs, max_rows=max_rows).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    quota = sum(size.values()) / 16
    groups = defaultdict(list)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
        groups[texts[r["doc_id"]] or ""].append(r)
    for t, members in groups.items():
        if sum(r["size"] for r in members) <= S.GROUP_SHARE * quota:
            assert len({r["shard"] for r in members}) == 1, t
    small = [g for g in groups.values() if len(g) >= 45 and sum(r["size"] for r in g) <= S.GROUP_SHARE * quota]
    assert len(small) >= 30 and len({r["shard"] for r in groups["big group " * 40]}) > 2
    check(rows, 16, 2 * S.GROUP_SHARE)


def test_nulls_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, ""), (3, "b" * 100_000)], "doc_id long, text string")
    rows = S.shard(docs).collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 2, 100_001]
    assert {r["text_crc32"] for r in rows if r["size"] == 1} == {0}
    assert S.shard(docs.limit(0)).collect() == []
