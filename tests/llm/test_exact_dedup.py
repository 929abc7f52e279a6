import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrank.llm import exact_dedup as E


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**58 - 1), max_size=50, unique=True))
def test_rice_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    k = E.rice_parameter(2**58, len(v))
    assert (E.rice_decode(E.rice_encode(v, k), len(v), k) == v).all()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", [2, 10_000])
def test_against_brute_force(spark, batch):
    texts = ["a b", "ab", "a  b", None, "", " \n", "x", "é", "é ", "long " * 50_000, "a b"] + ["hot copy"] * 40
    rows = list(enumerate(texts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, owner string").repartition(3)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in E.exact_groups(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_owners_follow_the_rows(spark, monkeypatch):
    asked = []
    make = E._fingerprint_batches
    monkeypatch.setattr(E, "_fingerprint_batches", lambda id_col, owners: asked.append(owners) or make(id_col, owners))
    monkeypatch.setattr(E, "ROWS_PER_OWNER", 10)
    monkeypatch.setattr(E, "HEAVY", 1)  # and groups by both ways out
    rows = [(i, f"text {i % 900 if i % 3 else 0}") for i in range(2000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
           for r in E.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert asked == [200] and got == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "t"), (1, "t"), (None, "t"), (None, "u")], "doc_id long, text string")
    got = E.exact_groups(df).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"], r["group_size"]) for r in got if r["group_size"] == 3) == [
        (False, 1, 3), (False, 1, 3), (True, 1, 3)]
    assert sum(r["kept"] for r in got) == 2


def test_empty_table(spark):
    assert E.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
