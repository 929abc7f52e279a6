import numpy as np
from pyspark.sql import functions as F

from lumenrank.operators import dense

from .conftest import rows


def brute(q, d, k):
    out = []
    for qi, qv in q.items():
        sc = sorted(((round(float(np.dot(qv, dv)), 6), di) for di, dv in d.items()), key=lambda x: (-x[0], x[1]))
        out += [(qi, r + 1, di, s) for r, (s, di) in enumerate(sc[:k])]
    return sorted(out)


def vec_df(spark, m, key):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in m.items()], f"{key} long, embedding array<double>")


def test_knn_matches_brute_force_and_blocks(spark):
    rng = np.random.default_rng(7)
    d = {i: rng.normal(size=8) for i in range(300)}
    d[300] = np.zeros(8)  # zero vector
    d[301] = d[5].copy()  # equal scores at the cut
    q = {100 + i: rng.normal(size=8) for i in range(9)}
    want = brute(q, d, 20)
    for block in (1 << 26, 200):  # one broadcast block, then several query blocks
        got = dense.knn_search(vec_df(spark, q, "qid"), vec_df(spark, d, "doc_id"), k=20, block_bytes=block)
        assert sorted(rows(got, "qid", "rank", "doc_id", "score")) == want


def test_knn_k_larger_than_corpus(spark):
    d = {1: np.array([1.0, 0]), 2: np.array([0, 1.0])}
    q = {7: np.array([1.0, 1.0])}
    got = dense.knn_search(vec_df(spark, q, "qid"), vec_df(spark, d, "doc_id"), k=10)
    assert sorted(rows(got, "rank", "doc_id")) == [(1, 1), (2, 2)]


def test_l2_normalize_and_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(dense.l2_normalize("v")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_mean_pool_row_and_groups(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "m array<array<float>>")
    assert df.select(dense.mean_pool("m")).first()[0] == [2.0, 4.0]
    g = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 6.0]), (1, [5.0, 5.0])], "k int, embedding array<float>")
    got = sorted(rows(dense.group_mean_vectors(g, "k"), "k", "i", "value"))
    assert got == [(0, 0, 2.0), (0, 1, 4.0), (1, 0, 5.0), (1, 1, 5.0)]


def test_hash_encoder_unit_length_and_repeatable(spark):
    df = spark.createDataFrame([(1, "the cat the"), (2, ""), (3, "The Cat the")], "id long, text string")
    out = {r["id"]: r["embedding"] for r in dense.hash_encode(df, dim=16).collect()}
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-12
    assert out[2] == [0.0] * 16
    assert out[1] == out[3]


def test_batch_encoder_callable(spark):
    enc = dense.batch_encoder(lambda texts: [[len(t), 1.0] for t in texts], 2)
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    assert [r[0] for r in df.select(enc("t")).collect()] == [[2.0, 1.0], [4.0, 1.0]]


def test_knn_running_topk_across_many_batches(spark):
    rng = np.random.default_rng(11)
    d = {i: np.round(rng.normal(size=4), 1) for i in range(400)}  # rounded: many exact ties
    q = {i: np.round(rng.normal(size=4), 1) for i in range(5)}
    want = brute(q, d, 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = dense.knn_search(vec_df(spark, q, "qid"), vec_df(spark, d, "doc_id"), k=30)
        assert sorted(rows(got, "qid", "rank", "doc_id", "score")) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_model_encoder_pools_normalises_and_skips_nulls(spark):
    enc = dense.model_encoder(lambda texts: [[[len(t), 0.0], [len(t), 2.0]] for t in texts], 2, instruction="ab ")
    df = spark.createDataFrame([(1, "c"), (2, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in enc(df).collect()}
    assert list(got) == [1]
    assert np.allclose(got[1], np.array([4.0, 1.0]) / np.sqrt(17))


def test_model_results_batches_and_examples(spark):
    """Dict results, batches of a given size, task examples before the instruction."""
    import pytest

    def model(texts):
        assert len(texts) <= 2
        return {"dense_vecs": [[float(len(t)), 1.0] for t in texts]}

    df = spark.createDataFrame([(i, "x" * i) for i in range(7)], "id long, text string").coalesce(1)
    enc = dense.model_encoder(model, 2, instruction="ab ", examples="cd", examples_format="<{}>{}", normalize=False, batch_size=2)
    assert {r["id"]: r["embedding"] for r in enc(df).collect()} == {i: [i + 7.0, 1.0] for i in range(7)}
    other = dense.model_encoder(lambda ts: {"embeddings": np.ones((len(ts), 3, 2))}, 2, normalize=False)
    assert other(df).first()["embedding"] == [1.0, 1.0]
    with pytest.raises(Exception, match="without vectors"):
        dense.model_encoder(lambda ts: {"ids": [1]}, 2)(df).collect()


def test_tiles_are_one_plan_without_the_driver(spark, monkeypatch):
    """Many groups on either side, single-precision vectors, no collect of any vector."""
    rng = np.random.default_rng(3)
    d = {i: rng.normal(size=6).astype(np.float32) for i in range(400)}
    q = {i: rng.normal(size=6).astype(np.float32) for i in range(90)}
    monkeypatch.setattr(dense, "BLOCK_BYTES", 500)

    def f32(m, key):
        return vec_df(spark, m, key).withColumn("embedding", F.col("embedding").cast("array<float>")).repartition(5)

    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toArrow", lambda self: 1 / 0)
    want = brute({i: v.astype(float) for i, v in q.items()}, {i: v.astype(float) for i, v in d.items()}, 7)
    for block, groups in ((1 << 20, None), (800, 11), (200, 1)):
        got = dense.knn_search(f32(q, "qid"), f32(d, "doc_id"), k=7, block_bytes=block, corpus_groups=groups)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan
        assert sorted(rows(got, "qid", "rank", "doc_id", "score")) == want


def test_corpus_is_encoded_once(spark):
    """Whatever the number of query groups, each corpus text meets the model once."""
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(i, "x" * i) for i in range(60)], "doc_id long, text string")
    q = vec_df(spark, {i: np.array([1.0, float(i)]) for i in range(40)}, "qid")
    got = dense.knn_search(q, dense.model_encoder(model, 2)(docs), k=3, block_bytes=100)
    assert got.count() == 120 and calls.value == 60


def test_wrong_vectors_fail_and_null_vectors_are_skipped(spark):
    import pytest

    q = vec_df(spark, {1: [1.0, 0.0]}, "qid")
    nulls = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "doc_id long, embedding array<double>")
    assert rows(dense.knn_search(q, nulls, k=5), "doc_id") == [(1,)]
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "doc_id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors of length"):
        dense.knn_search(q, odd, k=5).collect()


def test_a_tile_is_bounded_whatever_the_sides_and_the_planner_says(spark, monkeypatch):
    """Groups follow the counted rows: a planner's estimate of encoded vectors is far too low."""
    for n_q, n_d in ((40, 3_000_000), (13_000, 47_000), (360_000, 3_000_000), (615_000, 615_000), (1, 1)):
        q, d = dense.tile_groups(n_q, n_d, 256, 200, 24, 32 << 20)
        assert -(-n_q // q) * (8 * 256 + 24 * 200) <= 34 << 20 and -(-n_d // d) * 8 * 256 <= 65 << 20
        assert q * d >= min(24, n_q) and q <= n_q
    seen = []
    real = dense.tile_groups
    monkeypatch.setattr(dense, "tile_groups", lambda *a: seen.append(a) or real(*a))
    docs = spark.createDataFrame([(i, f"a{i} b") for i in range(70)], "doc_id long, text string")
    dense.knn_search(vec_df(spark, {1: np.ones(16)}, "qid"), dense.hash_encode(docs, dim=16), k=3).count()
    assert seen[0][:2] == (1, 70)


def test_top_k_holds_a_few_lists_and_is_exact_in_any_order():
    """Rising, falling, tied and NaN scores, blocks smaller and larger than k."""
    rng = np.random.default_rng(5)
    for order in ("rise", "fall", "tie", "any"):
        n, q, k = 4000, 3, 25
        scores = {"rise": np.sort(rng.normal(size=(q, n))), "fall": -np.sort(rng.normal(size=(q, n))),
                  "tie": np.round(rng.normal(size=(q, n)), 1), "any": rng.normal(size=(q, n)) * 1e-5}[order]
        scores[:, 7] = np.nan
        ids = rng.permutation(n)
        top, i = dense._RunningTopK(q, k), 0
        for m in (10, 400, 25, 1000, 2565):
            top.add(ids[i:i + m], scores[:, i:i + m])
            assert sum(len(x[0]) for x in top.kept) <= dense.MERGE_FACTOR * q * k
            i += m
        at, r, d = top.result()
        for j in range(q):
            want = sorted(((-round(s, 6) if s == s else np.inf, x) for s, x in zip(scores[j].tolist(), ids.tolist())))[:k]
            assert sorted(zip((-r[at == j]).tolist(), d[at == j].tolist())) == want


def test_encoder_works_on_a_few_rows_of_a_batch_at_a_time(monkeypatch):
    import pyarrow as pa

    from lumenrank.functions import hashing as H

    codes = [[2 * (i % 5), 3] * (i % 4) if i % 7 else None for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(100)), "c": pa.array(codes, pa.list_(pa.int32()))})
    whole = [b for b in H.arrow_encoder(8, "c", "v")([batch])]
    monkeypatch.setattr(H, "STEP_ROWS", 9)
    monkeypatch.setattr(H, "STEP_TOKENS", 11)
    parts = list(H.arrow_encoder(8, "c", "v")([batch]))
    assert max(b.num_rows for b in parts) <= 9 and len(parts) > 12
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches(whole).to_pydict()
    assert list(H.steps(np.array([50, 0, 3, 8, 1]))) == [(0, 1), (1, 4), (4, 5)]


def test_a_stored_run_is_exact_and_never_shuffles_the_corpus(spark, monkeypatch):
    """Any number of query groups and corpus parts, ties, ids that come twice, either precision."""
    rng = np.random.default_rng(8)
    d = {i: np.round(rng.normal(size=5), 1) for i in range(300)}
    q = {i: np.round(rng.normal(size=5), 1) for i in range(60)}
    want, plans, real = brute(q, d, 9), [], dense.stored
    monkeypatch.setattr(dense, "BLOCK_BYTES", 900)
    monkeypatch.setattr(dense, "stored", lambda df, name, **o: plans.append(
        (name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name, **o))
    for block, parts in ((1 << 20, None), (4000, 1), (4000, 3), (200, 1)):
        got = dense.knn_run(vec_df(spark, q, "qid"), vec_df(spark, d, "doc_id").repartition(5), k=9, block_bytes=block, corpus_parts=parts)
        assert sorted(rows(got, "qid", "rank", "doc_id", "score")) == want
        plan = dict(plans)["run"]
        assert "CartesianProduct" in plan and "CoGroup" not in plan
        assert ("Exchange" in plan) == (parts != 1 and "Window" in plan)
    twice = vec_df(spark, q, "qid").unionByName(vec_df(spark, {1: q[5]}, "qid"))
    old = dense.knn_search(twice, vec_df(spark, d, "doc_id"), k=9)
    assert sorted(rows(dense.knn_run(twice, vec_df(spark, d, "doc_id"), k=9))) == sorted(rows(old))
    assert dense.knn_run(vec_df(spark, q, "qid").limit(0), vec_df(spark, d, "doc_id"), k=9).count() == 0


def test_groups_of_a_stored_run_are_bounded_and_the_corpus_whole_for_many_queries():
    for n_q, n_d in ((40, 3_000_000), (13_000, 47_000), (360_000, 3_000_000), (615_000, 615_000), (1, 1)):
        q, parts = dense.stream_groups(n_q, n_d, 256, 200, 24, 32 << 20)
        assert -(-n_q // q) * (8 * 256 + 4 * 24 * min(200, n_d)) <= 34 << 20 and 1 <= q <= n_q
        assert parts == 1 or n_q < 24 * dense.GROUP_QUERIES


def test_single_precision_only_tells_what_is_computed_in_full():
    rng = np.random.default_rng(4)
    left, right = rng.normal(size=(30, 64)), rng.normal(size=(5000, 64)) * rng.choice([1e-6, 1, 50], size=(5000, 1))
    right[::7] = right[3] + rng.normal(size=64) * 1e-9  # scores that single precision can't tell apart
    fast, plain = dense._RunningTopK(30, 20), dense._RunningTopK(30, 20)
    for i in range(0, 5000, 500):
        part, ids = right[i:i + 500], np.arange(i, i + 500)
        fast.add_products(ids, left, part, left.astype(np.float32), part.astype(np.float32))
        plain.add(ids, left @ part.T)
    assert all((a == b).all() for a, b in zip(fast.result(), plain.result()))
