from fractions import Fraction

from pyspark.sql import functions as F

from lumenrank.operators import rank

from .conftest import rows

RUN = "qid long, rank int, doc_id long, score double"


def run_df(spark, data):
    return spark.createDataFrame(data, RUN)


def test_rrf_orders_and_ties(spark):
    dense = run_df(spark, [(1, 1, 10, .9), (1, 2, 11, .8), (1, 3, 12, .7)])
    bm25 = run_df(spark, [(1, 1, 20, 5.), (1, 2, 12, 4.), (1, 3, 11, 3.)])
    got = rows(rank.rrf_fuse(dense, bm25).orderBy("rank"), "rank", "doc_id")
    # 11 (2,3) and 12 (3,2) tie on score: dense rank decides; 10 and 20 tie: dense first
    assert got == [(1, 11), (2, 12), (3, 10), (4, 20)]
    scores = dict(rows(rank.rrf_fuse(dense, bm25), "doc_id", "score"))
    assert abs(scores[11] - (1 / 62 + 1 / 63)) < 1e-15


def test_rrf_empty_and_missing_bm25(spark):
    dense = run_df(spark, [(1, 1, 10, .9), (1, 2, 11, .8)])
    empty = run_df(spark, [])
    assert rows(rank.rrf_fuse(dense, empty).orderBy("rank"), "doc_id") == [(10,), (11,)]
    assert rows(rank.rrf_fuse(dense, None).orderBy("rank"), "doc_id", "score") == [(10, .9), (11, .8)]


def test_pointwise_keeps_old_order_on_ties(spark):
    run = run_df(spark, [(1, 1, 0, .5), (1, 2, 1, .4), (1, 3, 2, .3)])
    q = spark.createDataFrame([(1, "zzz")], "qid long, query string")
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    out = rank.pointwise_rerank(run, q, docs).orderBy("rank")
    assert rows(out, "doc_id", "score") == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_pointwise_scores_replace(spark):
    run = run_df(spark, [(1, 1, 0, .5), (1, 2, 1, .4), (1, 3, 2, .3)])
    q = spark.createDataFrame([(1, "red apple")], "qid long, query string")
    docs = spark.createDataFrame([(0, "blue"), (1, "an apple"), (2, "Red APPLE pie")], "doc_id long, text string")
    out = rank.pointwise_rerank(run, q, docs).orderBy("rank")
    assert rows(out, "doc_id", "score") == [(2, 1.0), (1, .5), (0, 0.0)]
    assert rank.pointwise_rerank(run.where("qid = 9"), q, docs).count() == 0


def test_batch_pair_scorer_matches_builtin(spark):
    run = run_df(spark, [(1, 1, 0, .5), (1, 2, 1, .4), (1, 3, 2, .3)])
    q = spark.createDataFrame([(1, "red apple")], "qid long, query string")
    docs = spark.createDataFrame([(0, "blue"), (1, "an apple"), (2, "Red APPLE pie")], "doc_id long, text string")

    def model(queries, passages):
        out = []
        for a, b in zip(queries, passages):
            qa, pb = set(a.lower().split()), set(b.lower().split())
            out.append(len(qa & pb) / len(qa))
        return out

    got = rank.pointwise_rerank(run, q, docs, rank.batch_pair_scorer(model)).orderBy("rank")
    assert rows(got, "doc_id") == [(2,), (1,), (0,)]


def _listwise(spark, completion, n_docs=12):
    run = run_df(spark, [(1, r, 100 + r, 1.0 / r) for r in range(1, n_docs + 1)])
    comp = None if completion is None else spark.createDataFrame([(1, completion)], "qid long, completion string")
    return rows(rank.listwise_rerank(run, comp).orderBy("rank"), "doc_id", "score")


def test_listwise_reorders_top_and_keeps_scores(spark):
    got = _listwise(spark, "[3] [1], (2). 12 3")
    assert [d for d, _ in got][:4] == [103, 101, 102, 104]
    assert dict(got)[103] == 1.0 / 3  # scores stay with their docs
    assert len(got) == 12


def test_listwise_failure_paths_unchanged(spark):
    base = [100 + r for r in range(1, 13)]
    for comp in (None, "", "none at all", "0 11 12"):
        assert [d for d, _ in _listwise(spark, comp)] == base, comp


def test_listwise_fewer_docs_than_window(spark):
    got = _listwise(spark, "5 4 1", n_docs=4)
    assert [d for d, _ in got] == [104, 101, 102, 103]


def test_listwise_prompt_layout(spark):
    run = run_df(spark, [(1, 2, 11, .5), (1, 1, 10, .9)])
    q = spark.createDataFrame([(1, "who?")], "qid long, query string")
    docs = spark.createDataFrame([(10, "first"), (11, "second")], "doc_id long, text string")
    prompt = rank.listwise_prompts(run, q, docs).first()["prompt"]
    assert prompt == (
        "Query: who?\nHere are candidate documents:\n[1] first\n[2] second\n"
        "Return the indices of the most relevant documents in order, separated by spaces or commas."
    )


def test_attach_text_missing_id_keeps_row(spark):
    run = run_df(spark, [(1, 1, 10, .9), (1, 2, 99, .8)])
    docs = spark.createDataFrame([(10, "x")], "doc_id long, text string")
    got = sorted(rows(rank.attach_text(run, docs), "doc_id", "text"))
    assert got == [(10, "x"), (99, None)]
    assert rows(rank.unmatched_ids(run, docs), "doc_id") == [(99,)]


def test_coverage_relational_equals_pairwise(spark):
    run = run_df(spark, [(1, 1, 0, .5), (1, 2, 1, .4), (2, 1, 2, .3), (2, 2, 9, .1)])
    q = spark.createDataFrame([(1, "red apple red"), (2, "")], "qid long, query string")
    docs = spark.createDataFrame([(0, "blue"), (1, "an Apple, red"), (2, "x")], "doc_id long, text string")
    rel = dict(((r["qid"], r["doc_id"]), r["pair_score"]) for r in rank.coverage_scores.score_run(run, q, docs).collect())
    pairs = rank.attach_text(run, docs).join(q, "qid")
    pw = dict(((r["qid"], r["doc_id"]), r["pair_score"]) for r in rank.coverage_scores(pairs).collect())
    assert rel == pw == {(1, 0): 0.0, (1, 1): 1.0, (2, 2): 0.0, (2, 9): 0.0}


def test_listwise_is_a_permutation_keeping_scores(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 15), st.text(alphabet="0123456789 ,[]().x", max_size=25)),
                    min_size=30, max_size=30))
    def check(cases):
        data, comps = [], []
        for qid, (n, comp) in enumerate(cases):
            data += [(qid, r, 1000 * qid + r, float(n - r)) for r in range(1, n + 1)]
            comps.append((qid, comp))
        run = run_df(spark, data)
        out = rank.listwise_rerank(run, spark.createDataFrame(comps, "qid long, completion string"))
        got = sorted(rows(out, "qid", "doc_id", "score"))
        assert got == sorted((q, d, s) for q, _, d, s in data)
        ranks = sorted(rows(out, "qid", "rank"))
        assert ranks == sorted((q, r) for q, r, _, _ in data)

    check()


def fused_order(dense_ids, bm25_ids, k=60):
    """Expected order from exact fractions: larger sum first, then dense rank, then BM25 rank."""
    last = 10**6
    place = {d: (dense_ids.index(d) + 1 if d in dense_ids else last, bm25_ids.index(d) + 1 if d in bm25_ids else last)
             for d in {*dense_ids, *bm25_ids}}
    gain = {d: sum(Fraction(1, k + r) for r in ranks if r != last) for d, ranks in place.items()}
    return sorted(place, key=lambda d: (-gain[d], *place[d]))


def test_rrf_matches_stable_sort_semantics(spark):
    import random

    rnd = random.Random(5)
    dense_rows, bm25_rows, want = [], [], {}
    for qid in range(40):
        pool = list(range(30))
        d = rnd.sample(pool, rnd.randint(0, 12))
        b = rnd.sample(pool, rnd.randint(0, 12))
        dense_rows += [(qid, r, doc, 1.0) for r, doc in enumerate(d, start=1)]
        bm25_rows += [(qid, r, doc, 1.0) for r, doc in enumerate(b, start=1)]
        want[qid] = fused_order(d, b)
    fused = rank.rrf_fuse(run_df(spark, dense_rows), run_df(spark, bm25_rows))
    got = {}
    for qid, _, doc in sorted(rows(fused, "qid", "rank", "doc_id")):
        got.setdefault(qid, []).append(doc)
    assert {q: v for q, v in want.items() if v} == got


LISTWISE_CASES = [
    # (number of hits, completion, expected order of the hits 1, 2, ...)
    (5, "[3] [1]", [3, 1, 2, 4, 5]),
    (5, "2,2,5", [2, 5, 1, 3, 4]),
    (5, "(4). 01 x", [4, 1, 2, 3, 5]),
    (3, "9 0 2", [2, 1, 3]),
    (12, "11 10 12", [10, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12]),
    (12, "7]", [7, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12]),
    (4, "", [1, 2, 3, 4]),
    (4, "none of them", [1, 2, 3, 4]),
    (4, None, [1, 2, 3, 4]),
    (1, "1 1 1", [1]),
]


def test_listwise_fixed_cases(spark):
    data, comps = [], []
    for qid, (n, completion, _) in enumerate(LISTWISE_CASES):
        data += [(qid, r, 100 * qid + r, 10.0 - r) for r in range(1, n + 1)]
        comps.append((qid, completion))
    out = rank.listwise_rerank(run_df(spark, data), spark.createDataFrame(comps, "qid long, completion string"))
    got = {}
    for qid, _, doc, score in sorted(rows(out, "qid", "rank", "doc_id", "score")):
        got.setdefault(qid, []).append((doc - 100 * qid, score))
    assert got == {qid: [(d, 10.0 - d) for d in want] for qid, (_, _, want) in enumerate(LISTWISE_CASES)}
