"""A third of all rows on one key: results stay exact and whole."""

from pyspark.sql import functions as F

from lumenrank.operators import lexical, mining, rank

from .conftest import rows
from .test_lexical_eval import brute_bm25


def skewed_docs():
    hot = "the hot passage repeated many times"
    docs = []
    for i in range(300):
        text = hot if i % 3 == 0 else f"the passage number {i} about topic {i % 7}"
        docs.append((i, text))
    return docs


def test_bm25_hot_term_and_duplicates(spark):
    docs = skewed_docs()
    queries = [(1, "the passage"), (2, "topic 3 hot"), (3, "the")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "qid long, query string")
    idx = lexical.build_index(df, materialize=True)
    got = sorted(rows(lexical.bm25_search(idx, q, k=150), "qid", "rank", "doc_id"))
    want = [w[:3] for w in brute_bm25(docs, queries, k=150)]
    assert got == want


def test_distinct_corpus_with_hot_text(spark):
    docs = skewed_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    numbered = mining.number_corpus(mining.corpus_from_pool(df))
    got = rows(numbered.orderBy("idx"), "idx")
    assert [i for (i,) in got] == list(range(len({t for _, t in docs})))


def test_rrf_and_listwise_with_hot_query(spark):
    # one query holds most of the run rows
    data = [(0, r, r, 1.0 / r) for r in range(1, 301)] + [(q, 1, 5, 1.0) for q in range(1, 51)]
    run = spark.createDataFrame(data, "qid long, rank int, doc_id long, score double")
    fused = rank.rrf_fuse(run, run)
    assert fused.where("qid = 0").count() == 300
    assert rows(fused.where("qid = 0 and rank = 1"), "doc_id") == [(1,)]
    comp = spark.createDataFrame([(0, "2 1")], "qid long, completion string")
    out = rank.listwise_rerank(run, comp)
    assert rows(out.where("qid = 0").orderBy("rank").limit(3), "doc_id") == [(2,), (1,), (3,)]
    assert out.count() == run.count()


def spread(df, n=8):
    return [c for _, c in sorted(rows(df.groupBy(F.spark_partition_id().alias("p")).count(), "p", "count"))]


def test_hot_passage_is_spread(spark, monkeypatch):
    """One passage in every list, AQE off: no task of the lookup gets more than its share."""
    from lumenrank import config as C
    from lumenrank.operators.plan import lookup

    n = 4000
    run = spark.range(n).selectExpr("id AS qid", "1 AS rank", "7L AS doc_id", "1.0D AS score").unionByName(
        spark.range(n).selectExpr("id AS qid", "2 AS rank", "id + 100 AS doc_id", "0.5D AS score")).unionByName(
        spark.range(50).selectExpr("id AS qid", "3 AS rank", "CAST(NULL AS LONG) AS doc_id", "0.1D AS score"))
    docs = spark.range(n + 100).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = lookup(run, docs, "doc_id")
        assert max(spread(plain)) > n  # by default a key of so few rows is not hot
        monkeypatch.setattr(C, "HOT_ROWS", 100)
        out = rank.attach_text(run, docs)
        counts = spread(out)
        assert len(counts) == 8 and max(counts) < 1.6 * sum(counts) / 8
        assert sorted(map(str, rows(out, "qid", "rank", "doc_id", "text"))) == sorted(map(str, rows(plain, "qid", "rank", "doc_id", "text")))
        assert out.where("doc_id = 7 AND text = 'text 7'").count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_of_hot_passages_by_index_and_without(spark, monkeypatch):
    from lumenrank import config as C

    monkeypatch.setattr(C, "HOT_ROWS", 3)
    docs = spark.createDataFrame([(0, "red apple pie"), (1, "Green PEAR"), (2, None), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["red pear", "apple apple", "", None, "green red pie"] * 4)],
                                    "qid long, query string")
    run = queries.crossJoin(docs.select("doc_id")).selectExpr("qid", "CAST(doc_id + 1 AS INT) AS rank", "doc_id", "0.0D AS score")
    index = lexical.build_index(docs, with_positions=False, materialize=True)
    found = [sorted(rows(rank.score_pairs(run, queries, docs, s), "qid", "doc_id", "pair_score"))
             for s in (rank.CoverageScorer(), rank.CoverageScorer(index))]
    pairs = run.join(docs, "doc_id").join(queries, "qid")
    assert found[0] == found[1] == sorted(rows(rank.coverage_scores(pairs), "qid", "doc_id", "pair_score"))
    assert {s for _, _, s in found[0]} == {0.0, 0.5, 1.0, 2 / 3, 1 / 3}


def test_scorer_shuffles_no_terms(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common word3")], "qid long, query string")
    run = spark.createDataFrame([(1, 1, 3, 1.0), (1, 2, 4, .5)], "qid long, rank int, doc_id long, score double")
    index = lexical.build_index(docs, with_positions=False, materialize=True)
    out = rank.score_pairs(run, queries, docs, rank.CoverageScorer(index))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    import re
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term", plan)


def test_exclusion_of_a_very_long_list(spark):
    """100,000 positives on one row: the candidates meet them once, by digest."""
    from lumenrank.operators.mining import without

    pos = [f"passage {i}" for i in range(100_000)]
    tr = spark.createDataFrame([(1, "the query", pos + [None], ["x"]), (2, "q", None, None), (3, "passage 5", ["a"], [])],
                               "qid long, query string, pos array<string>, neg array<string>")
    cand = spark.range(99_000, 101_000).selectExpr("1L AS qid", "id AS i", "concat('passage ', id) AS text").unionByName(
        spark.createDataFrame([(1, -1, "the query"), (2, 0, "q"), (2, 1, "other"), (3, 2, "passage 5"), (3, 3, "a"), (3, 4, "b"),
                               (1, -2, "x")], "qid long, i long, text string"))
    out = without(cand, tr, "qid", "i")
    assert sorted(rows(out, "qid", "i")) == [(1, -2)] + [(1, i) for i in range(100_000, 101_000)] + [(2, 1), (3, 4)]
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert without(cand, tr, "qid", "i", lists=("pos", "neg")).where("i = -2").count() == 0
