import os

from lumenrank import config as C
from lumenrank.operators import generate, lexical, rank
from lumenrank.plans import compose as P
from lumenrank.sources import fixtures as fx

from .conftest import SF001, rows


def test_generate_job_and_failure(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "bb")], "qid long, prompt string")
    comp = generate.generate(prompts, lambda ps, n: [p.upper() for p in ps])
    assert sorted(rows(comp)) == [(1, "A", None), (2, "BB", None)]

    def broken(ps, n):
        if "a" in ps:
            raise RuntimeError("model down")
        return [p.upper() for p in ps]

    got = sorted(rows(generate.generate(prompts.coalesce(1), broken)))
    assert got == [(1, None, "RuntimeError: model down"), (2, "BB", None)]
    assert generate.generate(prompts, None) is None


def test_generated_completions_drive_listwise(spark):
    run = spark.createDataFrame([(1, r, 10 + r, 1.0) for r in range(1, 4)], "qid long, rank int, doc_id long, score double")
    q = spark.createDataFrame([(1, "who")], "qid long, query string")
    docs = spark.createDataFrame([(11, "x"), (12, "y"), (13, "z")], "doc_id long, text string")
    prompts = rank.listwise_prompts(run, q, docs)
    comp = generate.generate(prompts, lambda ps, n: ["3, 1" for _ in ps])
    assert [d for (d,) in rows(rank.listwise_rerank(run, comp).orderBy("rank"), "doc_id")] == [13, 11, 12]


def test_parse_methods_and_k_list():
    assert P.parse_methods(" mixed, ,hyde,unknown") == {"mixed", "hyde", "unknown"}
    assert P.parse_methods("") == set()
    assert P.parse_k_list(None) == [1, 10, 100]
    assert P.parse_k_list("1, 5,,10") == [1, 5, 10]


def test_run_job_writes_run_and_hits(spark, tmp_path):
    q = fx.query_set(spark, SF001)
    docs = fx.corpus(spark, SF001)
    inp = P.Inputs(queries=q, docs=docs, bm25=lexical.build_index(docs, with_positions=False, materialize=True))
    path, means = P.run_job(inp, {"mixed"}, str(tmp_path))
    assert path.endswith("/mixed")
    assert os.path.isdir(os.path.join(path, "run")) and os.path.isdir(os.path.join(path, "hits", "k=100"))
    lines = (open(os.path.join(path, "hit@10.txt")).read()).split("\n")
    assert lines[0] == "id\thit" and [x.split("\t")[0] for x in lines[1:-1]] == [str(i + 1) for (i,) in sorted(rows(q, "qid"))]
    m = dict(rows(means, "k", "hit_rate"))
    assert m[1] <= m[10] <= m[100]
    path2, none = P.run_job(inp, set(), str(tmp_path), skip_eval=True)
    assert none is None and path2.endswith("/none") and not os.path.exists(os.path.join(path2, "hits"))


def test_missing_inputs_degrade_or_raise(spark):
    import pytest

    q = fx.query_set(spark, SF001)
    inp = P.Inputs(queries=q, docs=fx.corpus(spark, SF001))
    dense_only = sorted(rows(P.retrieve(inp, set())))
    assert sorted(rows(P.retrieve(inp, {"mixed", "hyde"}, missing_ok=True))) == dense_only
    for method in ("mixed", "hyde", "listwise_rerank"):
        with pytest.raises(P.MissingInputError):
            P.retrieve(inp, {method})


def test_generator_inside_the_job(spark):
    q = fx.query_set(spark, SF001)
    docs = fx.corpus(spark, SF001)

    def model(prompts, n):
        start, end = len(C.HYDE_PROMPT_PREFIX), -len(C.HYDE_PROMPT_SUFFIX)
        return ["2 1" if "candidate documents" in p else p[start:end].upper() for p in prompts]

    made = P.Inputs(queries=q, docs=docs, generator=model)
    given = P.Inputs(queries=q, docs=docs,
                     hyde_completions=q.selectExpr("qid", "upper(query) AS completion"),
                     listwise_completions=q.selectExpr("qid", "'2 1' AS completion"))
    methods = {"hyde", "listwise_rerank"}
    assert sorted(rows(P.retrieve(made, methods))) == sorted(rows(P.retrieve(given, methods)))


def test_mining_file_to_file_keeps_other_keys(spark, tmp_path):
    import json

    texts = [f"passage {i} about apples" for i in range(40)]
    lines = [{"query": "apples", "pos": [texts[0], None], "note": {"a": 1}}, {"query": "pears", "pos": None, "neg": ["x"], "note": None},
             {"query": "passage 3", "pos": texts[1:], "weight": 2.5}]
    src = tmp_path / "train.jsonl"
    src.write_text("\n".join(map(json.dumps, lines)))
    for pool in (None, str(tmp_path / "pool")):
        if pool:
            spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.json(pool)
        out = str(tmp_path / f"out-{bool(pool)}")
        mined = sorted(P.mine_files(spark, str(src), out, pool, window="0-30").collect(), key=lambda r: r["qid"])
        assert [len(r["neg"]) for r in mined[:2]] == [15, 15]
        assert texts[0] not in mined[0]["neg"]
        if pool:
            assert set(mined[2]["neg"]) == {texts[0]} and mined[2]["short"] == 1
        back = spark.read.json(out)
        assert {"query", "pos", "neg", "note", "weight"} <= set(back.columns)
        assert {r["weight"] for r in back.collect()} == {None, 2.5}


def test_offline_evaluation(spark, tmp_path):
    import pytest

    from lumenrank.operators.evaluate import AlignmentError

    pool, qs, run = (str(tmp_path / x) for x in ("pool", "queries", "run"))
    spark.createDataFrame([(0, "red apple"), (1, "green pear")], "id long, text string").coalesce(1).write.json(pool)
    (tmp_path / "queries").write_text("fruit\t\"['apple']\"\nother\t\"['plum']\"\n")
    spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 0, 0.5), (1, 1, 0, 1.0)], "qid long, rank int, doc_id long, score double") \
        .write.parquet(run)
    means = P.evaluate_saved(spark, run, qs, pool, str(tmp_path / "hits"), ks=(1, 2))
    assert sorted(rows(means, "k", "hit_rate")) == [(1, 0.0), (2, 0.5)]
    one = spark.read.parquet(run).where("qid = 0")  # the other query matched nothing: it counts as 0
    one.write.parquet(run + "-part")
    means = P.evaluate_saved(spark, run + "-part", qs, pool, str(tmp_path / "hits2"), ks=(1, 2))
    assert sorted(rows(means, "k", "hit_rate")) == [(1, 0.0), (2, 0.5)]
    one.selectExpr("qid + 7 AS qid", "rank", "doc_id", "score").write.parquet(run + "-odd")
    with pytest.raises(AlignmentError):
        P.evaluate_saved(spark, run + "-odd", qs, pool, str(tmp_path / "hits3"))
