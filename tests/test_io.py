import json
import os

from pyspark.sql import functions as F

from lumenrank.sources import io

from .conftest import rows


def test_corpus_tsv_quoting_and_file_order(spark, tmp_path):
    d = tmp_path / "corpus"
    d.mkdir()
    # two files: ids follow file order, then line order
    (d / "part-0.tsv").write_text('title\ttext\nt0\t"has\ttab and ""quote"" and\nnewline"\nt1\tNA\n', encoding="utf-8")
    (d / "part-1.tsv").write_text('title\ttext\nt2\t""\nt3\tplain\n', encoding="utf-8")
    got = rows(io.read_corpus_tsv(spark, str(d)).orderBy("id"), "id", "text")
    assert [i for i, _ in got] == [0, 1, 2, 3]
    assert got[0][1] == 'has\ttab and "quote" and\nnewline'
    assert got[1][1] == "NA"  # kept as text
    assert got[3][1] == "plain"


def test_query_tsv_and_answers(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_text("who\t['a', \"b's\"]\nwhat\t[]\nwhere\tnot a list\n", encoding="utf-8")
    got = rows(io.read_query_tsv(spark, str(p)).orderBy("qid"), "qid", "query", "answers")
    assert got == [(0, "who", ["a", "b's"]), (1, "what", []), (2, "where", [])]


def test_training_source_json_array(spark, tmp_path):
    p = tmp_path / "train.json"
    data = [
        {"question": "q1", "positive_ctxs": [{"text": "p1", "title": "x"}], "hard_negative_ctxs": [{"text": "n1"}]},
        {"question": "q2", "positive_ctxs": [], "hard_negative_ctxs": []},
    ]
    p.write_text(json.dumps(data, indent=2), encoding="utf-8")
    got = io.read_training_source(spark, str(p)).select(
        "question", F.transform("positive_ctxs", lambda c: c["text"]).alias("p")
    )
    assert sorted(rows(got)) == [("q1", ["p1"]), ("q2", [])]


def test_jsonl_roundtrip_keeps_nulls_and_utf8(spark, tmp_path):
    df = spark.createDataFrame([("é", None, ["x"])], "query string, note string, pos array<string>")
    path = str(tmp_path / "out")
    io.write_jsonl(df, path)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".json"))
    assert '"note":null' in text and "é" in text
    back = io.read_training_rows(spark, path)
    assert rows(back, "query", "pos", "neg") == [("é", ["x"], None)]


def test_run_and_hits_sinks(spark, tmp_path):
    run = spark.createDataFrame([(0, 1, 5, 1.5)], "qid long, rank int, doc_id long, score double")
    p = io.run_path(str(tmp_path), {"mixed", "hyde"})
    assert p.endswith("/hyde_mixed")
    assert io.run_path(str(tmp_path), set()).endswith("/none")
    io.write_run(run, p)
    assert rows(io.read_run(spark, p)) == [(0, 1, 5, 1.5)]
    hits = spark.createDataFrame([(1, 0, 1), (10, 0, 1), (1, 1, 0)], "k long, qid long, hit long")
    hp = str(tmp_path / "hits")
    io.write_hits(hits, hp)
    assert {"k=1", "k=10"} <= set(os.listdir(hp))
    back = spark.read.options(sep="\t", header="true").csv(os.path.join(hp, "k=1"))
    assert sorted(rows(back, "id", "hit")) == [("1", "1"), ("2", "0")]


def test_bm25_index_sink_and_source(spark, tmp_path):
    from lumenrank.operators import lexical

    docs = spark.createDataFrame([(0, "a b"), (1, "b c"), (2, ""), (3, "c c d")], "doc_id long, text string")
    idx = lexical.build_index(docs)
    io.write_bm25_index(idx, str(tmp_path / "bm25"))
    back = io.read_bm25_index(spark, str(tmp_path / "bm25"))
    assert back.postings.count() == 6 and back.term_stats.count() == 4
    assert io.read_bm25_index(spark, None) is None
    q = spark.createDataFrame([(1, "c b"), (2, "d")], "qid long, query string")
    fresh = lexical.bm25_search(back, q)
    assert sorted(rows(fresh)) == sorted(rows(lexical.bm25_search(idx, q)))
    fresh.collect()
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_pool_texts_and_vectors(spark, tmp_path):
    pool = spark.createDataFrame([(0, "x"), (1, "y")], "id long, text string")
    io.write_jsonl(pool, str(tmp_path / "pool"))
    assert sorted(rows(io.read_pool_texts(spark, str(tmp_path / "pool")))) == [("x",), ("y",)]
    vec = spark.createDataFrame([(0, [0.5, 0.5])], "id long, embedding array<float>")
    io.write_vectors(vec, str(tmp_path / "vec"))
    assert rows(io.read_vectors(spark, str(tmp_path / "vec"))) == [(0, [0.5, 0.5])]


def test_term_partitioned_index_sink_and_source(spark, tmp_path):
    import re

    from lumenrank.operators import lexical

    docs = spark.createDataFrame([(0, "a b"), (1, "b c"), (2, ""), (3, "c c d")], "doc_id long, text string")
    idx = lexical.build_index(docs, with_positions=False, materialize=True, term_buckets=16)
    io.write_bm25_index(idx, str(tmp_path / "bm25tb"))
    back = io.read_bm25_index(spark, str(tmp_path / "bm25tb"))
    assert back.term_buckets == 16 and back.postings.count() == 6
    q = spark.createDataFrame([(1, "c b"), (2, "d")], "qid long, query string")
    fresh = lexical.bm25_search(back, q)
    assert sorted(rows(fresh)) == sorted(rows(lexical.bm25_search(idx, q)))
    fresh.collect()
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*tb#\d+L? IN \(", plan) and "Bucketed: true" in plan


def test_training_file_to_training_rows(spark, tmp_path):
    from lumenrank.operators import training

    p = tmp_path / "train.json"
    data = [{"question": f"q{i}", "positive_ctxs": [{"text": f"p{i}"}], "hard_negative_ctxs": []} for i in range(5)]
    p.write_text(json.dumps(data), encoding="utf-8")
    tr = training.training_rows(io.read_training_source(spark, str(p)))
    assert sorted(rows(tr, "qid", "query", "pos")) == [(i, f"q{i}", [f"p{i}"]) for i in range(5)]
    io.write_jsonl(tr.drop("qid"), str(tmp_path / "rows"))
    back = io.read_training_rows(spark, str(tmp_path / "rows"))
    assert sorted(rows(back, "query")) == [(f"q{i}",) for i in range(5)] and back.select("qid").distinct().count() == 5


def test_corpus_tsv_takes_as_many_files_as_its_text_fills(spark, tmp_path, monkeypatch):
    """A multi-line file is one task's, so files are dealt by bytes; ids still follow the rows."""
    from lumenrank.plans import catalog

    texts = [f"text {i}\n\"second\" line" if i % 9 else None for i in range(300)]
    docs = spark.createDataFrame([(i, "web", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(io, "FILE_BYTES", 500)
    assert io.file_count(docs, 4) > 10 and io.file_count(docs.limit(0), 4) == 4
    written = []
    real = io.write_corpus_tsv
    monkeypatch.setattr(io, "write_corpus_tsv", lambda df, path: (written.append(path), real(df, path)))
    got = sorted(rows(catalog.q_roundtrip_tsv(spark, str(tmp_path)), "id", "text"))
    assert got == [(i, t) for i, t in enumerate(texts)]
    sizes = [os.path.getsize(f"{written[0].removeprefix('file:')}/{f}") for f in os.listdir(written[0].removeprefix("file:")) if f.endswith(".csv")]
    assert len(sizes) > 10 and max(sizes) < 3000


def test_ids_of_training_rows_hold_without_a_copy_under_other_settings(spark, tmp_path):
    import json

    for f in range(3):
        (tmp_path / f"part-{f}.json").write_text("".join(json.dumps({"query": f"{f}-{i}", "pos": ["p"]}) + "\n" for i in range(200)))
    got = io.read_training_rows(spark, str(tmp_path))
    assert "ExistingRDD" in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert sorted((r["qid"], r["query"]) for r in got.collect()) == [(200 * f + i, f"{f}-{i}") for f in range(3) for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parts_of_a_table_are_written_one_after_the_other(spark, tmp_path):
    path = str(tmp_path / "out")
    for compression in ("none", "gzip"):
        io.write_jsonl((spark.range(p * 10, p * 10 + 10) for p in range(3)), path, compression)
        assert sorted(r[0] for r in spark.read.json(path).collect()) == list(range(30))
