from lumenrank.operators import lexical
from lumenrank.streaming import query_stream

from .conftest import rows

DOCS = [(0, "red apple pie"), (1, "apple juice"), (2, "blue sky"), (3, "red sky at night")]


def test_stream_matches_batch_and_resumes(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = lexical.build_index(docs, with_positions=False, materialize=True)
    src, sink, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    first = spark.createDataFrame([(1, "red apple"), (2, "sky")], "qid long, query string")
    first.coalesce(1).write.parquet(f"{src}/a")
    retrieve = lambda q: lexical.bm25_search(index, q, k=3)
    query_stream.start(spark, f"{src}/*", retrieve, sink, ckpt).awaitTermination()
    second = spark.createDataFrame([(3, "night juice")], "qid long, query string")
    second.coalesce(1).write.parquet(f"{src}/b")
    query_stream.start(spark, f"{src}/*", retrieve, sink, ckpt).awaitTermination()  # resumes: only new files
    out = query_stream.read_sink(spark, sink)
    want = lexical.bm25_search(index, first.unionByName(second), k=3)
    assert sorted(rows(out, "qid", "rank", "doc_id", "score")) == sorted(rows(want, "qid", "rank", "doc_id", "score"))
    assert out.select("batch_id").distinct().count() == 2
