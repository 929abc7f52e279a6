"""Resumable model batches: failures, reruns, versions; calls are counted in a file."""

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import batches, rank

from .conftest import rows


def counting(log, broken="-"):
    def model(texts, n=None):
        for t in texts:
            if t == broken:
                raise RuntimeError("model down")
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [None if t is None else t.upper() for t in texts]

    return model


def calls(log):
    return sorted(log.read_text().split("\n")[:-1]) if log.exists() else []


def test_a_rerun_calls_only_what_is_unfinished(spark, tmp_path):
    log, texts = tmp_path / "log", [f"text {i % 60}" for i in range(200)] + [None, "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "qid long, prompt string").repartition(3)
    ledger = batches.Ledger(spark, str(tmp_path / "ledger"), "upper", "string")
    with pytest.raises(Exception, match="model down"):
        ledger.run(df, ["prompt"], counting(log, "text 17"), "v1", chunks=8)
    before = calls(log)
    kept = {r["result"] for r in ledger.entries("v1").collect()}
    assert 0 < len(kept) < 62  # the chunks before the failing one were committed
    out = ledger.run(df, ["prompt"], counting(log), "v1", chunks=8)
    assert sorted(rows(out, "qid", "result")) == [(i, None if t is None else t.upper()) for i, t in enumerate(texts)]
    after = calls(log)
    again = list(after)
    for t in before:
        again.remove(t)
    assert len(again) == len(set(again)) == 62 - len(kept) and not {t.upper() for t in again} & kept
    ledger.run(df, ["prompt"], counting(log, "text 17"), "v1", chunks=8).count()  # nothing left to call
    assert calls(log) == after
    ledger.run(df.where("qid < 5"), ["prompt"], counting(log), "v2").count()
    assert len(calls(log)) == len(after) + 5


def test_digests_tell_inputs_apart(spark):
    df = spark.createDataFrame([("a", "b\n1:c"), ("a\n3:b", "c"), (None, "a"), ("null", "a"), ("", None), (None, ""), ("a", "b\n1:c")],
                               "x string, y string")
    assert df.select(batches.input_digest("x", "y").alias("d")).distinct().count() == 6


def test_double_entries_count_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "qid long, prompt string")
    ledger = batches.Ledger(spark, str(tmp_path), "m", "string")
    ledger.run(df, ["prompt"], lambda t: t, "v")
    ledger.entries("v").write.mode("append").parquet(f"{ledger.folder}/version=v")
    assert rows(ledger.run(df, ["prompt"], lambda t: 1 / 0, "v"), "qid", "result") == [(1, "a")]


def test_encoder_scorer_and_generator(spark, tmp_path):
    vec = batches.Ledger(spark, str(tmp_path), "vectors", "array<double>")
    docs = spark.createDataFrame([(1, "ab"), (2, None), (3, "ab")], "doc_id long, text string")
    got = batches.encoder(vec, lambda ts: [[len(t), 1] for t in ts], "v")(docs)
    assert sorted(rows(got, "doc_id", "embedding")) == [(1, [2.0, 1.0]), (3, [2.0, 1.0])]
    pairs = batches.Ledger(spark, str(tmp_path), "pairs", "double")
    run = spark.createDataFrame([(1, 1, 1, 0.0), (1, 2, 3, 0.0)], "qid long, rank int, doc_id long, score double")
    q = spark.createDataFrame([(1, "abc")], "qid long, query string")
    scored = rank.score_pairs(run, q, docs, batches.pair_scorer(pairs, lambda qs, ts: [len(x) / len(y) for x, y in zip(ts, qs)], "v"))
    assert sorted(rows(scored, "doc_id", "pair_score")) == [(1, 2 / 3), (3, 2 / 3)]
    assert pairs.entries("v").count() == 1  # equal pairs are one call
    made = batches.generate(batches.Ledger(spark, str(tmp_path), "text", "string"),
                            q.select("qid", F.col("query").alias("prompt")), lambda ps, n: [p * n for p in ps], 2, "v")
    assert rows(made) == [(1, "abcabc")]
