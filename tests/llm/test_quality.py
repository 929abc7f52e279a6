import math

import pytest

from lumenrank.llm import quality as Q

from tests.conftest import SF01


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.filter("doc_id % 4 != 0"), labels.filter("doc_id % 4 = 0")
    out = Q.classify(docs, train).selectExpr("__row.doc_id", "accepted", "__row.text")
    got = out.join(held, "doc_id").selectExpr(
        "accepted", "quality = 1 AND toxic = 0 AS good", "toxic = 1 AS toxic", "quality = 0 AS junk").toPandas()
    clean, toxic, junk = got[got.good], got[got.toxic], got[got.junk]
    assert clean.accepted.mean() > 0.98
    assert toxic.accepted.mean() < 0.1
    assert junk.accepted.mean() < 0.1


def test_prior_weight(spark):
    def sites(rates, n):
        return spark.createDataFrame([(float(n), r * n, 0.5) for r in rates], "n double, good double, parent double")

    assert Q.prior_weight(sites([0.5] * 10, 100)) == Q.PRIOR_WEIGHTS[1]
    spread = Q.prior_weight(sites([0.1, 0.9] * 10, 1000))
    assert spread == Q.PRIOR_WEIGHTS[0]  # 0.25 / 0.16 - 1 is below the bound
    assert Q.prior_weight(sites([0.4, 0.6] * 10, 1000)) == pytest.approx(0.25 / 0.01 - 1, rel=0.15)


def test_sparse_sites_shrink_and_large_ones_speak(spark):
    good, bad = "calm steady words about rivers", "JUNK!!! JUNK!!! JUNK!!!"
    rows = [(i, good, "a", "x") for i in range(60)] + [(100 + i, bad, "b", "x") for i in range(60)]
    rows += [(300, "unseen terms only", "a", "x"), (301, "unseen terms only", "b", "x"), (302, "unseen terms only", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)],
                                   "doc_id long, quality int, toxic int")
    got = {r["__row"]["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    assert got[300]["score"] > got[302]["score"] > got[301]["score"]
    assert got[0]["accepted"] and not got[100]["accepted"]
    assert got[0]["host_rate"] > got[302]["host_rate"] > got[100]["host_rate"]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, "z"), (1, None, None, None, "z"), (None, "", "s", "en", "z"),
                                  (2, "word " * 50_000, "s", "en", "z")],
                                 "doc_id long, text string, source string, lang string, score string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.accepted(docs, no_labels).columns == docs.columns
    assert Q.accepted(docs, no_labels).count() == 4
    odd = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, 1, 0), (None, 1, 0), (9, 1, 0), (3, None, None)],
                                "doc_id long, quality int, toxic int")
    out = Q.classify(docs, odd).collect()
    assert len(out) == 4 and all(not math.isnan(r["score"]) for r in out)
    assert Q.classify(docs.limit(0), no_labels).collect() == []


def test_query(spark):
    rows = Q.op4(spark, SF01)
    assert rows.count() == 1000 and rows.select("doc_id").distinct().count() == 1000


def test_the_fit_is_not_cut_short(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    fitted = Q.fit(docs, labels).stages[-1]
    assert fitted.getMaxIter() >= 100
    assert fitted.summary.totalIterations < fitted.getMaxIter()


def shrinkage(rows):
    """(host rate, path rate, score) per row of (host, path, evidence), in plain arithmetic."""
    def weight(sites):  # (n, good, parent)
        low, high = Q.PRIOR_WEIGHTS
        total = sum(n for n, _, _ in sites)
        if not total or len(sites) < 2:
            return high
        noise = sum(n * q * (1 - q) for n, _, q in sites) / total
        spread = sum(n * (g / n - q) ** 2 for n, g, q in sites) - (len(sites) - 1) * noise
        freedom = total - sum(n * n for n, _, _ in sites) / total
        between = spread / freedom if freedom > 0 else 0.0
        return high if between <= 0 else min(high, max(low, noise / between - 1))

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    p = [1 / (1 + math.exp(-e)) for _, _, e in rows]
    hosts, paths = {}, {}
    for (h, w, _), x in zip(rows, p):
        for table, key in ((hosts, h), (paths, (h, w))):
            n, good = table.get(key, (0, 0.0))
            table[key] = (n + 1, good + x)
    rate = sum(p) / len(p)
    k = weight([(n, g, rate) for n, g in hosts.values()])
    host_rate = {h: (g + k * rate) / (n + k) for h, (n, g) in hosts.items()}
    k = weight([(n, g, host_rate[h]) for (h, _), (n, g) in paths.items()])
    out = []
    for (h, w, e), x in zip(rows, p):
        n, g = paths[h, w]
        path = (g - x + k * host_rate[h]) / (n - 1 + k)  # without the row's own share
        out.append((host_rate[h], path, 1 / (1 + math.exp(-(e + logit(path) - logit(rate))))))
    return out


def test_posteriors_against_plain_arithmetic(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "source", "lang")
    got = Q.classify(docs, spark.read.parquet(f"{SF01}/labels.parquet")).selectExpr(
        "coalesce(__row.source, '') AS host", "coalesce(__row.lang, '') AS path", "evidence", "host_rate", "path_rate", "score",
        "accepted").collect()
    want = shrinkage([(r["host"], r["path"], r["evidence"]) for r in got])
    assert len(got) == 1000 and len({r["host"] for r in got}) > 2
    for r, w in zip(got, want):
        assert (r["host_rate"], r["path_rate"], r["score"]) == pytest.approx(w, rel=1e-9)
        assert r["accepted"] == (r["score"] >= Q.ACCEPT)
