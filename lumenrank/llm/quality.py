"""Quality classifier with hierarchical empirical Bayes (operator 4).

1. Evidence: a logistic regression over the presence of words and text shapes that tell
   the classes apart, fitted on at most about ``MAX_LABELS`` labelled rows (a hash sample of
   the labels; the only sampled step) and applied to every whole text. A document is good when its
   quality label is 1 and its toxic label is not 1.
2. Sites: per host (``source``) and path (``source`` and ``lang``) the expected number of
   good documents, summed over *all* documents. A path's rate is shrunk toward its host's,
   a host's toward the global rate. How strongly is estimated from the data (method of
   moments on the variance between sites), so sparse sites borrow and large ones speak.
3. A document's posterior adds its evidence and its path's log odds against the global
   ones, its own share left out; it is accepted from ``ACCEPT`` on.

Site totals are grouped sums with map-side partial aggregation, so a host with a third of
all rows is one partial row per task. The site table is written; the planner joins it by
its measured size.

Edge cases: a null text counts as empty; a null host or language is a site of its own;
without labels of both classes there is no evidence and every document keeps the prior and
is accepted; conflicting labels of one id count as bad; labels of unknown ids are unused;
repeated rows count each; an empty table gives an empty result; extra columns are kept by
``accepted`` and do not matter.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, written

#: Labelled rows to fit on, by expectation.
MAX_LABELS = 20_000
#: Tokens of the classifier: present in at least MIN_DOCS labelled documents, with a
#: likelihood-ratio statistic of at least MIN_STRENGTH (p about 1e-5), the strongest.
MIN_DOCS, MIN_STRENGTH, MAX_FEATURES = 5, 20.0, 4096
PREFIXES = (4, 5)
#: Tasks of one step of the fit, over at most MAX_LABELS sparse vectors.
FIT_TASKS = 4
REGULARISATION = 1e-5
#: Steps of the fit at most; it ends before when a step improves less than the tolerance.
MAX_STEPS = 100
ACCEPT = 0.5
#: Bounds of the estimated prior weights, in documents.
PRIOR_WEIGHTS = (1.0, 1e6)
_ROW, _TEXT = "__row", "__text"


def tokens(text: Column) -> Column:
    """What the classifier may look at, each once: lower-case words, their beginnings
    (``PREFIXES`` characters), runs of symbols, and shares of the text in steps."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    distinct = F.array_distinct(words)
    lines = F.split(text, "\n")
    size = F.greatest(F.length(text), F.lit(1))
    symbols = F.split(text, r"[\p{L}\p{N}\s]+")
    starts = [F.array_distinct(F.transform(
        F.filter(distinct, lambda w: F.length(w) > n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))) for n in PREFIXES]

    def share(name: str, part: Column, whole: Column) -> Column:
        step = F.least(F.ceil(10 * part / F.greatest(whole, F.lit(1))), F.lit(20))
        return F.concat(F.lit(f"#{name}="), step.cast("string"))

    shape = F.array(
        share("upper", F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), size),
        share("symbols", F.size(symbols), F.size(words)),
        share("distinct", F.size(distinct), F.size(words)),
        share("lines", F.size(F.array_distinct(lines)), F.size(lines)),
        F.concat(F.lit("#length="), F.ceil(F.log2(size + 1)).cast("string")))
    return F.concat(distinct, *starts, F.array_distinct(symbols), shape)


def telling(train: DataFrame) -> list[str]:
    """The tokens that speak against a document: more frequent in bad ones, by a
    likelihood-ratio test of presence against label over the labelled sample, the strongest
    first, at most ``MAX_FEATURES``."""
    size = train.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    n, good = float(size["n"]), float(size["good"])
    seen = (train.select("label", F.explode(tokens(F.col(_TEXT))).alias("token")).filter("token != ''")
            .groupBy("token").agg(F.count("*").cast("double").alias("k"), F.sum("label").alias("g")))
    cells = [(F.col("g"), F.col("k") * good / n), (F.col("k") - F.col("g"), F.col("k") * (n - good) / n),
             (good - F.col("g"), (n - F.col("k")) * good / n),
             (n - good - F.col("k") + F.col("g"), (n - F.col("k")) * (n - good) / n)]
    strength = sum(F.when((o > 0) & (e > 0), 2 * o * F.log(o / e)).otherwise(0.0) for o, e in cells)
    seen = seen.filter(F.col("k") - F.col("g") > F.col("k") * (n - good) / n)
    strong = seen.filter(F.col("k") >= MIN_DOCS).withColumn("strength", strength).filter(F.col("strength") >= MIN_STRENGTH)
    return [r["token"] for r in strong.orderBy(F.desc("strength"), "token").limit(MAX_FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labels: int = MAX_LABELS) -> PipelineModel | None:
    """The document classifier, or None when the labels do not tell two classes apart."""
    good = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), (F.col("quality") == 1).cast("int"))
    marked = labels.select(F.col(id_col).alias("id"), good.alias("good")).filter("id IS NOT NULL AND good IS NOT NULL")
    marked = marked.groupBy("id").agg(F.min("good").cast("double").alias("label"))
    n = marked.count()
    if n > max_labels:
        marked = marked.filter(F.pmod(F.xxhash64("id", F.lit("labels")), F.lit(1 << 30)) < int(max_labels / n * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias(_TEXT))
    # The sample is bounded by max_labels rows of two numbers.
    train = written(texts.join(F.broadcast(marked), "id").select("label", _TEXT), "labelled")
    vocabulary = telling(train) if train.select("label").distinct().count() > 1 else []
    if not vocabulary:
        return None
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__tokens", outputCol="__features")
    vectors = vectors.setBinary(True)
    # Signs of a bad document may only lower the evidence: fluent words never outweigh them.
    model = LogisticRegression(
        featuresCol="__features", labelCol="label", regParam=REGULARISATION, maxIter=MAX_STEPS, standardization=False,
        family="binomial", upperBoundsOnCoefficients=DenseMatrix(1, len(vocabulary), [0.0] * len(vocabulary)))
    # The bounded sample's vectors are small: computed once, in few tasks for the many steps.
    points = written(vectors.transform(train.select("label", tokens(F.col(_TEXT)).alias("__tokens"))).drop("__tokens"), "points")
    fitted = model.fit(points.coalesce(FIT_TASKS))
    return PipelineModel([vectors, fitted])


def prior_weight(sites: DataFrame) -> float:
    """How many documents the parent's rate is worth to its sites: method of moments on
    the variance of site rates around the parent's beyond what counting noise explains."""
    r = sites.agg(F.sum("n").alias("n"), F.count("*").alias("sites"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                  F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("parent"), 2)).alias("spread"),
                  F.sum(F.col("n") * F.col("parent") * (1 - F.col("parent"))).alias("noise")).first()
    low, high = PRIOR_WEIGHTS
    if not r["n"] or r["sites"] < 2:
        return high
    noise = r["noise"] / r["n"]
    freedom = r["n"] - r["nn"] / r["n"]
    between = (r["spread"] - (r["sites"] - 1) * noise) / freedom if freedom > 0 else 0.0
    return high if between <= 0 else min(high, max(low, noise / between - 1))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_col: str = "lang", max_labels: int = MAX_LABELS) -> DataFrame:
    """``(__row: struct of all input columns, evidence, host_rate, path_rate, score, accepted)``."""
    model = fit(docs, labels, id_col, text_col, max_labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(row.alias(_ROW), F.coalesce(F.col(text_col), F.lit("")).alias(_TEXT),
                     F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                     F.coalesce(F.col(path_col), F.lit("")).alias("path"))
    if model is None:
        df = df.withColumn("evidence", F.lit(0.0))
    else:
        df = model.transform(df.withColumn("__tokens", tokens(F.col(_TEXT)))).withColumn("evidence", vector_to_array("rawPrediction")[1])
    scored = written(df.select(_ROW, "host", "path", "evidence").withColumn(
        "p", 1 / (1 + F.exp(-F.col("evidence")))), "quality-evidence")

    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = whole["good"] / whole["n"] if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("parent", F.lit(rate))
    k_host = prior_weight(hosts)
    hosts = hosts.select("host", ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k_path = prior_weight(paths.withColumnRenamed("host_rate", "parent"))
    sites = written(paths, "sites")
    others = (F.col("good") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    out = scored.join(sites, ["host", "path"]).withColumn("path_rate", others)
    log_odds = F.col("evidence") + _logit(F.col("path_rate")) - F.lit(_log_odds(rate))
    score = 1 / (1 + F.exp(-log_odds))
    return out.select(_ROW, "evidence", "host_rate", "path_rate", score.alias("score"), (score >= ACCEPT).alias("accepted"))


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def accepted(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that are accepted, with their columns."""
    return classify(docs, labels, **columns).filter("accepted").select(f"{_ROW}.*")


def op4(spark, sf_dir: str) -> DataFrame:
    """Query: every row of ``documents``, fitted on ``labels``."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select(f"{_ROW}.doc_id", "evidence", "host_rate", "path_rate", "score", "accepted")
