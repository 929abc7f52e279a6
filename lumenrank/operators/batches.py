"""Resumable model batches over a ledger of finished calls.

A model call is named by the digest of its input and the model's version. The ledger is a
table of finished calls in a folder that outlives the job. A run

1. takes each distinct input once, whatever its number of rows,
2. leaves out what the ledger has for this version (an anti-join on digests),
3. calls the model chunk by chunk; a chunk's results are committed together when its job
   ends, so a failure loses the chunk at work and nothing before it,
4. joins the results back to all rows by digest.

Run again after a failure, it calls the model for the unfinished inputs only. An entry that
is there twice (two jobs at once) counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.operators.plan import cut

#: Jobs, and commits, of one run.
CHUNKS = 16


def input_digest(*columns: str):
    """128 bits over the columns' texts; a null differs from an empty text, and the parts' lengths
    are part of it, so that no two inputs read alike."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("null")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


class Ledger:
    """Finished calls of one kind of model (``name``) under ``path``; ``returns`` is the result's type."""

    def __init__(self, spark: SparkSession, path: str, name: str, returns: str):
        self.spark, self.returns = spark, returns
        self.folder = f"{path.rstrip('/')}/{name}"

    def entries(self, version: str) -> DataFrame:
        """``(digest, result)`` of this version; empty before the first commit."""
        schema = f"digest binary, result {self.returns}"
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.folder}/version={version}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return found.dropDuplicates(["digest"])

    def run(self, rows: DataFrame, columns: list[str], fn: Callable[..., list], version: str, out_col: str = "result",
            chunks: int = CHUNKS) -> DataFrame:
        """``rows`` with ``out_col``: ``fn(*lists of the columns)`` per batch of distinct inputs, or
        what the ledger has of it."""
        keyed = rows.withColumn("_digest", input_digest(*columns))
        done = self.entries(version).select(F.col("digest").alias("_digest"))
        todo = cut(keyed.select("_digest", *columns).dropDuplicates(["_digest"]).join(done, "_digest", "left_anti"))

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = list(fn(*(pdf[c].tolist() for c in columns)))
                if len(out) != len(pdf):
                    raise ValueError("the model returned another number of results than it got inputs")
                yield pd.DataFrame({"digest": pdf["_digest"], "result": pd.Series(out, dtype="object", index=pdf.index)})

        place = F.pmod(F.xxhash64("_digest"), F.lit(chunks))
        for c in sorted(r[0] for r in todo.select(place).distinct().collect()):  # at most ``chunks`` numbers
            todo.where(place == c).mapInPandas(call, f"digest binary, result {self.returns}").write.mode("append").parquet(
                f"{self.folder}/version={version}")
        results = self.entries(version).select(F.col("digest").alias("_digest"), F.col("result").alias(out_col))
        return keyed.join(results, "_digest", "left").drop("_digest")


def encoder(ledger: Ledger, fn: Callable[[list[str]], list], version: str):
    """D1 as ``encode(df, text_col, out_col)`` through a ledger of ``array<double>``; null texts are skipped."""
    def encode(df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        rows = (df.drop(out_col) if out_col in df.columns else df).where(F.col(text_col).isNotNull())
        return ledger.run(rows, [text_col], lambda texts: [[float(x) for x in v] for v in fn(texts)], version, out_col)

    return encode


def pair_scorer(ledger: Ledger, fn: Callable[[list, list], list[float]], version: str):
    """D3 as ``pairs -> pairs + pair_score`` through a ledger of ``double``."""
    return lambda pairs: ledger.run(pairs, ["query", "text"], lambda q, t: [float(x) for x in fn(q, t)], version, "pair_score")


def generate(ledger: Ledger, prompts: DataFrame, fn: Callable[[list[str], int], list[str]], max_new_tokens: int,
             version: str) -> DataFrame:
    """``(qid, completion)`` of ``prompts (qid, prompt)`` through a ledger of ``string``. The
    number of new tokens is part of the version."""
    out = ledger.run(prompts, ["prompt"], lambda p: fn(p, max_new_tokens), f"{version}-{max_new_tokens}", "completion")
    return out.select("qid", "completion")
