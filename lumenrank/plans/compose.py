"""The retrieval-and-evaluation job composed from the operators.

encode -> dense top-k -> (BM25 + RRF) -> (pointwise) -> (listwise) -> evaluate.
Retrieval uses the HyDE text when asked; both rerankers use the raw query.
Each finished run is written to the shared checkpoint folder before the next
step reads it, so a lost executor never re-runs the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank import config as C
from lumenrank.functions.text import hyde_prompt, hyde_query
from lumenrank.operators import dense, evaluate, lexical, mining, rank
from lumenrank.operators.generate import Generator, generate
from lumenrank.operators.plan import bounded_broadcast, cut, release_checked, stored

def parse_methods(raw: str | None) -> set[str]:
    """Comma list to a set; blanks dropped; unknown names are kept but do nothing."""
    return {m.strip() for m in (raw or "").split(",") if m.strip()}


def parse_k_list(raw: str | None) -> list[int]:
    """Comma list of ints; blanks dropped; default 1, 10, 100."""
    if raw is None:
        return list(C.HIT_KS)
    return [int(x.strip()) for x in raw.split(",") if x.strip()]


@dataclass
class Inputs:
    queries: DataFrame                      # (qid, query, answers)
    docs: DataFrame                         # (doc_id, text)
    doc_vectors: DataFrame | None = None    # (doc_id, embedding); encoded from docs when None
    bm25: lexical.Bm25Index | None = None   # None: "mixed" falls back to dense only
    hyde_completions: DataFrame | None = None      # (qid, completion)
    listwise_completions: DataFrame | None = None  # (qid, completion)
    reranker: Callable[[DataFrame], DataFrame] | None = None  # pairs -> pairs + pair_score
    generator: Generator | None = None      # makes the completions that are not given


def search_queries(inp: Inputs, methods: set[str]) -> DataFrame:
    """``(qid, query, search)``: the HyDE text where asked and available, else the raw query."""
    q = inp.queries.select("qid", "query")
    completions = inp.hyde_completions
    if completions is None and inp.generator is not None:
        prompts = q.select("qid", hyde_prompt("query").alias("prompt"))
        completions = generate(prompts, inp.generator, C.HYDE_MAX_NEW_TOKENS)
    if "hyde" in methods and completions is not None:
        comp = bounded_broadcast(completions.select("qid", "completion"))
        return q.join(comp, "qid", "left").select("qid", "query", hyde_query("query", "completion").alias("search"))
    return q.withColumn("search", F.col("query"))


class MissingInputError(ValueError):
    pass


def retrieve(inp: Inputs, methods: set[str], depth: int = C.DEPTH, encode=dense.hash_encode,
             missing_ok: bool = False) -> DataFrame:
    """The run for one method set.

    A method whose input is absent (no BM25 index for ``mixed``, neither completions
    nor a generator for ``hyde`` / ``listwise_rerank``) is an error; with
    ``missing_ok=True`` the job does without that step.
    """
    if not missing_ok:
        needs = {"mixed": inp.bm25, "hyde": inp.generator if inp.hyde_completions is None else inp.hyde_completions,
                 "listwise_rerank": inp.generator if inp.listwise_completions is None else inp.listwise_completions}
        absent = sorted(m for m, v in needs.items() if m in methods and v is None)
        if absent:
            raise MissingInputError(f"no input for method(s): {', '.join(absent)}")
    sq = cut(search_queries(inp, methods))
    vecs = inp.doc_vectors
    if vecs is None:
        vecs = encode(inp.docs.select("doc_id", "text"))
    qv = encode(sq.select("qid", "search"), text_col="search")
    run = dense.knn_search(qv, vecs, k=depth)                            # R1 / R6
    if "mixed" in methods and inp.bm25 is not None:
        run = cut(rank.rrf_fuse(run, lexical.bm25_search(inp.bm25, sq, k=depth, text_col="search")))   # R5
    else:
        run = cut(run)
    if inp.reranker is not None:
        run = cut(rank.pointwise_rerank(run, inp.queries, inp.docs, inp.reranker))   # R7, raw query
    if "listwise_rerank" in methods:
        completions = inp.listwise_completions
        if completions is None and inp.generator is not None:               # C9 / D4
            completions = generate(rank.listwise_prompts(run, inp.queries, inp.docs), inp.generator)
        run = cut(rank.listwise_rerank(run, completions))                   # R8
    return run


def evaluate_run(run: DataFrame, inp: Inputs, ks=C.HIT_KS):
    """V1-V3: ``(flags, per_query, means)``."""
    evaluate.check_alignment(run, inp.queries, allow_empty=True)          # V4: a query may match nothing
    flags = evaluate.hit_flags(run, inp.queries, inp.docs)
    per_q = evaluate.hit_at_k(flags, inp.queries, ks)
    return flags, per_q, evaluate.hit_mean(per_q, ks)


def run_job(inp: Inputs, methods: set[str], out_dir: str, skip_eval: bool = False,
            ks=C.HIT_KS, depth: int = C.DEPTH, encode=dense.hash_encode, missing_ok: bool = False):
    """K2 / K3 / V8: retrieve, save the run under its method tag, and unless
    ``skip_eval`` write one hit table per k, as folders and as ``hit@{k}.txt``. Returns ``(run_path, means or None)``."""
    from lumenrank.sources import io

    run = retrieve(inp, methods, depth=depth, encode=encode, missing_ok=missing_ok)
    path = io.run_path(out_dir, methods)
    io.write_run(run, f"{path}/run")
    if skip_eval:
        release_checked()
        return path, None
    _, per_q, means = evaluate_run(run, inp, ks)
    per_q = cut(per_q)
    io.write_hits(per_q, f"{path}/hits")
    io.write_hit_files(per_q, path)
    release_checked()
    return path, evaluate.hit_mean(per_q, ks)


def evaluate_saved(spark, run_path: str, queries_path: str, pool_path: str, out_dir: str, ks=C.HIT_KS) -> DataFrame:
    """Offline evaluation: a saved run, the query file with its answers and the pool, to
    one hit table per k under ``out_dir``. A query without rows counts as 0; a run of queries
    that are not in the file is an error."""
    from lumenrank.sources import io

    queries = io.read_query_tsv(spark, queries_path)
    docs = io.read_pool_jsonl(spark, pool_path).withColumnRenamed("id", "doc_id")
    run = io.read_run(spark, run_path)
    evaluate.check_alignment(run, queries, allow_empty=True)
    per_q = cut(evaluate.hit_at_k(evaluate.hit_flags(run, queries, docs), queries, ks))
    io.write_hits(per_q, out_dir)
    io.write_hit_files(per_q, out_dir)
    release_checked()
    return evaluate.hit_mean(per_q, ks)


def mine_files(spark, training_path: str, out_path: str, pool_path: str | None = None, window: str = C.MINING_RANGE_DEFAULT,
               n: int = C.NEGATIVE_NUMBER, encode=dense.hash_encode, compression: str = "none") -> DataFrame:
    """Hard-negative mining file to file: training JSON lines in, the same rows with mined
    ``neg`` out, every other key kept. Without a pool the corpus is the rows' own texts. The
    rows are written part by part; what is returned looks their texts up again."""
    from lumenrank.sources import io

    rows = stored(io.read_training_rows(spark, training_path), "training-rows")
    texts = (mining.corpus_from_pool(io.read_pool_jsonl(spark, pool_path)) if pool_path
             else mining.corpus_from_rows(rows))
    lo, hi = mining.parse_range(window)
    mined = mining.mine(rows, mining.number_corpus(texts), lo=lo, hi=hi, n=n, encode=encode)
    io.write_jsonl((p.drop("qid", "short") for p in mined.parts(keep_run=False)), out_path, compression)
    release_checked()
    return mined.assembled()
