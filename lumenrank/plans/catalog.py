"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each output is flat (scalars only) so that it can be compared row for row with
its SQL twin in ``sql_catalog.py``. Ranks and counts are ``bigint``; output
doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank import config as C
from lumenrank.functions import text as T
from lumenrank.operators import batches, dense, evaluate, lexical, mining, rank, training
from lumenrank.operators.ids import dense_index, row_ids_parquet
from lumenrank.operators.plan import cut, stored
from lumenrank.plans import compose as P
from lumenrank.session import work_path
from lumenrank.sources import fixtures as fx
from lumenrank.sources import io

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def out_run(run: DataFrame) -> DataFrame:
    return run.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", C.SCORE_DIGITS).alias("score")
    )


def _flagged(flags: DataFrame) -> DataFrame:
    return flags.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id",
                        F.round("score", C.SCORE_DIGITS).alias("score"), F.col("hit").cast("bigint").alias("hit"))


# ---------------------------------------------------------------- shared pieces
def _index(spark, sf) -> lexical.Bm25Index:
    return lexical.build_index(fx.corpus(spark, sf))


def _bm25_run(spark, sf, queries=None) -> DataFrame:
    q = queries if queries is not None else fx.query_set(spark, sf)
    index = lexical.build_index(fx.corpus(spark, sf), with_positions=False, materialize=True)
    return cut(lexical.bm25_search(index, q))  # written: evaluation reads it more than once


def _doc_vectors(spark, sf, tokens: DataFrame | None = None) -> DataFrame:
    if tokens is not None:
        return dense.hash_encode(tokens, tokens_col="tokens")
    return dense.hash_encode(fx.corpus(spark, sf))


def _dense_run(spark, sf, queries=None, tokens: DataFrame | None = None) -> DataFrame:
    q = queries if queries is not None else fx.query_set(spark, sf)
    qv = dense.hash_encode(q.select("qid", "query"), text_col="query")
    return dense.knn_search(qv, _doc_vectors(spark, sf, tokens))


def _fused(spark, sf, q) -> tuple[DataFrame, lexical.Bm25Index]:
    """The fused run and the BM25 index: corpus to both indexes from one token pass."""
    tokens = lexical.token_table(fx.corpus(spark, sf))
    index = lexical.build_index(tokens, with_positions=False, materialize=True)
    dense_run, bm25_run = _dense_run(spark, sf, q, tokens), lexical.bm25_search(index, q)
    return cut(rank.rrf_fuse(dense_run, bm25_run)), index


# ---------------------------------------------------------------- tokens and BM25 tables
@register("tokens")
def q_tokens(spark, sf):
    d = fx.corpus(spark, sf)
    return d.select("doc_id", F.posexplode_outer(T.tokens("text")).alias("pos", "term")).where(F.col("term").isNotNull()).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "term"
    )


@register("postings")
def q_postings(spark, sf):
    p = _index(spark, sf).postings
    return p.select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"),
                    F.array_join("positions", ",").alias("positions"))


@register("doc_stats")
def q_doc_stats(spark, sf):
    return _index(spark, sf).doc_stats.select("doc_id", "dl")


@register("term_stats")
def q_term_stats(spark, sf):
    t = _index(spark, sf).term_stats
    return t.select("term", F.col("df").cast("bigint").alias("df"), F.col("cf").cast("bigint").alias("cf"))


@register("doc_vectors")
def q_doc_vectors(spark, sf):
    v = _index(spark, sf).doc_vectors
    return v.select("doc_id", F.explode("vector").alias("term", "tf")).select(
        "doc_id", "term", F.col("tf").cast("bigint").alias("tf")
    )


@register("bm25_topk")
def q_bm25_topk(spark, sf):
    return out_run(_bm25_run(spark, sf))


# ---------------------------------------------------------------- evaluation
@register("answers_parse")
def q_answers_parse(spark, sf):
    q = fx.query_set(spark, sf).select("qid", T.answers_literal("answers").alias("literal"))
    parsed = q.select("qid", T.parse_answers("literal").alias("answers"))
    return parsed.select("qid", F.posexplode("answers").alias("pos", "answer")).select(
        "qid", F.col("pos").cast("bigint").alias("pos"), "answer"
    )


@register("answer_hits")
def q_answer_hits(spark, sf):
    q = fx.query_set(spark, sf)
    flags = evaluate.hit_flags(_bm25_run(spark, sf, q), q, fx.corpus(spark, sf))
    return _flagged(flags)


@register("hit_at_k")
def q_hit_at_k(spark, sf):
    q = fx.query_set(spark, sf)
    flags = evaluate.hit_flags(_bm25_run(spark, sf, q), q, fx.corpus(spark, sf))
    return evaluate.hit_at_k(flags, q)


@register("hit_mean")
def q_hit_mean(spark, sf):
    q = fx.query_set(spark, sf)
    flags = evaluate.hit_flags(_bm25_run(spark, sf, q), q, fx.corpus(spark, sf))
    m = evaluate.hit_mean(evaluate.hit_at_k(flags, q))
    return m.select("k", F.round("hit_rate", C.SCORE_DIGITS).alias("hit_rate"))


# ---------------------------------------------------------------- dense
@register("dense_text_topk")
def q_dense_text_topk(spark, sf):
    return out_run(_dense_run(spark, sf))


@register("rrf_fusion")
def q_rrf_fusion(spark, sf):
    q = fx.query_set(spark, sf)
    return out_run(_fused(spark, sf, q)[0])


@register("rrf_no_bm25")
def q_rrf_no_bm25(spark, sf):
    return out_run(rank.rrf_fuse(_dense_run(spark, sf), None))


# ---------------------------------------------------------------- pool
@register("pool_build")
def q_pool_build(spark, sf):
    docs = fx.table(spark, sf, "documents").select("text")
    return row_ids_parquet(docs, "id").select("id", "text")


@register("pool_distinct")
def q_pool_distinct(spark, sf):
    return mining.number_corpus(mining.corpus_from_pool(fx.corpus(spark, sf)))


# ---------------------------------------------------------------- vectors
def _components(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("i", "value")).select(
        key, F.col("i").cast("bigint").alias("i"), F.round(F.col("value").cast("double"), C.SCORE_DIGITS).alias("value")
    )


@register("l2_normalise")
def q_l2_normalise(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return _components(e.select("vec_id", dense.l2_normalize("embedding").alias("v")), "vec_id", "v")


@register("mean_pool")
def q_mean_pool(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    m = dense.group_mean_vectors(e, "label")
    return m.select(F.col("label").cast("bigint").alias("label"), F.col("i").cast("bigint").alias("i"),
                    F.round("value", C.SCORE_DIGITS).alias("value"))


@register("mean_pool_rows")
def q_mean_pool_rows(spark, sf):
    """C6 per row: each vector with its next two by id as one multi-vector, pooled and
    brought to unit length, as the encoder path does with several vectors per text."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    shifted = e.select(F.explode(F.array(*[F.struct((F.col("vec_id") - i).alias("vec_id"), F.lit(i).alias("slot"))
                                           for i in range(3)])).alias("a"), "embedding")
    multi = shifted.groupBy("a.vec_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("a.slot", "embedding"))), lambda x: x["embedding"]).alias("m"))
    multi = multi.join(e.select("vec_id"), "vec_id", "left_semi")
    return _components(multi.select("vec_id", dense.l2_normalize(dense.mean_pool("m")).alias("v")), "vec_id", "v")


@register("instructed_query")
def q_instructed_query(spark, sf):
    """The query texts as an encoder with an instruction sees them."""
    q = fx.query_set(spark, sf)
    return q.select("qid", T.format_instruction("query", C.QUERY_INSTRUCTION, C.QUERY_INSTRUCTION_FORMAT).alias("text"))


@register("instructed_examples")
def q_instructed_examples(spark, sf):
    """The same with task examples in front."""
    text = T.format_instruction("query", C.QUERY_INSTRUCTION, C.QUERY_INSTRUCTION_FORMAT)
    return fx.query_set(spark, sf).select("qid", T.format_instruction(text, C.TASK_EXAMPLES, C.TASK_EXAMPLES_FORMAT).alias("text"))


@register("offline_eval")
def q_offline_eval(spark, sf):
    """A saved run, the query file and the pool file, evaluated offline.
    A query without any match counts as 0."""
    q = fx.query_set(spark, sf)
    order = dense_index(q.select("qid"), ["qid"], "n")  # the place of a query in the file is its id there
    paths = {n: work_path(spark, f"offline-{n}") for n in ("queries", "pool", "run", "hits")}
    io.write_query_tsv(q.orderBy("qid").select("query", T.answers_literal("answers")), paths["queries"])
    io.write_jsonl(fx.corpus(spark, sf).select(F.col("doc_id").alias("id"), "text"), paths["pool"])
    run = _bm25_run(spark, sf, q).join(order, "qid")
    io.write_run(run.select(F.col("n").cast("long").alias("qid"), "rank", "doc_id", "score"), paths["run"])
    means = P.evaluate_saved(spark, paths["run"], paths["queries"], paths["pool"], paths["hits"])
    return means.select("k", F.round("hit_rate", C.SCORE_DIGITS).alias("hit_rate"))


def _embeddings(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@register("knn_exact")
def q_knn_exact(spark, sf):
    e = _embeddings(spark, sf)
    return out_run(dense.knn_search(e.withColumnRenamed("doc_id", "qid"), e))


@register("knn_single")
def q_knn_single(spark, sf):
    """R2: one query, the centroid of every vector in the table."""
    e = _embeddings(spark, sf)
    comps = dense.group_mean_vectors(e.withColumn("g", F.lit(0)), "g")
    centroid = comps.groupBy("g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("embedding")
    ).select(F.lit(0).cast("bigint").alias("qid"), "embedding")
    return out_run(dense.knn_search(centroid, e))


@register("encode_hash")
def q_encode_hash(spark, sf):
    return _vector_digests(_doc_vectors(spark, sf))


def _vector_digests(vectors: DataFrame) -> DataFrame:
    """One row a document: the components that are not 0, in millionths and in order, as one digest."""
    parts = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), F.round(x * 1e6).cast("bigint").alias("v"))),
                     lambda p: p["v"] != 0)
    listed = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["i"].cast("string"), p["v"].cast("string"))), ",")
    return vectors.select("doc_id", F.size(parts).cast("bigint").alias("n"), F.md5(listed).alias("digest"))


# ---------------------------------------------------------------- rerank

@register("pair_score")
def q_pair_score(spark, sf):
    q = fx.query_set(spark, sf)
    run, index = _fused(spark, sf, q)
    pairs = rank.score_pairs(run, q, fx.corpus(spark, sf), rank.CoverageScorer(index))
    return pairs.select("qid", "doc_id", F.round("pair_score", C.SCORE_DIGITS).alias("score"))


@register("pointwise_rerank")
def q_pointwise_rerank(spark, sf):
    q = fx.query_set(spark, sf)
    run, index = _fused(spark, sf, q)
    return out_run(rank.pointwise_rerank(run, q, fx.corpus(spark, sf), rank.CoverageScorer(index)))


@register("listwise_prompt")
def q_listwise_prompt(spark, sf):
    q = fx.query_set(spark, sf)
    return rank.listwise_prompts(_fused(spark, sf, q)[0], q, fx.corpus(spark, sf))


@register("parse_indices")
def q_parse_indices(spark, sf):
    comp = fx.listwise_completions(fx.query_set(spark, sf))
    return comp.select("qid", F.posexplode(T.extract_indices("completion", C.LISTWISE_TOP_N)).alias("pick", "rank")) \
        .select("qid", F.col("pick").cast("bigint").alias("pick"), F.col("rank").cast("bigint").alias("rank"))


@register("listwise_rerank")
def q_listwise_rerank(spark, sf):
    q = fx.query_set(spark, sf)
    return out_run(rank.listwise_rerank(_fused(spark, sf, q)[0], fx.listwise_completions(q)))


# ---------------------------------------------------------------- HyDE
@register("hyde_prompt")
def q_hyde_prompt(spark, sf):
    return fx.query_set(spark, sf).select("qid", T.hyde_prompt("query").alias("prompt"))


@register("hyde_query")
def q_hyde_query(spark, sf):
    q = fx.query_set(spark, sf)
    inp = P.Inputs(queries=q, docs=fx.corpus(spark, sf), hyde_completions=fx.hyde_completions(q))
    return P.search_queries(inp, {"hyde"}).select("qid", "search")


# ---------------------------------------------------------------- alignment
@register("run_alignment")
def q_run_alignment(spark, sf):
    q = fx.query_set(spark, sf)
    return evaluate.alignment(_bm25_run(spark, sf, q), q)


# ---------------------------------------------------------------- training rows and mining
def _explode_rows(rows: DataFrame) -> DataFrame:
    parts = [
        rows.select("qid", F.lit("query").alias("kind"), F.lit(0).cast("bigint").alias("pos"), F.col("query").alias("text")),
        rows.select("qid", F.lit("pos").alias("kind"), F.posexplode("pos").alias("pos", "text")),
        rows.select("qid", F.lit("neg").alias("kind"), F.posexplode("neg").alias("pos", "text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("qid", "kind", F.col("pos").cast("bigint").alias("pos"), "text"))
    return out


def _training(spark, sf, strategy="both") -> DataFrame:
    return training.training_rows(fx.training_source(spark, sf), strategy)


@register("training_rows_both")
def q_training_rows_both(spark, sf):
    return _explode_rows(_training(spark, sf, "both"))


@register("training_rows_only_pos")
def q_training_rows_only_pos(spark, sf):
    return _explode_rows(_training(spark, sf, "only_pos"))


@register("mining_union_corpus")
def q_mining_union_corpus(spark, sf):
    return mining.number_corpus(mining.corpus_from_rows(_training(spark, sf)))


def _mine(spark, sf, window: str = C.MINING_RANGE_SCRIPT) -> mining.MiningResult:
    rows = stored(_training(spark, sf), "training-rows")
    corpus = mining.number_corpus(mining.corpus_from_pool(fx.corpus(spark, sf)))
    lo, hi = mining.parse_range(window)
    return mining.mine(rows, corpus, lo=lo, hi=hi, n=C.NEGATIVE_NUMBER)


@register("mine_window")
def q_mine_window(spark, sf):
    w = _mine(spark, sf).window
    return w.select("qid", F.col("rank").cast("bigint").alias("rank"), "idx", F.round("score", C.SCORE_DIGITS).alias("score"))


@register("mine_filtered")
def q_mine_filtered(spark, sf):
    f = _mine(spark, sf).filtered
    return f.select("qid", F.col("rank").cast("bigint").alias("rank"), "idx")


@register("mine_sampled")
def q_mine_sampled(spark, sf):
    return _mine(spark, sf).sampled.select("qid", "draw", "idx")


@register("mine_backfilled")
def q_mine_backfilled(spark, sf):
    """N7 + K4 + S6: mined rows written as JSON lines and read back."""
    mined = _mine(spark, sf)
    path = work_path(spark, "mined")
    io.write_jsonl((p.select("qid", "query", "pos", "neg", "short") for p in mined.parts(keep_run=False)), path, "gzip")
    back = spark.read.schema("qid long, query string, pos array<string>, neg array<string>, short int").json(path)
    return back.select("qid", F.posexplode("neg").alias("slot", "text"), F.col("short").cast("bigint").alias("short")) \
        .select("qid", F.col("slot").cast("bigint").alias("slot"), "text", "short")


@register("mine_backfill_narrow")
def q_mine_backfill_narrow(spark, sf):
    """N7 on every row: a ``2-12`` window leaves at most 10 mined negatives, so each
    training row is topped up from the corpus (distinct draws, exclusions)."""
    rows = _mine(spark, sf, "2-12").rows
    return rows.select("qid", F.posexplode("neg").alias("slot", "text"), F.col("short").cast("bigint").alias("short")) \
        .select("qid", F.col("slot").cast("bigint").alias("slot"), "text", "short")


# ---------------------------------------------------------------- sources and sinks
@register("roundtrip_tsv")
def q_roundtrip_tsv(spark, sf):
    """S1 + C1 + C2 via K1-style writing: a header TSV of 4 files, or as many as its text fills,
    with an extra column, read back."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "text")
    path, files = work_path(spark, "corpus-tsv"), io.file_count(docs, 4)
    io.write_corpus_tsv(docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select("source", "text"), path)
    return io.read_corpus_tsv(spark, path)


@register("roundtrip_jsonl")
def q_roundtrip_jsonl(spark, sf):
    """K1 + S2: the pool as JSON lines, read back with its schema."""
    path = work_path(spark, "pool-jsonl")
    io.write_jsonl(fx.corpus(spark, sf).select(F.col("doc_id").alias("id"), "text"), path)
    return io.read_pool_jsonl(spark, path)


@register("roundtrip_queries")
def q_roundtrip_queries(spark, sf):
    """S4 + C3: the query set as a headerless TSV with list literals, read back and parsed."""
    q = fx.query_set(spark, sf)
    path = work_path(spark, "queries-tsv")
    io.write_query_tsv(q.orderBy("qid").select("query", T.answers_literal("answers")), path)
    back = io.read_query_tsv(spark, path)
    return back.select("qid", "query", F.array_join("answers", "|").alias("answers"))


@register("roundtrip_vectors")
def q_roundtrip_vectors(spark, sf):
    """K5 + S8: the dense index (hashing vectors of the pool) written and opened again."""
    path = work_path(spark, "vectors")
    io.write_vectors(_doc_vectors(spark, sf).select(F.col("doc_id").alias("id"), "embedding"), path)
    back = io.read_vectors(spark, path)
    return _vector_digests(back.withColumnRenamed("id", "doc_id"))


@register("pool_texts")
def q_pool_texts(spark, sf):
    """S3: the pool file's texts alone."""
    path = work_path(spark, "pool-texts")
    io.write_jsonl(fx.corpus(spark, sf).select(F.col("doc_id").alias("id"), "text"), path)
    return io.read_pool_texts(spark, path)


@register("training_file")
def q_training_file(spark, sf):
    """S5 + C1 + C4: the nested source as files of one JSON array each, read back and made rows."""
    files = io.file_count(fx.table(spark, sf, "conversations").select("text"), 4)
    source = fx.training_source(spark, sf).repartitionByRange(files, "qid")
    record = F.struct("qid", "question", "positive_ctxs", "hard_negative_ctxs")
    arrays = source.groupBy(F.spark_partition_id().alias("p")).agg(F.array_sort(F.collect_list(record)).alias("a"))
    body = F.transform("a", lambda r: F.to_json(F.struct(r["question"].alias("question"), r["positive_ctxs"].alias(
        "positive_ctxs"), r["hard_negative_ctxs"].alias("hard_negative_ctxs")), {"ignoreNullFields": "false"}))
    path = work_path(spark, "training-source")
    arrays = arrays.select("p", F.concat(F.lit("["), F.array_join(body, ","), F.lit("]")).alias("value"))
    arrays.repartitionByRange(files, "p").select("value").write.text(path)  # one array a file, files in order
    return _explode_rows(training.training_rows(io.read_training_source(spark, path), "both"))


@register("bm25_saved")
def q_bm25_saved(spark, sf):
    """K6 + S9: the BM25 index built from one token table, written, opened again and searched."""
    index = lexical.build_index(lexical.token_table(fx.corpus(spark, sf)), with_positions=False, materialize=True)
    path = work_path(spark, "bm25-index")
    io.write_bm25_index(index, path)
    return out_run(lexical.bm25_search(io.read_bm25_index(spark, path), fx.query_set(spark, sf)))


@register("run_evaluated_later")
def q_run_evaluated_later(spark, sf):
    """V8 + K2 + S7: the job without evaluation, then hit@k of the run it saved."""
    q, docs = fx.query_set(spark, sf), fx.corpus(spark, sf)
    path, _ = P.run_job(P.Inputs(queries=q, docs=docs), set(), work_path(spark, "job"), skip_eval=True)
    per_q = evaluate.hit_at_k(evaluate.hit_flags(io.read_run(spark, f"{path}/run"), q, docs), q)
    return evaluate.hit_mean(per_q).select("k", F.round("hit_rate", C.SCORE_DIGITS).alias("hit_rate"))


def _mined_files(spark, sf, with_pool: bool) -> DataFrame:
    """S6 + K4: training JSON lines with a key of their own in, mined lines out, read back."""
    paths = {n: work_path(spark, f"mine-{n}") for n in ("rows", "pool", "out")}
    rows = _training(spark, sf).orderBy("qid").select("query", "pos", "neg", F.col("qid").alias("origin"))
    io.write_jsonl(rows, paths["rows"], "gzip")
    if with_pool:
        io.write_jsonl(fx.corpus(spark, sf).select(F.col("doc_id").alias("id"), "text"), paths["pool"], "gzip")
    P.mine_files(spark, paths["rows"], paths["out"], paths["pool"] if with_pool else None, window=C.MINING_RANGE_SCRIPT,
                 compression="gzip")
    back = io.read_training_rows(spark, paths["out"])
    return back.select("origin", F.posexplode("neg").alias("slot", "text")).select(
        "origin", F.col("slot").cast("bigint").alias("slot"), "text")


@register("mine_files_pool")
def q_mine_files_pool(spark, sf):
    return _mined_files(spark, sf, True)


@register("mine_files_own")
def q_mine_files_own(spark, sf):
    return _mined_files(spark, sf, False)


@register("roundtrip_run")
def q_roundtrip_run(spark, sf):
    """K2 + S7: a run written as Parquet under its method tag and read back."""
    path = io.run_path(work_path(spark, "runs"), set())
    io.write_run(_bm25_run(spark, sf), path)
    return out_run(io.read_run(spark, path))


@register("hit_files")
def q_hit_files(spark, sf):
    """K3: one TSV per k with ``id, hit``; read back with k from the folder name."""
    q = fx.query_set(spark, sf)
    per_q = evaluate.hit_at_k(evaluate.hit_flags(_bm25_run(spark, sf, q), q, fx.corpus(spark, sf)), q)
    path = work_path(spark, "hits")
    io.write_hits(per_q, path)
    back = spark.read.schema("id long, hit long, k long").options(sep="\t", header="true").csv(path)
    return back.select("k", "id", "hit")


@register("hit_file_ordered")
def q_hit_file_ordered(spark, sf):
    """K3: ``hit@{k}.txt``, one ordered file per k, read back with its line numbers."""
    q = fx.query_set(spark, sf)
    per_q = evaluate.hit_at_k(evaluate.hit_flags(_bm25_run(spark, sf, q), q, fx.corpus(spark, sf)), q)
    path = work_path(spark, "hit-files")
    io.write_hit_files(per_q, path)
    files = [io.read_hit_file(spark, f"{path}/hit@{k}.txt").select(F.lit(k).cast("bigint").alias("k"), "line", "id", "hit") for k in C.HIT_KS]
    return reduce(DataFrame.unionByName, files)


# ---------------------------------------------------------------- composed retrieval job
def _composed(spark, sf, methods: set[str], rerank_on: bool) -> DataFrame:
    q = fx.query_set(spark, sf)
    docs = fx.corpus(spark, sf)
    tokens = lexical.token_table(docs) if "mixed" in methods else None
    index = lexical.build_index(tokens, with_positions=False, materialize=True) if "mixed" in methods else None
    inp = P.Inputs(
        queries=q, docs=docs, bm25=index,
        doc_vectors=_doc_vectors(spark, sf, tokens),
        hyde_completions=fx.hyde_completions(q),
        listwise_completions=fx.listwise_completions(q),
        reranker=rank.CoverageScorer(index) if rerank_on else None,
    )
    run = P.retrieve(inp, methods)
    flags, _, _ = P.evaluate_run(run, inp)
    return _flagged(flags)


@register("composed_dense")
def q_composed_dense(spark, sf):
    return _composed(spark, sf, set(), False)


@register("composed_mixed")
def q_composed_mixed(spark, sf):
    return _composed(spark, sf, P.parse_methods("mixed"), False)


@register("composed_full")
def q_composed_full(spark, sf):
    return _composed(spark, sf, P.parse_methods("mixed,hyde,listwise_rerank"), True)


def _half(prompts: list[str], _n: int) -> list[str]:
    """A stand-in model: the first half of a question's words; second and first of any list."""
    start, end = len(C.HYDE_PROMPT_PREFIX), -len(C.HYDE_PROMPT_SUFFIX)
    out = []
    for p in prompts:
        words = p[start:end].split(" ")
        out.append("2 1" if p.endswith(C.LISTWISE_PROMPT_SUFFIX) else " ".join(words[:(len(words) + 1) // 2]))
    return out


@register("composed_generated")
def q_composed_generated(spark, sf):
    """D4 inside the job: a generator makes the HyDE texts and the listwise answers."""
    q, docs = fx.query_set(spark, sf), fx.corpus(spark, sf)
    run = P.retrieve(P.Inputs(queries=q, docs=docs, generator=_half), P.parse_methods("hyde,listwise_rerank"))
    return out_run(run)


@register("generated_resumed")
def q_generated_resumed(spark, sf):
    """D4 through a ledger: HyDE texts of the queries that came first (by a hash of the id), then
    of all of them, for which the model is called for the others only."""
    q = fx.query_set(spark, sf)
    prompts = q.select("qid", T.hyde_prompt("query").alias("prompt"))
    ledger = batches.Ledger(spark, work_path(spark, "calls"), "hyde", "string")
    first = prompts.where(F.pmod(F.xxhash64("qid"), F.lit(2)) == 0)
    batches.generate(ledger, first, _half, C.HYDE_MAX_NEW_TOKENS, "half")
    return batches.generate(ledger, prompts, _half, C.HYDE_MAX_NEW_TOKENS, "half")


@register("stream_bm25_topk")
def q_stream_bm25_topk(spark, sf):
    """R4 over the benchmark file as a stream source: each micro-batch of query
    rows is searched against the BM25 index built once; runs land in a sink."""
    from lumenrank.streaming import query_stream

    index = lexical.build_index(fx.corpus(spark, sf), with_positions=False, materialize=True)
    sink, ckpt = work_path(spark, "stream-sink"), work_path(spark, "stream-ckpt")
    src = f"{sf.rstrip('/')}/[b]enchmark.parquet"  # a glob: the file source watches a folder

    def retrieve(batch: DataFrame) -> DataFrame:
        q = batch.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
        return lexical.bm25_search(index, q)

    handle = query_stream.start(spark, src, retrieve, sink, ckpt, schema="item_id long, text string")
    handle.awaitTermination()
    return out_run(query_stream.read_sink(spark, sink))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
