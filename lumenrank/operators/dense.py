"""Dense vectors: normalise, pool, encode (D1 / D2) and exact top-k search.

Exact search is a tile join. Query vectors and corpus vectors are packed into blocks of
bounded size, query blocks are dealt to query groups and corpus blocks to corpus groups,
and each pair of groups is one tile: a cogroup that computes ``Q @ D^T`` with numpy and
keeps an exact top-k per query (ties resolved by doc_id). A second exchange on the query
merges the tiles' lists. Whatever the number of queries, no vector passes through the
driver, the corpus is scanned and encoded once, and no query-corpus pair ever becomes a row.

For as many queries as there are documents the tile join writes the corpus once per query group.
``knn_run`` stores the corpus' blocks once instead; each group of queries reads them past itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lumenrank import config as C
from lumenrank.functions.hashing import arrow_encoder, signed_codes
from lumenrank.functions.text import format_instruction, tokens
from lumenrank.operators.lexical import rank_top_k
from lumenrank.operators.plan import bucket_count, cut, forget, stored

SCORE_CELLS = 2_000_000
BLOCK_BYTES = 4 * 1024 * 1024  # vectors of one packed block
CORPUS_GROUP_BYTES = 64 * 1024 * 1024
QUERY_STEP = 512  # queries scored at once; with SCORE_CELLS it bounds a score matrix
MERGE_FACTOR = 4  # lists' worth of candidates that are gathered before they are sorted
MERGE_ROW_BYTES = 128  # what a row of a tile's result costs, in shuffled bytes of vectors
GROUP_QUERIES = 256  # a streamed search has smaller query groups than this only where memory asks for it


def l2_normalize(vec: Column | str) -> Column:
    """Unit length as ``array<double>``; a zero vector stays zero."""
    v = F.col(vec) if isinstance(vec, str) else vec
    vd = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vd, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(vd, lambda x: x / norm)).otherwise(vd)


def mean_pool(multi: Column | str) -> Column:
    """C6 / V6 for one row: a multi-vector ``array<array<float>>`` (m x dim) to
    its component mean (m is bounded by the row itself)."""
    mv = F.col(multi) if isinstance(multi, str) else multi
    first = F.element_at(mv, 1)
    return F.transform(
        first,
        lambda _x, i: F.aggregate(mv, F.lit(0.0), lambda acc, row: acc + F.element_at(row, i + 1).cast("double"))
        / F.size(mv),
    )


def group_mean_vectors(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """C6 / V6 over groups of any size: per-component mean by ``posexplode`` + ``avg``.

    Partial aggregation runs before the shuffle, so a group holding a third of
    all rows still moves only one partial row per component per task.
    Returns ``(key, i, value)`` with 0-based component ``i``.
    """
    return (
        df.select(key, F.posexplode(vec).alias("i", "x"))
        .groupBy(key, "i")
        .agg(F.avg(F.col("x").cast("double")).alias("value"))
    )


def hash_encode(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "embedding",
    dim: int = C.HASH_DIM,
    instruction: str | None = None,
    instruction_format: str = "{}{}",
    tokens_col: str | None = None,
) -> DataFrame:
    """D1 / D2 default encoder: hashing vectors, L2-normalised (see functions.hashing).
    Rows with a null text are skipped. With ``tokens_col`` the text is tokenised already
    (``lexical.token_table``) and the tokens are left out of the result.

    Tokens and md5 codes are JVM expressions; the scatter-add into dense vectors
    runs on whole Arrow batches in ``mapInArrow`` (one pass, no per-row objects).
    """
    text = format_instruction(text_col, instruction, instruction_format)
    base = (df.drop(out_col) if out_col in df.columns else df).where(F.col(text_col).isNotNull())
    found = F.col(tokens_col) if tokens_col else tokens(text)
    with_codes = base.withColumn("_codes", signed_codes(found, dim))
    if tokens_col:
        base, with_codes = base.drop(tokens_col), with_codes.drop(tokens_col)
    schema = StructType(base.schema.fields + [StructField(out_col, ArrayType(DoubleType()), True)])
    return with_codes.mapInArrow(arrow_encoder(dim, "_codes", out_col), schema)


def _as_matrix(found, dim: int, rows: int) -> np.ndarray:
    """A model's result as (rows, dim): also of a dict that holds it as ``dense_vecs`` or
    ``embeddings``, and of several vectors per text, which are averaged (C6)."""
    if isinstance(found, dict):
        key = next((k for k in ("dense_vecs", "embeddings") if k in found), None)
        if key is None:
            raise ValueError(f"the model returned a dict without vectors: {sorted(found)}")
        found = found[key]
    mat = np.asarray(found, dtype=np.float64)
    return (mat.mean(axis=1) if mat.ndim == 3 else mat).reshape(rows, dim)


def batch_encoder(fn, dim: int, batch_size: int | None = None):
    """Wrap a model callable ``list[str] -> array (n, dim)`` as a pandas UDF.

    The callable is created once per Python worker and fed whole Arrow batches, or at most
    ``batch_size`` texts at a time.
    """

    @F.pandas_udf("array<double>")
    def _enc(texts: pd.Series) -> pd.Series:
        given, step = texts.fillna("").tolist(), batch_size or max(1, len(texts))
        parts = [given[i:i + step] for i in range(0, len(given), step)]
        return pd.Series([v for p in parts for v in _as_matrix(fn(p), dim, len(p))], dtype="object")

    # The planner may not compute it again, for a filter on its result say: calls are dear.
    return _enc.asNondeterministic()


def model_encoder(fn, dim: int, instruction: str | None = None, instruction_format: str = "{}{}",
                  normalize: bool = True, examples: str | None = None, examples_format: str = "{}{}",
                  batch_size: int | None = None):
    """A model callable as ``encode(df, text_col, out_col)``, as ``mine`` and ``retrieve``
    take it: null texts skipped, instruction put before the text and task examples before
    both, several vectors per text averaged, unit length (C5, C6, C15)."""
    vectors = batch_encoder(fn, dim, batch_size)

    def encode(df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        rows = (df.drop(out_col) if out_col in df.columns else df).where(F.col(text_col).isNotNull())
        text = format_instruction(format_instruction(text_col, instruction, instruction_format), examples, examples_format)
        rows = rows.withColumn(out_col, vectors(text))
        return rows.withColumn(out_col, l2_normalize(out_col)) if normalize else rows

    return encode


class _RunningTopK:
    """Exact top-k per query over all blocks of one tile, by (rounded score desc, id asc).

    A query's k-th score so far bounds what may still enter its list, so most of a block is
    only compared with that bound; the cells that pass are rounded and kept flat, and sorted
    when ``MERGE_FACTOR`` lists' worth of them has gathered. NaN ranks last.
    """

    def __init__(self, q: int, k: int):
        self.q, self.k = q, k
        self.low = np.full(q, -np.inf)  # the k-th rounded score, once there are k
        self.last = np.full(q, np.iinfo(np.int64).max)  # the id that holds it
        self.kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]  # (query, score, id)

    def add(self, ids: np.ndarray, raw: np.ndarray) -> None:
        """``raw``: (q, m) scores of the documents ``ids``."""
        hit, enough = ~(raw < _below(self.low)[:, None]), MERGE_FACTOR * self.k * self.q
        if raw.shape[1] > self.k and np.count_nonzero(hit) > enough // 2:
            kth = -np.partition(-raw, self.k - 1, axis=1)[:, self.k - 1]  # the block alone has k as good
            hit &= ~(raw < _below(kth)[:, None])
        at, col = np.nonzero(hit)
        self._take(at, ids[col], raw[at, col], enough)

    def add_products(self, ids: np.ndarray, left: np.ndarray, right: np.ndarray, left32: np.ndarray, right32: np.ndarray) -> None:
        """``add`` of ``left @ right.T``. Once every query has k, single-precision products tell which
        cells can pass, by more than their largest error, and only these are computed in full."""
        if np.isfinite(self.low).all():
            norms = np.sqrt(np.einsum("ij,ij->i", left, left)), np.sqrt(np.einsum("ij,ij->i", right, right).max())
            slack = (left.shape[1] + 8) * 2.0 ** -23 * (norms[0] * norms[1] + np.abs(self.low) + 1e-30)
            at, col = np.nonzero(~(left32 @ right32.T < (_below(self.low) - slack).astype(np.float32)[:, None]))
            if len(at) * 32 <= len(left) * len(right):
                self._take(at, ids[col], np.einsum("ij,ij->i", left[at], right[col]), MERGE_FACTOR * self.k * self.q)
                return
        self.add(ids, left @ right.T)

    def _take(self, at: np.ndarray, d: np.ndarray, raw: np.ndarray, enough: int) -> None:
        r = np.round(raw, C.SCORE_DIGITS)
        fits = ~(r < self.low[at]) & ((r != self.low[at]) | (d < self.last[at]))
        self.kept.append((at[fits], r[fits], d[fits]))
        if sum(len(x[0]) for x in self.kept) > enough:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the lists so far, flat."""
        at, r, d = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((d, -r, at))
        first = np.searchsorted(at[order], np.arange(self.q + 1))
        order = order[np.arange(len(order)) - first[at[order]] < self.k]
        at, r, d = at[order], r[order], d[order]
        full = np.nonzero(np.diff(first) >= self.k)[0]
        kth = np.searchsorted(at, full) + self.k - 1
        self.low[full], self.last[full] = r[kth], d[kth]
        self.kept = [(at, r, d)]
        return self.kept[0]


def _below(score: np.ndarray) -> np.ndarray:
    """A bound under every raw score that rounds to ``score`` or more."""
    with np.errstate(invalid="ignore"):
        return score - 10.0 ** -C.SCORE_DIGITS - 1e-12 * np.abs(score)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list<float|double> Arrow column of equal-length vectors to an (n, dim) float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, dim))
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"vectors of length {sorted(set(lengths[lengths != dim].tolist()))[:5]}, the queries have {dim}")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, dim)


def _pack(dim: int, most: int | None = None):
    """``mapInArrow`` body: (key, v) rows to numbered blocks of at most ``BLOCK_BYTES`` (and
    ``most`` rows). Vectors keep their width."""

    def run(batches):
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = max(1, min(BLOCK_BYTES // (8 * dim + 8), most or batch.num_rows))
            for b in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                wide = pa.types.is_float64(b.column(1).type.value_type)
                mat = _matrix(b.column(1), dim).astype(np.float64 if wide else np.float32, copy=False)
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "no": pa.array([part + no], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                    "wide": pa.array([wide]), "vectors": pa.array([mat.tobytes()], pa.binary())})
                no += 1

    return run


def _unpack(blocks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the (n, dim) float64 matrix of packed blocks."""
    n = sum(len(x.as_buffer()) for x in blocks["ids"]) // 8
    ids, mat, at = np.empty(n, np.int64), np.empty((n, dim)), 0
    for i, wide, v in zip(*(blocks[c] for c in ("ids", "wide", "vectors"))):
        found = np.frombuffer(i.as_buffer(), np.int64)
        ids[at:at + len(found)] = found
        mat[at:at + len(found)] = np.frombuffer(v.as_buffer(), np.float64 if wide.as_py() else np.float32).reshape(-1, dim)
        at += len(found)
    return ids, mat


def _pack_small(dim: int, most: int | None = None):
    """``_pack`` with the blocks' bytes compressed."""

    def run(batches):
        for b in _pack(dim, most)(batches):
            small = {c: [pa.compress(x.as_buffer(), codec="zstd", asbytes=True) for x in b[c]] for c in ("ids", "vectors")}
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([len(x.as_buffer()) // 8 for x in b["ids"]], pa.int32()), "no": b["no"],
                "ids": pa.array(small["ids"], pa.binary()), "wide": b["wide"], "vectors": pa.array(small["vectors"], pa.binary())})

    return run


def _unpack_small(n: int, ids: pa.Scalar, wide: bool, vectors: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the (n, dim) float64 matrix of one compressed block."""
    kind = np.dtype(np.float64 if wide else np.float32)
    found = np.frombuffer(pa.decompress(ids.as_buffer(), 8 * n, codec="zstd"), np.int64)
    mat = np.frombuffer(pa.decompress(vectors.as_buffer(), n * dim * kind.itemsize, codec="zstd"), kind)
    return found, mat.reshape(n, dim).astype(np.float64, copy=False)


def _tile(dim: int, k: int):
    """One pair of groups: the exact top-k of the group's corpus vectors for each of its
    queries, ``QUERY_STEP`` queries at a time."""

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and corpus.num_rows:
            (qids, qmat), (ids, mat) = _unpack(queries, dim), _unpack(corpus, dim)
            rows = SCORE_CELLS // QUERY_STEP
            for lo in range(0, len(qids), QUERY_STEP):
                some = qmat[lo:lo + QUERY_STEP]
                top = _RunningTopK(len(some), k)
                for i in range(0, len(ids), rows):
                    top.add(ids[i:i + rows], some @ mat[i:i + rows].T)
                at, r, found = top.result()
                out.append((qids[lo + at], found, r))  # the rounded score decides here, so it decides the merge
        qid, doc, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"qid": pa.array(qid), "doc_id": pa.array(doc), "score": pa.array(score)})

    return run


def tile_groups(n_q: int, n_d: int, dim: int, k: int, tiles: int, block_bytes: int) -> tuple[int, int]:
    """Query groups and corpus groups of a search: at least ``tiles`` tiles, bounded in memory,
    and as little traffic as possible. The corpus is shuffled once per query group, the queries
    once per corpus group, and each corpus group gives k rows per query to be merged."""
    queries, corpus = n_q * (8 * dim + 16), n_d * (8 * dim + 16)
    merged = n_q * min(k, n_d) * MERGE_ROW_BYTES
    q_groups = max(-(-(queries + n_q * min(k, n_d) * 24) // block_bytes), round((tiles * (queries + merged) / max(1, corpus)) ** 0.5), 1)
    q_groups = min(q_groups, n_q)
    d_groups = max(-(-corpus // CORPUS_GROUP_BYTES), -(-tiles // q_groups), 1)
    return q_groups, d_groups


def stream_groups(n_q: int, n_d: int, dim: int, k: int, tasks: int, block_bytes: int) -> tuple[int, int]:
    """Query groups and corpus parts of a streamed search. A group's vectors and lists, with what
    gathers before they are sorted, take at most ``block_bytes``. The corpus is only divided where
    the groups are too few for ``tasks``: each part gives k rows per query to be merged."""
    group = n_q * (8 * dim + 16 + 24 * MERGE_FACTOR * min(k, n_d))
    q_groups = min(max(-(-group // block_bytes), min(tasks, n_q // GROUP_QUERIES), 1), n_q)
    return q_groups, max(tasks // q_groups, 1)


def _stream(dim: int, k: int, step: int):
    """``mapInArrow`` body: (corpus block, query block) pairs to the exact top-k of each query
    over the corpus blocks that came by, ranked among these."""

    def run(batches):
        groups: dict[int, tuple] = {}
        for batch in batches:
            for no, n, m, wide, qwide, ids, qids, vec, qvec in zip(
                    *(batch[c].to_pylist() for c in ("qno", "n", "qn", "wide", "qwide")),
                    *(batch[c] for c in ("ids", "qids", "vectors", "qvectors"))):
                if no not in groups:
                    found, qmat = _unpack_small(m, qids, qwide, qvec, dim)
                    groups[no] = found, qmat, qmat.astype(np.float32), _RunningTopK(m, k)
                _, qmat, qmat32, top = groups[no]
                docs, mat = _unpack_small(n, ids, wide, vec, dim)
                rows, mat32 = max(1, step // max(1, m)), mat.astype(np.float32)
                for i in range(0, n, rows):
                    top.add_products(docs[i:i + rows], qmat, mat[i:i + rows], qmat32, mat32[i:i + rows])
        for found, _, _, top in groups.values():
            at, r, d = top.result()
            rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
            yield pa.RecordBatch.from_pydict({"qid": pa.array(found[at]), "rank": pa.array(rank.astype(np.int32)),
                                              "doc_id": pa.array(d), "score": pa.array(r)})

    return run


def knn_run(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = C.DEPTH,
    qid_col: str = "qid",
    qvec_col: str = "embedding",
    id_col: str = "doc_id",
    vec_col: str = "embedding",
    block_bytes: int = C.QUERY_BLOCK_BYTES,
    corpus_parts: int | None = None,
) -> DataFrame:
    """The run of ``knn_search``, stored, for many queries: disk grows with the queries and the
    corpus and not with their product.

    Both sides are stored once, the corpus as compressed blocks. A task has one query group
    (``stream_groups``) and reads the corpus, or one of its few parts, past it block by block, so
    the corpus is never shuffled, and where it is one part the lists are final as they are.
    ``corpus_parts`` sets the number of parts.
    """
    spark = corpus.sparkSession
    vectors = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("v")).where(F.col(qvec_col).isNotNull())
    q = stored(vectors, "query-vectors")  # a model runs once per query
    size = q.select(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("ids")).first()
    n_q, dim = int(size["n"]), int(size["d"] or 0)
    empty = spark.createDataFrame([], "qid long, rank int, doc_id long, score double")
    if n_q == 0 or dim == 0:
        return empty
    docs = corpus.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("v")).where(F.col(vec_col).isNotNull())
    block = "n int, no int, ids binary, wide boolean, vectors binary"
    packed = stored(docs.mapInArrow(_pack_small(dim), block), "corpus-vectors", **{"parquet.block.size": 4 * BLOCK_BYTES})
    n_d = int(packed.agg(F.sum("n")).first()[0] or 0)
    if n_d == 0:
        return empty
    q_groups, parts = stream_groups(n_q, n_d, dim, k, 4 * spark.sparkContext.defaultParallelism, block_bytes)
    parts = corpus_parts or parts
    # a checkpoint keeps its partitions: one group each
    groups = cut(q.repartition(q_groups).mapInArrow(_pack_small(dim), block))
    left = packed.select("n", "ids", "wide", "vectors").coalesce(parts)
    right = groups.select(*[F.col(c).alias(f"q{c}") for c in ("no", "n", "ids", "wide", "vectors")])
    found = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(
        _stream(dim, k, SCORE_CELLS), "qid long, rank int, doc_id long, score double")
    # lists of one query from several parts, or of an id that comes twice, are merged
    whole = parts == 1 and size["ids"] == n_q
    run = stored(found if whole else rank_top_k(found.drop("rank"), k), "run")
    forget(q, packed)
    return run


def knn_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = C.DEPTH,
    qid_col: str = "qid",
    qvec_col: str = "embedding",
    id_col: str = "doc_id",
    vec_col: str = "embedding",
    block_bytes: int = C.QUERY_BLOCK_BYTES,
    corpus_groups: int | None = None,
) -> DataFrame:
    """Exact inner-product top-k run ``(qid, rank, doc_id, score)``, lazily.

    A tile holds at most about ``block_bytes`` of query vectors and their lists, and
    ``CORPUS_GROUP_BYTES`` of corpus vectors, whatever the size of either side (``tile_groups``;
    ``corpus_groups`` sets the number of corpus groups). The packed corpus is written once and
    its rows are counted there: the planner cannot size what a model returns. Scores are
    rounded to 6 places, once, before anything is ranked. Rows with a null vector take no
    part; a vector of another length than the queries' is an error.
    """
    spark = corpus.sparkSession
    # query vectors are written once: a model runs once per query
    q = cut(queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("v")).where(F.col(qvec_col).isNotNull()))
    size = q.select(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    n_q, dim = int(size["n"]), int(size["d"] or 0)
    if n_q == 0 or dim == 0:
        return spark.createDataFrame([], "qid long, rank int, doc_id long, score double")
    docs = corpus.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("v")).where(F.col(vec_col).isNotNull())
    block = "no int, ids binary, wide boolean, vectors binary"
    packed = cut(docs.mapInArrow(_pack(dim), block))
    n_d = int(packed.agg(F.sum(F.length("ids")).alias("b")).first()["b"] or 0) // 8
    if n_d == 0:
        return spark.createDataFrame([], "qid long, rank int, doc_id long, score double")
    q_groups, d_groups = tile_groups(n_q, n_d, dim, k, 2 * bucket_count(spark), block_bytes)
    d_groups = corpus_groups or d_groups

    def dealt(blocks: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))) if others > 1 else F.lit(0)
        return blocks.select((F.col("no") % groups).alias(own), every.alias(other), "ids", "wide", "vectors")

    left = dealt(q.mapInArrow(_pack(dim, -(-n_q // (4 * q_groups))), block), "qg", q_groups, "dg", d_groups)
    right = dealt(packed, "dg", d_groups, "qg", q_groups)
    tiles = left.groupBy("qg", "dg").cogroup(right.groupBy("qg", "dg")).applyInArrow(
        _tile(dim, k), "qid long, doc_id long, score double")
    return rank_top_k(tiles, k)
