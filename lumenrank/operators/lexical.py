"""BM25 index tables and batch BM25 search.

Index tables (all hash-partitioned by ``doc_id``):

* ``postings``   ``(doc_id, term, tf, dl, positions)``
* ``doc_stats``  ``(doc_id, dl, text)``
* ``term_stats`` ``(term, df, cf)``
* ``doc_vectors`` ``(doc_id, vector map<term, tf>)``

Search joins the query-term weights (broadcast when their measured size allows) to the postings. As the
postings are partitioned by ``doc_id``, the per-(query, doc) sum needs no
shuffle; each partition keeps at most k rows per query (partial
``WindowGroupLimit``) before the only exchange, on ``qid``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank import config as C
from lumenrank.functions.text import tokens
from lumenrank.operators.plan import bucket_count, bucketed, by_key, checked, cut


@dataclass
class Bm25Index:
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    doc_vectors: DataFrame
    _stats: tuple | None = None
    materialized: bool = False
    term_buckets: int | None = None
    buckets: int | None = None

    def collection_stats(self) -> tuple[int, float]:
        """(N, avgdl): one aggregate row, computed once per index."""
        if self._stats is None:
            row = self.doc_stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("a")).first()
            self._stats = (int(row["n"]), float(row["a"] or 0.0))
        return self._stats


def doc_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               buckets: int | None = None) -> DataFrame:
    """``(doc_id, text, tokens)`` hash-partitioned by ``doc_id``, whatever the input's splits."""
    d = by_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", buckets)
    return d.withColumn("tokens", tokens("text"))


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``(doc_id, text, tokens)`` written as a table bucketed by ``doc_id``: the one tokenising
    pass that the BM25 index, the hashing encoder and anything else by ``doc_id`` can share.
    Null texts have no tokens."""
    buckets = buckets or bucket_count(docs.sparkSession)
    return bucketed(doc_tokens(docs, id_col, text_col, buckets), "doc_id", "tokens", buckets)


def term_bucket(term, buckets: int):
    """Folder key of a term in term-partitioned postings."""
    return F.pmod(F.xxhash64(term), F.lit(buckets))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                with_positions: bool = True, materialize: bool = False,
                term_buckets: int | None = None, buckets: int | None = None) -> Bm25Index:
    """Term frequencies, positions, lengths, document frequencies, raw text.

    Documents are always hash-partitioned by ``doc_id`` into ``buckets`` partitions
    before their tokens are exploded; the ``(doc_id, term)`` aggregation then reuses
    that partitioning, so the postings come out partitioned by ``doc_id`` with
    no second exchange, and one file per bucket is written. ``materialize`` writes the postings as a table bucketed
    by ``doc_id`` in the shared checkpoint folder (one tokenising pass) and
    derives the term table and (N, avgdl) from it, so searches read them (still
    partitioned by ``doc_id``) instead of re-tokenising. ``term_buckets`` also
    splits the written postings into folders by term hash, so a search reads
    only the folders of its query terms (static partition pruning). ``docs`` may be a
    ``token_table`` of as many buckets: then nothing is tokenised or shuffled here.
    """
    buckets = buckets or bucket_count(docs.sparkSession)
    dt = docs if "tokens" in docs.columns else doc_tokens(docs, id_col, text_col, buckets)
    doc_stats = dt.select("doc_id", F.size("tokens").cast("bigint").alias("dl"), "text")
    # outer explode + explicit filter: a plain explode lets the optimizer infer
    # size(tokens) > 0 and push it under the exchange, tokenising twice
    occ = dt.select("doc_id", F.size("tokens").cast("bigint").alias("dl"),
                    F.posexplode_outer("tokens").alias("pos", "term")).where(F.col("term").isNotNull())
    aggs = [F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")]
    if with_positions:
        aggs.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    postings = occ.groupBy("doc_id", "term").agg(*aggs)
    stats = None
    if materialize:
        # one tokenising pass: everything else is derived from the written postings
        if term_buckets:
            postings = bucketed(postings.withColumn("tb", term_bucket("term", term_buckets)),
                                "doc_id", "postings", buckets, partition_by="tb")
        else:
            postings = bucketed(postings, "doc_id", "postings", buckets)
        n_docs = docs.count()  # a plain scan: documents without tokens still count
    term_stats = postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )
    if materialize:
        term_stats = cut(term_stats)
        total = term_stats.agg(F.sum("cf").alias("t")).first()["t"] or 0  # of the vocabulary, not the postings
        stats = (int(n_docs), float(total) / n_docs if n_docs else 0.0)
    doc_vectors = postings.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("vector")
    )
    return Bm25Index(postings, doc_stats, term_stats, doc_vectors, stats, materialize,
                     term_buckets if materialize else None, buckets)


def query_terms(queries: DataFrame, qid_col: str = "qid", text_col: str = "query") -> DataFrame:
    """``(qid, term, qtf)``: a query term counts as often as it occurs."""
    return (
        queries.select(F.col(qid_col).alias("qid"), F.explode_outer(tokens(text_col)).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_search(
    index: Bm25Index,
    queries: DataFrame,
    k: int = C.DEPTH,
    k1: float = C.BM25_K1,
    b: float = C.BM25_B,
    qid_col: str = "qid",
    text_col: str = "query",
) -> DataFrame:
    """Top-k BM25 run ``(qid, rank, doc_id, score)``.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); term weight
    tf / (tf + k1 * (1 - b + b * dl / avgdl)). Scores are rounded to 6 places
    before ranking; ties go to the smaller doc_id. A doc needs one shared term.
    """
    qt, small = checked(query_terms(queries, qid_col, text_col))
    hint = F.broadcast if small else (lambda side: side)  # holds for what is no larger than ``qt``
    n_docs, avgdl = index.collection_stats()
    qterms = hint(qt.select("term").distinct())
    if index.materialized:  # written term table: a scan of the vocabulary, not the postings
        dfs = index.term_stats.select("term", "df").join(qterms, "term")
    else:  # document frequency of the query terms only: a filtered aggregate over the postings
        dfs = index.postings.join(qterms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = hint(qt).join(dfs, "term").select(
        "qid", "term",
        (F.col("qtf") * F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("wq"),
    )
    postings = index.postings
    if index.term_buckets:  # read only the folders holding a query term (at most term_buckets values)
        folders = [r[0] for r in qt.select(term_bucket("term", index.term_buckets).alias("tb")).distinct().collect()]
        postings = postings.where(F.col("tb").isin(folders))
    matches = postings.select("doc_id", "term", "tf", "dl").join(hint(weights), "term")  # one row per row of ``qt``
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
    part = F.col("wq") * F.col("tf") / (F.col("tf") + norm)
    scored = matches.groupBy("qid", "doc_id").agg(F.round(F.sum(part), C.SCORE_DIGITS).alias("score"))
    return rank_top_k(scored, k)


def rank_top_k(scored: DataFrame, k: int, order=None) -> DataFrame:
    """``row_number`` over (qid; score desc, doc_id asc), keep ``rank <= k``."""
    order = order or [F.col("score").desc(), F.col("doc_id").asc()]
    w = Window.partitionBy("qid").orderBy(*order)
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("qid", "rank", "doc_id", "score")
    )
