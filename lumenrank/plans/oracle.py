"""DuckDB SQL that states each registered query independently of Spark.

The pieces below are common table expressions over the pre-registered views
(documents, benchmark, conversations, embeddings). Every query computes from
the whole tables, exactly as its Spark twin in ``catalog.py`` does.
"""

from __future__ import annotations

from lumenrank import config as C

TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
K1, B = C.BM25_K1, C.BM25_B
DIM = C.HASH_DIM
WS = C.WS_CLASS


def tok(c: str) -> str:
    return TOK.format(c=c)


# query set: whole benchmark text as query; answers = 5th and 6th two-word matches
QS = r"""qs AS (
  SELECT item_id AS qid, text AS query,
         list_slice(regexp_extract_all(text, '[\p{L}\p{N}]+ [\p{L}\p{N}]+'), 5, 6) AS answers
  FROM benchmark)"""

VARIANT = "(('0x' || substr(md5(CAST({q} AS VARCHAR)), 1, 2))::INTEGER % {n})"


def variant(q: str = "qid", n: int = 4) -> str:
    return VARIANT.format(q=q, n=n)


HYDE_COMP = f"""hc AS (
  SELECT qid, CASE {variant()}
      WHEN 0 THEN ' ' || array_to_string(answers, ' ') || ' ' || chr(10)
      WHEN 1 THEN '  ' || chr(9) || ' '
      WHEN 3 THEN array_to_string(list_reverse(string_split(query, ' ')), ' ')
    END AS completion
  FROM qs WHERE {variant()} <> 2)"""

LIST_COMP = f"""lc AS (
  SELECT qid, CASE {variant()}
      WHEN 0 THEN '[' || CAST((qid % 10) + 1 AS VARCHAR) || '] [' || CAST(((qid * 7 + 3) % 10) + 1 AS VARCHAR)
                  || '], (' || CAST(((qid * 3 + 1) % 10) + 1 AS VARCHAR) || ').'
      WHEN 1 THEN 'The most relevant are 12, 0, 01 and ' || CAST(((qid * 7 + 3) % 10) + 1 AS VARCHAR) || '.'
      WHEN 2 THEN ' '
    END AS completion
  FROM qs WHERE {variant()} <> 3)"""


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def index_picks_sql(comp_table: str, limit: int = C.LISTWISE_TOP_N) -> str:
    """C10 in SQL: ``(qid, pick, rank)`` with pick 0-based, first occurrence wins."""
    return f"""toks AS (
  SELECT qid, t.tok, t.i
  FROM {comp_table},
       unnest(string_split_regex(coalesce(completion, ''), '[,\\s]+')) WITH ORDINALITY AS t(tok, i)),
cleaned AS (
  SELECT qid, i, TRY_CAST(regexp_replace(tok, '^[\\[\\]().]+|[\\[\\]().]+$', '', 'g') AS INTEGER) AS v,
         regexp_replace(tok, '^[\\[\\]().]+|[\\[\\]().]+$', '', 'g') AS s
  FROM toks),
valid AS (
  SELECT qid, v, min(i) AS first_i FROM cleaned
  WHERE regexp_full_match(s, '[0-9]+') AND v BETWEEN 1 AND {limit}
  GROUP BY qid, v),
picks AS (
  SELECT qid, v AS rank, row_number() OVER (PARTITION BY qid ORDER BY first_i) - 1 AS pick FROM valid)"""


def bm25_ctes(query_table: str = "qs", qid: str = "qid", qtext: str = "query",
              doc_table: str = "documents", doc_id: str = "doc_id", dtext: str = "text",
              k: int = C.DEPTH, name: str = "bm25") -> str:
    """BM25 top-k run as CTEs ending in ``{name}(qid, rank, doc_id, score)``."""
    return f"""{name}_dt AS (SELECT {doc_id} AS doc_id, {tok(dtext)} AS toks FROM {doc_table}),
{name}_ds AS (SELECT doc_id, len(toks) AS dl FROM {name}_dt),
{name}_st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM {name}_ds),
{name}_qt AS (
  SELECT qid, term, count(*) AS qtf
  FROM (SELECT {qid} AS qid, unnest({tok(qtext)}) AS term FROM {query_table})
  GROUP BY qid, term),
{name}_post AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(toks) AS term FROM {name}_dt)
  WHERE term IN (SELECT term FROM {name}_qt)
  GROUP BY doc_id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term),
{name}_w AS (
  SELECT q.qid, q.term, q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS wq
  FROM {name}_qt q JOIN {name}_df d USING (term), {name}_st s),
{name}_sc AS (
  SELECT w.qid, p.doc_id,
         round(sum(w.wq * p.tf / (p.tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * ds.dl / s.avgdl))), 6) AS score
  FROM {name}_w w JOIN {name}_post p USING (term) JOIN {name}_ds ds USING (doc_id), {name}_st s
  GROUP BY w.qid, p.doc_id),
{name} AS (
  SELECT qid, rank, doc_id, score FROM (
    SELECT qid, doc_id, score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
    FROM {name}_sc) WHERE rank <= {k})"""


def hashvec_ctes(table: str, key: str, text: str, name: str, dim: int = DIM) -> str:
    """Hashing-encoder vectors as sparse rows ``{name}(key, bucket, v)`` and norms ``{name}_n``."""
    return f"""{name}_tok AS (SELECT {key} AS key, unnest({tok(text)}) AS term FROM {table}),
{name} AS (
  SELECT key, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS bucket,
         sum(CASE WHEN (('0x' || substr(md5(term), 9, 1))::INTEGER % 2) = 0 THEN 1 ELSE -1 END) AS v
  FROM {name}_tok GROUP BY ALL),
{name}_n AS (
  SELECT k.key, coalesce(sqrt(sum(v * v)), 0)::DOUBLE AS norm
  FROM (SELECT DISTINCT {key} AS key FROM {table}) k LEFT JOIN {name} h USING (key) GROUP BY k.key)"""


def dense_text_ctes(q_table: str, q_key: str, q_text: str, d_table: str, d_key: str, d_text: str,
                    k: int = C.DEPTH, name: str = "dense") -> str:
    """Hashing-encoder exact top-k over all (query, doc) pairs: ``{name}(qid, rank, doc_id, score)``."""
    return f"""{hashvec_ctes(q_table, q_key, q_text, name + '_qv')},
{hashvec_ctes(d_table, d_key, d_text, name + '_dv')},
{name}_dot AS (
  SELECT q.key AS qid, d.key AS doc_id, sum(q.v * d.v)::DOUBLE AS dot
  FROM {name}_qv q JOIN {name}_dv d USING (bucket) GROUP BY ALL),
{name}_all AS (
  SELECT qn.key AS qid, dn.key AS doc_id,
         CASE WHEN qn.norm > 0 AND dn.norm > 0
              THEN round(coalesce(x.dot, 0) / (qn.norm * dn.norm), 6) ELSE 0.0 END AS score
  FROM {name}_qv_n qn CROSS JOIN {name}_dv_n dn
  LEFT JOIN {name}_dot x ON x.qid = qn.key AND x.doc_id = dn.key),
{name} AS (
  SELECT qid, rank, doc_id, score FROM (
    SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
    FROM {name}_all) WHERE rank <= {k})"""


def run_select(name: str) -> str:
    return f"SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score FROM {name}"


def rrf_ctes(dense: str, bm25: str, name: str = "rrf") -> str:
    return f"""{name}_u AS (
  SELECT qid, doc_id, rank AS d_rank, NULL::BIGINT AS b_rank FROM {dense}
  UNION ALL SELECT qid, doc_id, NULL::BIGINT, rank FROM {bm25}),
{name}_g AS (
  SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + coalesce(d_rank, b_rank))) AS score,
         min(d_rank) AS d_rank, min(b_rank) AS b_rank
  FROM {name}_u GROUP BY qid, doc_id),
{name} AS (
  SELECT qid, doc_id, score,
         row_number() OVER (PARTITION BY qid ORDER BY score DESC, d_rank ASC NULLS LAST, b_rank ASC NULLS LAST) AS rank
  FROM {name}_g)"""


def coverage_ctes(run: str, name: str = "pw") -> str:
    """Pointwise rerank of ``run`` with the coverage scorer and the raw query."""
    return f"""{name}_s AS (
  SELECT r.qid, r.doc_id, r.rank AS old_rank,
         CASE WHEN len(list_distinct({tok('q.query')})) > 0
              THEN len(list_intersect(list_distinct({tok('q.query')}), {tok('d.text')}))::DOUBLE
                   / len(list_distinct({tok('q.query')}))
              ELSE 0.0 END AS score
  FROM {run} r JOIN qs q USING (qid) LEFT JOIN documents d ON d.doc_id = r.doc_id),
{name} AS (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old_rank) AS rank
  FROM {name}_s)"""


def listwise_ctes(run: str, comp: str = "lc", name: str = "lw") -> str:
    return f"""{index_picks_sql(comp)},
{name} AS (
  SELECT r.qid, r.doc_id, r.score,
         row_number() OVER (PARTITION BY r.qid ORDER BY p.pick ASC NULLS LAST, r.rank) AS rank
  FROM {run} r LEFT JOIN picks p ON p.qid = r.qid AND p.rank = r.rank)"""


def hits_ctes(run: str, name: str = "hits") -> str:
    """Hit flags per run row and first hit rank per query."""
    return f"""{name}_f AS (
  SELECT r.qid, r.rank, r.doc_id, r.score,
         CASE WHEN d.text IS NOT NULL AND len(list_filter(q.answers, lambda a: contains(d.text, a))) > 0
              THEN 1 ELSE 0 END AS hit
  FROM {run} r LEFT JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN qs q ON q.qid = r.qid),
{name}_first AS (SELECT qid, min(rank) AS first_hit FROM {name}_f WHERE hit = 1 GROUP BY qid),
{name}_k AS (
  SELECT k::BIGINT AS k, q.qid, CASE WHEN f.first_hit <= k THEN 1 ELSE 0 END::BIGINT AS hit
  FROM qs q LEFT JOIN {name}_first f USING (qid), (SELECT unnest([1, 10, 100]) AS k))"""
