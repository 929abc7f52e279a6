"""DuckDB twins of the registered queries (see ``catalog.py``)."""

from __future__ import annotations

from lumenrank.plans import oracle as O

SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    SQL[name] = text.strip()


_DT = f"dt AS (SELECT doc_id, {O.tok('text')} AS toks FROM documents)"
_POST = f"""{_DT},
occ AS (SELECT doc_id, t.term, t.pos - 1 AS pos FROM dt, unnest(toks) WITH ORDINALITY AS t(term, pos)),
post AS (SELECT doc_id, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
         FROM occ GROUP BY doc_id, term)"""

sql("tokens", f"""WITH {_DT}
SELECT doc_id, (t.pos - 1)::BIGINT AS pos, t.term FROM dt, unnest(toks) WITH ORDINALITY AS t(term, pos)""")

sql("postings", f"""WITH {_POST}
SELECT doc_id, term, tf::BIGINT AS tf, positions FROM post""")

sql("doc_stats", f"""WITH {_DT} SELECT doc_id, len(toks)::BIGINT AS dl FROM dt""")

sql("term_stats", f"""WITH {_POST}
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term""")

sql("doc_vectors", f"""WITH {_POST} SELECT doc_id, term, tf::BIGINT AS tf FROM post""")

sql("bm25_topk", f"""WITH {O.QS}, {O.bm25_ctes()} {O.run_select('bm25')}""")

sql("answers_parse", f"""WITH {O.QS}
SELECT qid, (t.pos - 1)::BIGINT AS pos, t.answer FROM qs, unnest(answers) WITH ORDINALITY AS t(answer, pos)""")

sql("answer_hits", f"""WITH {O.QS}, {O.bm25_ctes()}, {O.hits_ctes('bm25')}
SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score, hit::BIGINT AS hit FROM hits_f""")

sql("hit_at_k", f"""WITH {O.QS}, {O.bm25_ctes()}, {O.hits_ctes('bm25')} SELECT k, qid, hit FROM hits_k""")

sql("hit_mean", f"""WITH {O.QS}, {O.bm25_ctes()}, {O.hits_ctes('bm25')}
SELECT k, round(avg(hit), 6) AS hit_rate FROM hits_k GROUP BY k""")

sql("offline_eval", f"""WITH {O.QS}, {O.bm25_ctes()}, {O.hits_ctes('bm25')}
SELECT k, round(avg(hit), 6) AS hit_rate FROM hits_k GROUP BY k""")

sql("dense_text_topk", f"""WITH {O.QS}, {O.dense_text_ctes('qs', 'qid', 'query', 'documents', 'doc_id', 'text')}
{O.run_select('dense')}""")

sql("rrf_fusion", f"""WITH {O.QS}, {O.bm25_ctes()},
{O.dense_text_ctes('qs', 'qid', 'query', 'documents', 'doc_id', 'text')}, {O.rrf_ctes('dense', 'bm25')}
{O.run_select('rrf')}""")

_DENSE = O.dense_text_ctes('qs', 'qid', 'query', 'documents', 'doc_id', 'text')

sql("rrf_no_bm25", f"""WITH {O.QS}, {_DENSE} {O.run_select('dense')}""")

# ---------------------------------------------------------------- pool
sql("pool_build", "SELECT doc_id AS id, text FROM documents")

_CORPUS = """corp AS (
  SELECT (row_number() OVER (ORDER BY md5(text), text) - 1)::BIGINT AS idx, text
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL))"""

sql("pool_distinct", f"WITH {_CORPUS} SELECT idx, text FROM corp")

# ---------------------------------------------------------------- vectors
_EMB = """ev AS (
  SELECT vec_id, label, (t.i - 1)::BIGINT AS i, t.x::DOUBLE AS x
  FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(x, i))"""

sql("l2_normalise", f"""WITH {_EMB},
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ev GROUP BY vec_id)
SELECT vec_id, i, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS value FROM ev JOIN nrm USING (vec_id)""")

sql("mean_pool_rows", """WITH e AS (SELECT vec_id, embedding FROM embeddings),
c AS (SELECT a.vec_id, g.i - 1 AS i, avg(b.embedding[g.i]::DOUBLE) AS v
      FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + 2,
           LATERAL (SELECT unnest(range(1, len(b.embedding) + 1)) AS i) g
      GROUP BY a.vec_id, g.i),
n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY vec_id)
SELECT c.vec_id, i::BIGINT AS i, round(CASE WHEN norm > 0 THEN v / norm ELSE v END, 6) AS value
FROM c JOIN n USING (vec_id)""")

sql("instructed_query", f"""WITH {O.QS}
SELECT qid, 'Represent this question for finding passages: ' || query AS text FROM qs""")

sql("instructed_examples", f"""WITH {O.QS}
SELECT qid, 'Examples: Question: which river is longest? Passage: The longest river is the Nile.' || chr(10)
            || 'Represent this question for finding passages: ' || query AS text FROM qs""")

sql("mean_pool", f"""WITH {_EMB}
SELECT label::BIGINT AS label, i, round(avg(x), 6) AS value FROM ev GROUP BY label, i""")

_KNN = """pairs AS (
  SELECT q.qid, d.doc_id, round(list_inner_product(q.v, d.v), 6) AS score
  FROM qv q CROSS JOIN dv d),
knn AS (
  SELECT qid, rank, doc_id, score FROM (
    SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
    FROM pairs) WHERE rank <= 200)"""

sql("knn_exact", f"""WITH
qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings),
dv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
{_KNN} {O.run_select('knn')}""")

sql("knn_single", f"""WITH {_EMB},
cen AS (SELECT i, avg(x) AS x FROM ev GROUP BY i),
qv AS (SELECT 0::BIGINT AS qid, list(x ORDER BY i) AS v FROM cen),
dv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
{_KNN} {O.run_select('knn')}""")

sql("encode_hash", f"""WITH {O.hashvec_ctes('documents', 'doc_id', 'text', 'hv')}
SELECT d.doc_id, count(h.bucket) AS n,
       md5(coalesce(string_agg(h.bucket || ':' || CAST(round(h.v / m.norm * 1000000) AS BIGINT), ',' ORDER BY h.bucket), '')) AS digest
FROM documents d LEFT JOIN (SELECT * FROM hv WHERE v <> 0) h ON h.key = d.doc_id LEFT JOIN hv_n m ON m.key = d.doc_id
WHERE d.text IS NOT NULL GROUP BY d.doc_id""")

# ---------------------------------------------------------------- rerank
_FUSED = f"""{O.QS}, {O.bm25_ctes()}, {_DENSE}, {O.rrf_ctes('dense', 'bm25')}"""

sql("pair_score", f"""WITH {_FUSED}, {O.coverage_ctes('rrf')}
SELECT qid, doc_id, round(score, 6) AS score FROM pw_s""")

sql("pointwise_rerank", f"""WITH {_FUSED}, {O.coverage_ctes('rrf')} {O.run_select('pw')}""")

sql("listwise_prompt", f"""WITH {_FUSED},
blk AS (
  SELECT r.qid, string_agg('[' || CAST(r.rank AS VARCHAR) || '] ' || coalesce(d.text, ''), chr(10) ORDER BY r.rank) AS lines
  FROM rrf r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= 10 GROUP BY r.qid)
SELECT b.qid, 'Query: ' || q.query || chr(10) || 'Here are candidate documents:' || chr(10) || b.lines || chr(10)
       || 'Return the indices of the most relevant documents in order, separated by spaces or commas.' AS prompt
FROM blk b JOIN qs q USING (qid)""")

sql("parse_indices", f"""WITH {O.QS}, {O.LIST_COMP}, {O.index_picks_sql('lc')}
SELECT qid, pick::BIGINT AS pick, rank::BIGINT AS rank FROM picks""")

sql("listwise_rerank", f"""WITH {_FUSED}, {O.LIST_COMP}, {O.listwise_ctes('rrf')} {O.run_select('lw')}""")

# ---------------------------------------------------------------- HyDE
sql("hyde_prompt", f"""WITH {O.QS}
SELECT qid, 'Write a concise passage that directly answers the question.' || chr(10) || 'Question: ' || query
            || chr(10) || 'Passage:' AS prompt FROM qs""")

_SQ = f"""{O.HYDE_COMP},
sq AS (SELECT q.qid, q.query, coalesce(nullif({O.strip_sql('h.completion')}, ''), q.query) AS search
       FROM qs q LEFT JOIN hc h USING (qid))"""

sql("hyde_query", f"""WITH {O.QS}, {_SQ} SELECT qid, search FROM sq""")

# ---------------------------------------------------------------- alignment
sql("run_alignment", f"""WITH {O.QS}, {O.bm25_ctes()}
SELECT (SELECT count(*) FROM (SELECT DISTINCT qid FROM bm25) r WHERE qid NOT IN (SELECT qid FROM qs))::BIGINT
         AS run_qids_unknown,
       (SELECT count(*) FROM qs WHERE qid NOT IN (SELECT qid FROM bm25))::BIGINT AS queries_without_rows""")

# ---------------------------------------------------------------- training rows and mining
_TR = """cu AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
ca AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
tr_src AS (
  SELECT u.conv_id * 2147483648 + u.turn AS qid, u.text AS query, [p.text] AS pos,
         list_transform(list_filter([{'e': n1.turn IS NOT NULL, 't': n1.text}, {'e': n2.turn IS NOT NULL, 't': n2.text}],
                                    lambda x: x.e), lambda x: x.t) AS hn
  FROM cu u JOIN ca p ON p.conv_id = u.conv_id AND p.turn = u.turn + 1
  LEFT JOIN ca n1 ON n1.conv_id = u.conv_id AND n1.turn = u.turn - 1
  LEFT JOIN ca n2 ON n2.conv_id = u.conv_id AND n2.turn = u.turn + 3)"""


def _tr_rows(neg: str) -> str:
    return f"""WITH {_TR}, tr AS (SELECT qid, query, pos, {neg} AS neg FROM tr_src)
SELECT qid, 'query' AS kind, 0::BIGINT AS pos, query AS text FROM tr
UNION ALL SELECT qid, 'pos', (t.i - 1)::BIGINT, t.x FROM tr, unnest(pos) WITH ORDINALITY AS t(x, i)
UNION ALL SELECT qid, 'neg', (t.i - 1)::BIGINT, t.x FROM tr, unnest(neg) WITH ORDINALITY AS t(x, i)"""


sql("training_rows_both", _tr_rows("hn"))
sql("training_rows_only_pos", _tr_rows("[]::VARCHAR[]"))

sql("mining_union_corpus", f"""WITH {_TR},
txt AS (SELECT unnest(pos) AS text FROM tr_src UNION ALL SELECT unnest(hn) FROM tr_src)
SELECT (row_number() OVER (ORDER BY md5(text), text) - 1)::BIGINT AS idx, text
FROM (SELECT DISTINCT text FROM txt WHERE text IS NOT NULL)""")

# stride: the first number from the golden section of N on that is coprime with N, reduced mod N
_GOLDEN = "greatest(1, CAST(floor(nc.n * 0.6180339887498949) AS BIGINT))"
STRIDE_SQL = (f"(list_min(list_filter(range({_GOLDEN}, {_GOLDEN} + 1000), lambda s: gcd(s, nc.n) = 1)) % nc.n)")
_ROWS = "tr AS (SELECT qid, query, pos, hn AS neg FROM tr_src)"
# read from a file, a row's id is its place there
_FILE_ROWS = """tr AS (SELECT (row_number() OVER (ORDER BY qid) - 1)::BIGINT AS qid, qid AS origin, query, pos, hn AS neg
       FROM tr_src)"""
_OWN_CORPUS = """txt AS (SELECT unnest(pos) AS text FROM tr_src UNION ALL SELECT unnest(hn) FROM tr_src),
corp AS (
  SELECT (row_number() OVER (ORDER BY md5(text), text) - 1)::BIGINT AS idx, text
  FROM (SELECT DISTINCT text FROM txt WHERE text IS NOT NULL))"""

_MINE = f"""{_TR}, {{rows}}, {{corpus}},
{O.dense_text_ctes('tr', 'qid', 'query', 'corp', 'idx', 'text', k='{hi}', name='mk')},
win AS (SELECT qid, rank, doc_id AS idx, score FROM mk WHERE rank > {{lo}} AND rank <= {{hi}}),
filt AS (
  SELECT w.qid, w.rank, w.idx, c.text FROM win w JOIN corp c USING (idx) JOIN tr t USING (qid)
  WHERE NOT coalesce(list_contains(t.pos, c.text), false) AND c.text <> t.query),
samp AS (
  SELECT * FROM (
    SELECT qid, CASE WHEN count(*) OVER (PARTITION BY qid) <= 15
                     THEN row_number() OVER (PARTITION BY qid ORDER BY rank)
                     ELSE row_number() OVER (PARTITION BY qid ORDER BY
                          md5('lumenrank' || '|' || CAST(qid AS VARCHAR) || '|' || CAST(idx AS VARCHAR)), idx)
                END AS draw, idx, text
    FROM filt) WHERE draw <= 15),
mined AS (
  SELECT t.qid, t.query, t.pos,
         coalesce((SELECT list(s.text ORDER BY s.draw) FROM samp s WHERE s.qid = t.qid), []::VARCHAR[]) AS neg
  FROM tr t),
ncorp AS (SELECT count(*) AS n FROM corp),
draws AS (
  SELECT m.qid, g.i, ((('0x' || substr(md5('lumenrank' || '|fill|' || CAST(m.qid AS VARCHAR)), 1, 15))::BIGINT % nc.n)
                       + g.i * ({{stride}})) % nc.n AS idx
  FROM mined m, ncorp nc,
       LATERAL (SELECT unnest(range(0, least(15 + len(m.pos) + 1, nc.n))) AS i) g
  WHERE len(m.neg) < 15),
okd AS (
  SELECT d.qid, d.i, c.text FROM draws d JOIN corp c USING (idx) JOIN mined m USING (qid)
  WHERE NOT list_contains(m.pos, c.text) AND c.text <> m.query AND NOT list_contains(m.neg, c.text)),
pick AS (
  SELECT o.qid, o.i, o.text FROM (
    SELECT okd.*, row_number() OVER (PARTITION BY qid ORDER BY i) AS j FROM okd) o
  JOIN mined m USING (qid) WHERE o.j <= 15 - len(m.neg)),
final AS (
  SELECT m.qid, list_concat(m.neg, coalesce((SELECT list(p.text ORDER BY p.i) FROM pick p WHERE p.qid = m.qid),
                                             []::VARCHAR[])) AS neg
  FROM mined m)"""


def _mine_sql(select: str, window: str = "2-200", rows: str = _ROWS, corpus: str = _CORPUS) -> str:
    lo, hi = window.split("-")
    chain = _MINE.replace("{rows}", rows).replace("{corpus}", corpus).replace("{stride}", STRIDE_SQL)
    return f"WITH {chain.replace('{lo}', lo).replace('{hi}', hi)} {select}"


sql("mine_window", _mine_sql("SELECT qid, CAST(rank AS BIGINT) AS rank, idx, round(score, 6) AS score FROM win"))
sql("mine_filtered", _mine_sql("SELECT qid, CAST(rank AS BIGINT) AS rank, idx FROM filt"))
sql("mine_sampled", _mine_sql("SELECT qid, draw::BIGINT AS draw, idx FROM samp"))
_FINAL_ROWS = ("SELECT qid, (t.i - 1)::BIGINT AS slot, t.x AS text, CASE WHEN len(neg) < 15 THEN 1 ELSE 0 END::BIGINT "
               "AS short FROM final, unnest(neg) WITH ORDINALITY AS t(x, i)")
sql("mine_backfilled", _mine_sql(_FINAL_ROWS))
sql("mine_backfill_narrow", _mine_sql(_FINAL_ROWS, "2-12"))

_FILE_SELECT = "SELECT t.origin, (x.i - 1)::BIGINT AS slot, x.x AS text FROM final f JOIN tr t USING (qid), unnest(f.neg) WITH ORDINALITY AS x(x, i)"
sql("mine_files_pool", _mine_sql(_FILE_SELECT, rows=_FILE_ROWS))
sql("mine_files_own", _mine_sql(_FILE_SELECT, rows=_FILE_ROWS, corpus=_OWN_CORPUS))

# ---------------------------------------------------------------- sources and sinks
sql("pool_texts", "SELECT text FROM documents")
sql("training_file", f"""WITH {_TR}, tr AS (SELECT (row_number() OVER (ORDER BY qid) - 1)::BIGINT AS qid, query, pos, hn AS neg FROM tr_src)
SELECT qid, 'query' AS kind, 0::BIGINT AS pos, query AS text FROM tr
UNION ALL SELECT qid, 'pos', (t.i - 1)::BIGINT, t.x FROM tr, unnest(pos) WITH ORDINALITY AS t(x, i)
UNION ALL SELECT qid, 'neg', (t.i - 1)::BIGINT, t.x FROM tr, unnest(neg) WITH ORDINALITY AS t(x, i)""")
sql("bm25_saved", f"""WITH {O.QS}, {O.bm25_ctes()} {O.run_select('bm25')}""")
sql("run_evaluated_later", f"""WITH {O.QS}, {_DENSE}, {O.hits_ctes('dense')}
SELECT k, round(avg(hit), 6) AS hit_rate FROM hits_k GROUP BY k""")
sql("roundtrip_tsv", "SELECT doc_id AS id, text FROM documents")
sql("roundtrip_jsonl", "SELECT doc_id AS id, text FROM documents")
sql("roundtrip_queries", f"""WITH {O.QS} SELECT qid, query, array_to_string(answers, '|') AS answers FROM qs""")
sql("roundtrip_vectors", SQL["encode_hash"])
sql("stream_bm25_topk", f"""WITH {O.QS}, {O.bm25_ctes()} {O.run_select('bm25')}""")
sql("roundtrip_run", f"""WITH {O.QS}, {O.bm25_ctes()} {O.run_select('bm25')}""")
sql("hit_files", f"""WITH {O.QS}, {O.bm25_ctes()}, {O.hits_ctes('bm25')}
SELECT k, qid + 1 AS id, hit FROM hits_k""")

# ---------------------------------------------------------------- composed retrieval job
_PIPE_HITS = """SELECT h.qid, CAST(h.rank AS BIGINT) AS rank, h.doc_id, round(h.score, 6) AS score, h.hit::BIGINT AS hit
FROM hits_f h"""

sql("composed_dense", f"""WITH {O.QS}, {_DENSE}, {O.hits_ctes('dense')} {_PIPE_HITS}""")

sql("composed_mixed", f"""WITH {_FUSED}, {O.hits_ctes('rrf')} {_PIPE_HITS}""")

sql("composed_full", f"""WITH {O.QS}, {_SQ},
{O.bm25_ctes(query_table='sq', qtext='search')},
{O.dense_text_ctes('sq', 'qid', 'search', 'documents', 'doc_id', 'text')},
{O.rrf_ctes('dense', 'bm25')}, {O.coverage_ctes('rrf')}, {O.LIST_COMP}, {O.listwise_ctes('pw')},
{O.hits_ctes('lw')} {_PIPE_HITS}""")


sql("composed_generated", f"""WITH {O.QS},
sq AS (SELECT qid, query, coalesce(nullif({O.strip_sql('half')}, ''), query) AS search FROM (
  SELECT qid, query, array_to_string(list_slice(w, 1, (len(w) + 1) // 2), ' ') AS half
  FROM (SELECT qid, query, string_split(query, ' ') AS w FROM qs))),
{O.dense_text_ctes('sq', 'qid', 'search', 'documents', 'doc_id', 'text')},
lc AS (SELECT qid, '2 1' AS completion FROM qs), {O.listwise_ctes('dense')} {O.run_select('lw')}""")


sql("generated_resumed", f"""WITH {O.QS}
SELECT qid, array_to_string(list_slice(w, 1, (len(w) + 1) // 2), ' ') AS completion
FROM (SELECT qid, string_split(query, ' ') AS w FROM qs)""")


sql("hit_file_ordered", f"""WITH {O.QS}, {O.bm25_ctes()}, {O.hits_ctes('bm25')}
SELECT k, row_number() OVER (PARTITION BY k ORDER BY qid) - 1 AS line, qid + 1 AS id, hit FROM hits_k""")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
