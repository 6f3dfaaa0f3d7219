"""Registered chunking and retrieval queries, including the flagship
``m_retrieve`` (routed hybrid retrieval for the `benchmark` questions over
the chunked `documents` corpus)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papertrail.functions import prompts as PR
from papertrail.functions.text import route_query, tokenize
from papertrail.operators import chunk as K
from papertrail.operators import corpus as C
from papertrail.operators import history as H
from papertrail.operators import retrieval as R
from papertrail.operators import vector_index as VI
from papertrail.plans import duck as D
from papertrail.plans import retrieve as RT
from papertrail.plans.registry import SQL, register
from papertrail.session import scratch_path, table

# ------------------------------------------------------------------ SQL builders


def sql_bm25(corpus: str, qs: str, out: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs ending in ``out(qid, id, score, rank)``; ``corpus(id, text)``,
    ``qs(qid, text)``."""
    return f"""
{out}_toks AS (SELECT id, unnest({D.tokens('text')}) AS term FROM {corpus}),
{out}_dl AS (SELECT c.id, coalesce(t.dl, 0) AS dl FROM {corpus} c LEFT JOIN
             (SELECT id, count(*) AS dl FROM {out}_toks GROUP BY id) t USING (id)),
{out}_post AS (SELECT id, term, count(*) AS tf FROM {out}_toks GROUP BY id, term),
{out}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {out}_dl),
{out}_qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({D.tokens('text')}) AS term FROM {qs}) GROUP BY qid, term),
{out}_df AS (SELECT term, count(*) AS df FROM {out}_post WHERE term IN (SELECT term FROM {out}_qt) GROUP BY term),
{out}_sc AS (SELECT q.qid, p.id, sum(q.qtf * ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * {k1 + 1.0}
                 / (p.tf + {k1} * ({1.0 - b} + {b} * d.dl / s.avgdl))) AS score
             FROM {out}_qt q JOIN {out}_df f USING (term) JOIN {out}_post p USING (term) JOIN {out}_dl d ON d.id = p.id
             CROSS JOIN {out}_st s GROUP BY q.qid, p.id),
{out} AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank
          FROM {out}_sc QUALIFY rank <= {k})"""


def sql_hashemb(src: str, out: str, dims: int = 64) -> str:
    """``out(id, bk, w)``: sparse L2-normalised hashed bag of words."""
    return f"""
{out}_c AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dims} AS bk, count(*) AS c
            FROM (SELECT id, unnest({D.tokens('text')}) AS t FROM {src}) GROUP BY 1, 2),
{out} AS (SELECT id, bk, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {out}_c)"""


def sql_vec_topk(qs: str, corpus: str, out: str, k: int = 10) -> str:
    """``out(qid, id, score, rank)`` by hashed-embedding inner product."""
    return f"""{sql_hashemb(f'(SELECT qid AS id, text FROM {qs})', out + '_qe')},
{sql_hashemb(corpus, out + '_ce')},
{out}_s AS (SELECT q.qid, c.id, coalesce(s.score, 0.0) AS score
            FROM (SELECT DISTINCT qid FROM {qs}) q CROSS JOIN (SELECT id FROM {corpus}) c
            LEFT JOIN (SELECT a.id AS qid, e.id, sum(a.w * e.w) AS score FROM {out}_qe a JOIN {out}_ce e USING (bk) GROUP BY 1, 2) s
            ON s.qid = q.qid AND s.id = c.id),
{out} AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank
          FROM {out}_s QUALIFY rank <= {k})"""


def sql_chunks(src: str = "documents", size: int = 4096, overlap: int = 1024) -> str:
    step = size - overlap
    return f"""chunks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, doc_id * 1048576 + i AS id, source, lang,
         substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS text,
         md5(substr(text, CAST(i * {step} + 1 AS BIGINT), {size})) AS key
  FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1
                                  ELSE CAST(ceil((length(text) - {size}) / {float(step)}) AS BIGINT) + 1 END)) AS i FROM {src}))"""


# ------------------------------------------------------------------ F14, F15, F16


def _chunk_fixed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = K.chunk_fixed(d, "text", 4096, 1024)
    return c.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk")


register("f_chunk_fixed", sql=f"""
WITH {sql_chunks()}
SELECT doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, text AS chunk FROM chunks
""")(_chunk_fixed)


def _chunk_recursive(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return K.chunk_recursive(d, "doc_id", "text", 4096, 1024)


def sql_pieces(src: str, size: int = 4096) -> str:
    """``pieces(doc_id, text, ends)`` of ``src(doc_id, text)``: ends of the pieces
    into which the text is cut at separators."""
    out = "[text]"
    for sep in ("\\n\\n", "\\n", " "):
        out = (f"flatten(list_transform({out}, lambda p: CASE WHEN length(p) > {size} "
               f"THEN regexp_extract_all(p, '(?s)(?:.*?{sep}|.+)') ELSE [p] END))")
    out = (f"flatten(list_transform({out}, lambda p: CASE WHEN length(p) > {size} "
           f"THEN list_transform(range(1, length(p) + 1, {size}), lambda i: substr(p, i, {size})) ELSE [p] END))")
    lengths = f"list_transform(list_filter({out}, lambda p: p <> ''), lambda p: length(p))"
    return f"""cut AS (SELECT doc_id, text, {lengths} AS n FROM {src} WHERE length(text) > 0),
pieces AS (SELECT doc_id, text, n, list_transform(range(1, len(n) + 1), lambda i: CAST(list_sum(n[1:i]) AS BIGINT)) AS ends FROM cut)"""


register("f_chunk_recursive", sql=f"""
WITH RECURSIVE {sql_pieces('documents')},
walk AS (
  SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS begins, 0::BIGINT AS e, NULL::BIGINT AS a, NULL::BIGINT AS b FROM pieces
  UNION ALL
  SELECT doc_id, i + 1, list_append(CASE WHEN is_full THEN list_filter(begins, lambda x: e - x <= 1024 AND nxt - x <= 4096) ELSE begins END, e),
         nxt, CASE WHEN is_full THEN begins[1] END, CASE WHEN is_full THEN e END
  FROM (SELECT w.*, p.ends[w.i + 1] AS nxt, len(w.begins) > 0 AND p.ends[w.i + 1] - w.begins[1] > 4096 AS is_full
        FROM walk w JOIN pieces p USING (doc_id) WHERE w.i < len(p.ends))),
spans AS (SELECT doc_id, i, a, b FROM walk WHERE a IS NOT NULL
          UNION ALL SELECT w.doc_id, w.i + 1, w.begins[1], w.e FROM walk w JOIN pieces p USING (doc_id) WHERE w.i = len(p.ends))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_id, substr(text, a + 1, b - a) AS chunk
FROM spans JOIN pieces USING (doc_id)
""")(_chunk_recursive)


def _token_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tokenize("text").alias("toks"))
    w = d.select("doc_id", F.posexplode(K.token_windows("toks", 512, 384)).alias("win", "w"))
    return w.select("doc_id", F.col("win").cast("long").alias("win"), F.size("w").cast("long").alias("n_tokens"),
                    F.array_join("w", " ").alias("window"))


_SQL_WINDOWS = f"""t AS (SELECT doc_id, {D.tokens('text')} AS toks FROM documents),
n AS (SELECT doc_id, toks, CASE WHEN len(toks) = 0 THEN 0 WHEN len(toks) <= @L@ THEN 1
                                ELSE CAST(ceil((len(toks) - @L@) / @S@.0) AS BIGINT) + 1 END AS n FROM t),
w AS (SELECT doc_id, win, toks[win * @S@ + 1 : win * @S@ + @L@] AS w FROM (SELECT doc_id, toks, unnest(range(0, n)) AS win FROM n))"""


def _windows_sql(L: int, S: int, ids: bool = False) -> str:
    w = _SQL_WINDOWS.replace("@L@", str(L)).replace("@S@", str(S))
    if ids:
        w = w.replace(D.tokens('text'), f"list_transform({D.tokens('text')}, lambda x: CAST(('0x' || substr(md5(x), 1, 6)) AS BIGINT) % 30000)")
    return w

register("f_token_windows", sql=f"""
WITH {_windows_sql(512, 128)}
SELECT doc_id, CAST(win AS BIGINT) AS win, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS window FROM w
""")(_token_windows)


def _pad_mask(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", K.hashed_ids(tokenize("text")).alias("ids"))
    w = d.select("doc_id", F.posexplode(K.token_windows("ids", 64, 16)).alias("win", "w"))
    p = w.select("doc_id", "win", K.pad_truncate("w", 64, pad=0, label_pad=-100).alias("p"))
    return p.select("doc_id", F.col("win").cast("long").alias("win"), F.array_join("p.ids", " ").alias("ids"),
                    F.array_join("p.labels", " ").alias("labels"),
                    F.aggregate("p.mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"))


register("f_pad_mask", sql=f"""
WITH {_windows_sql(64, 48, ids=True)}
SELECT doc_id, CAST(win AS BIGINT) AS win,
       array_to_string(list_concat(w, list_transform(range(64 - len(w)), lambda x: 0)), ' ') AS ids,
       array_to_string(list_concat(w, list_transform(range(64 - len(w)), lambda x: -100)), ' ') AS labels,
       CAST(len(w) AS BIGINT) AS n_real FROM w
""")(_pad_mask)

# ------------------------------------------------------------------ J5, W2


def _vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    it = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    t = R.vector_topk(q, it, k=10)
    return t.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


register("j_vector_topk", sql="""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
           FROM embeddings a CROSS JOIN embeddings b)
SELECT qid, rank, id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s) WHERE rank <= 10
""")(_vector_topk)


def _vector_pruned(spark, sf):
    """The same search by clusters that bounds rule out."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = VI.cluster_vectors(e, scratch_path(spark, f"vectors-{uuid.uuid4().hex}"), "vec_id", "embedding")
    t = VI.search(e, index, 10, "vec_id", "embedding")
    return t.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


register("j_vector_pruned", sql=SQL["j_vector_topk"])(_vector_pruned)


def _w_topk(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "value")
    t = R.top_k_per_query(ev, "user_id", "value", "event_id", 3)
    return t.select("user_id", F.col("rank").cast("long").alias("rank"), "event_id", "value")


register("w_topk", sql="""
SELECT user_id, rank, event_id, value FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 6) DESC, event_id) AS rank FROM events)
WHERE rank <= 3
""")(_w_topk)

# ------------------------------------------------------------------ J6, M7, W4, W5, F25


def _doc_corpus(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("cid"), "text", "source",
                                                F.md5("text").alias("key"))


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _hybrid_fuse(spark, sf):
    corpus = _doc_corpus(spark, sf)
    idx = RT.build_index(corpus)
    hits = RT.retrieve_store(_questions(spark, sf), idx)
    top = R.top_k_per_query(hits, "qid", "fused", "cid", 10)
    return top.select("qid", F.col("rank").cast("long").alias("rank"), F.col("cid").alias("doc_id"), F.round("fused", 6).alias("fused"))


_SQL_DOCS_Q = """corpus AS (SELECT doc_id AS id, text, source, md5(text) AS key FROM documents),
qs AS (SELECT item_id AS qid, text FROM benchmark)"""

_SQL_FUSE = """
lists AS (SELECT qid, id, rank, 0.8 AS wt FROM vt UNION ALL SELECT qid, id, rank, 0.2 AS wt FROM bm),
lk AS (SELECT l.qid, l.id, l.rank, l.wt, c.key FROM lists l JOIN {corpus} c USING (id)),
fused AS (SELECT qid, key, sum(wt / (60 + rank)) AS fused, min(id) AS id FROM lk GROUP BY qid, key)"""

register("j_hybrid_fuse", sql=f"""
WITH {_SQL_DOCS_Q}, {sql_bm25('corpus', 'qs', 'bm')}, {sql_vec_topk('qs', 'corpus', 'vt')}, {_SQL_FUSE.format(corpus='corpus')}
SELECT qid, rank, id AS doc_id, round(fused, 6) AS fused FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 6) DESC, id) AS rank FROM fused) WHERE rank <= 10
""")(_hybrid_fuse)


def _rerank(spark, sf):
    corpus = _doc_corpus(spark, sf)
    qs = _questions(spark, sf)
    idx = R.bm25_index(corpus, "cid", "text").materialize()
    hits = R.bm25_topk(qs, idx, "qid", "text", 10)
    rr = R.idf_overlap_rerank(hits, R.query_terms(qs, "qid", "text"), idx, "qid", "doc_id")
    # hits without any shared term keep score 0
    scored = hits.select("qid", "doc_id").join(rr, ["qid", "doc_id"], "left").fillna(0.0, ["rerank_score"])
    top = R.top_k_per_query(scored, "qid", "rerank_score", "doc_id", 3)
    return top.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


register("m_rerank", sql=f"""
WITH {_SQL_DOCS_Q}, {sql_bm25('corpus', 'qs', 'bm')},
qterm AS (SELECT DISTINCT qid, term FROM bm_qt),
idf AS (SELECT d.term, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM bm_post GROUP BY term) d CROSS JOIN bm_st s),
rr AS (SELECT h.qid, h.id, coalesce(sum(i.idf), 0.0) AS rerank_score FROM bm h
       LEFT JOIN bm_post p ON p.id = h.id LEFT JOIN qterm q ON q.qid = h.qid AND q.term = p.term LEFT JOIN idf i ON i.term = q.term
       GROUP BY h.qid, h.id)
SELECT qid, rank, id AS doc_id, round(rerank_score, 6) AS rerank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 6) DESC, id) AS rank FROM rr) WHERE rank <= 3
""")(_rerank)


def _chat_history(spark, sf):
    c = table(spark, sf, "conversations")
    h = H.history_before(c, "conv_id", "turn")
    txt = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_history"), txt.alias("history_text"))


register("w_chat_history", sql="""
SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS n_history,
       coalesce(string_agg(role || ': ' || text, chr(10)) OVER w, '') AS history_text
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")(_chat_history)


def _bm25_top3(spark, sf):
    corpus = _doc_corpus(spark, sf)
    idx = R.bm25_index(corpus, "cid", "text").materialize()
    hits = R.bm25_topk(_questions(spark, sf), idx, "qid", "text", 3)
    return hits.join(corpus.withColumnRenamed("cid", "doc_id"), "doc_id")


def _sources(spark, sf):
    h = _bm25_top3(spark, sf).withColumn("type", F.lit("general"))
    return R.number_sources(h, "qid", "rank", "source", "text", "type")


register("w_sources", sql=f"""
WITH {_SQL_DOCS_Q}, {sql_bm25('corpus', 'qs', 'bm', k=3)}
SELECT bm.qid, CAST(bm.rank AS BIGINT) AS id, coalesce(c.source, 'N/A') AS source, substr(c.text, 1, 200) || '...' AS page_content_preview,
       'general' AS type FROM bm JOIN corpus c USING (id)
""")(_sources)


def _stuff_context(spark, sf):
    h = _bm25_top3(spark, sf)
    ctx = R.stuff_context(h, "qid", "rank", "text")
    q = _questions(spark, sf).join(ctx, "qid")
    return q.select("qid", C.render_prompt(PR.CONTEXT_TEMPLATE, context="context", question="text").alias("prompt"))


register("f_stuff_context", sql=f"""
WITH {_SQL_DOCS_Q}, {sql_bm25('corpus', 'qs', 'bm', k=3)},
ctx AS (SELECT bm.qid, string_agg(c.text, chr(10) || chr(10) ORDER BY bm.rank) AS context FROM bm JOIN corpus c USING (id) GROUP BY bm.qid)
SELECT q.qid, {D.render(PR.CONTEXT_TEMPLATE, context='ctx.context', question='q.text')} AS prompt FROM qs q JOIN ctx USING (qid)
""")(_stuff_context)

# ------------------------------------------------------------------ M6, M11, K7


def _embed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = R.embed(d, "doc_id", "text")
    return e.select("doc_id", F.posexplode("vec").alias("pos", "w")).select(
        "doc_id", F.col("pos").cast("long").alias("bk"), F.round("w", 6).alias("w")).filter(F.col("w") != 0)


register("m_embed", sql=f"""
WITH src AS (SELECT doc_id AS id, text FROM documents), {sql_hashemb('src', 'e')}
SELECT id AS doc_id, bk, round(w, 6) AS w FROM e WHERE round(w, 6) <> 0
""")(_embed)


def _store_chunks(spark, sf):
    d = table(spark, sf, "documents").withColumn(
        "store_type", F.when(F.col("lang") == "en", F.lit("general")).otherwise(F.lit("synthesis")))
    return RT.chunk_corpus(d, "doc_id", "text", extra=("source", "store_type"))


def _build_index(spark, sf):
    idx = RT.write_index(_store_chunks(spark, sf), scratch_path(spark, f"index-{uuid.uuid4().hex}"))
    # the chunks read back that have both their vector and their terms
    ch = idx.chunks.select("cid").join(idx.vectors.select("cid"), "cid", "left_semi")
    ch = ch.join(idx.bm25.lengths.select(F.col("doc_id").alias("cid")), "cid", "left_semi")
    m = RT.index_manifest(ch)
    return m.drop("embedding_model")


register("m_build_index", sql=f"""
WITH {sql_chunks()}
SELECT CAST(count(*) AS BIGINT) AS doc_chunks, CAST(1000 AS BIGINT) AS batch_size, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS num_batches,
       CAST(100000 AS BIGINT) AS shard_size, CAST(ceil(count(*) / 100000.0) AS BIGINT) AS num_shards FROM chunks
""")(_build_index)


def _index_shards(spark, sf):
    ch = _store_chunks(spark, sf).select("cid")
    s = C.sequence_after_sort(ch, "cid", 0, "seq").withColumn("shard_no", F.floor(F.col("seq") / 1000).cast("long"))
    return s.groupBy("shard_no").agg(F.count(F.lit(1)).alias("n"))


register("k_index_shards", sql=f"""
WITH {sql_chunks()}
SELECT shard_no, count(*) AS n FROM (
  SELECT CAST(floor((row_number() OVER (ORDER BY id) - 1) / 1000) AS BIGINT) AS shard_no FROM chunks) GROUP BY shard_no
""")(_index_shards)

# ------------------------------------------------------------------ M8 (flagship)

STORES = ("general", "synthesis")


def _routed(spark, sf):
    """Questions for both stores and for one that is missing; every third has
    the question before it as history."""
    q = _questions(spark, sf)
    text = F.when(F.col("qid") % 4 == 0, F.concat("text", F.lit(" Which catalyst works?"))).otherwise(F.col("text"))
    q = q.select("qid", text.alias("text"))
    route = F.when(F.col("qid") % 10 == 9, F.lit("patents")).otherwise(route_query(F.col("text")))
    history = q.select((F.col("qid") + 1).alias("qid"), F.col("text").alias("history_text")).filter("qid % 3 = 0")
    return q.withColumn("route", route), history


def _retrieve(spark, sf):
    ch = _store_chunks(spark, sf)
    stores = RT.build_store_indexes(ch, "store_type", STORES)
    questions, history = _routed(spark, sf)
    out = RT.retrieve(questions, stores, history=history)
    return out.select("qid", "id", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "source",
                      "page_content_preview", "type", "fused", "rerank_score", "prompt")


def _sql_retrieve() -> str:
    from papertrail.plans.q_text import _KW

    kw = _KW.replace("lower(q)", "lower(text)")
    ctes = [sql_chunks(),
            "asked AS (SELECT item_id AS qid, text || CASE WHEN item_id % 4 = 0 THEN ' Which catalyst works?' ELSE '' END AS text FROM benchmark)",
            f"""routed AS (SELECT a.qid, a.text AS question, CASE WHEN a.qid % 10 = 9 THEN 'patents' WHEN {kw.replace('text', 'a.text')} THEN 'synthesis'
       ELSE 'general' END AS route, CASE WHEN h.text IS NULL THEN '' ELSE h.text || chr(10) END || a.text AS text
FROM asked a LEFT JOIN asked h ON h.qid + 1 = a.qid AND a.qid % 3 = 0)"""]
    selects = []
    for s in STORES:
        ctes.append(f"c_{s} AS (SELECT * FROM chunks WHERE (CASE WHEN lang = 'en' THEN 'general' ELSE 'synthesis' END) = '{s}')")
        ctes.append(f"q_{s} AS (SELECT qid, text FROM routed WHERE route = '{s}')")
        ctes.append(sql_bm25(f"c_{s}", f"q_{s}", f"bm_{s}").strip())
        ctes.append(sql_vec_topk(f"q_{s}", f"c_{s}", f"vt_{s}").strip())
        ctes.append(_SQL_FUSE.format(corpus=f"c_{s}").replace("lists", f"lists_{s}").replace("lk", f"lk_{s}")
                    .replace("fused AS", f"fused_{s} AS").replace("FROM vt", f"FROM vt_{s}").replace("FROM bm", f"FROM bm_{s}").strip())
        ctes.append(f"""rr_{s} AS (SELECT f.qid, f.id, f.fused, coalesce(sum(i.idf), 0.0) AS score FROM fused_{s} f
  LEFT JOIN bm_{s}_post p ON p.id = f.id
  LEFT JOIN (SELECT DISTINCT qid, term FROM bm_{s}_qt) t ON t.qid = f.qid AND t.term = p.term
  LEFT JOIN (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM bm_{s}_df CROSS JOIN bm_{s}_st) i ON i.term = t.term
  GROUP BY f.qid, f.id, f.fused),
top_{s} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM rr_{s} QUALIFY rank <= 3),
ctx_{s} AS (SELECT t.qid, string_agg(c.text, chr(10) || chr(10) ORDER BY t.rank) AS context FROM top_{s} t JOIN c_{s} c ON c.id = t.id GROUP BY t.qid)""")
        selects.append(f"""SELECT t.qid, CAST(t.rank AS BIGINT) AS id, c.doc_id, CAST(c.chunk_id AS BIGINT) AS chunk_id, coalesce(c.source, 'N/A') AS source,
       substr(c.text, 1, 200) || '...' AS page_content_preview, '{s}' AS type, round(t.fused, 6) AS fused, round(t.score, 6) AS rerank_score,
       CASE WHEN t.rank = 1 THEN {D.render(PR.CONTEXT_TEMPLATE, context='x.context', question='r.question')} END AS prompt
FROM top_{s} t JOIN c_{s} c ON c.id = t.id JOIN ctx_{s} x ON x.qid = t.qid JOIN routed r ON r.qid = t.qid""")
    selects.append("""SELECT qid, NULL, NULL, NULL, NULL, route || ' RAG failed: index not found, please build the index first.', route, NULL, NULL, NULL
FROM routed WHERE route = 'patents'""")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(selects)


register("m_retrieve", sql=_sql_retrieve())(_retrieve)
