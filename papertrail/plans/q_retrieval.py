"""Registered retrieval queries (BM25, vectors, fusion, sources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.operators import retrieval as R
from papertrail.plans.registry import register
from papertrail.session import table


def duck_tokens(x: str) -> str:
    """DuckDB form of :func:`papertrail.functions.text.tokenize` (before
    dropping empty strings)."""
    return f"regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+')"


_SQL_BM25_BASE = f"""
WITH toks AS (
  SELECT doc_id, unnest({duck_tokens('text')}) AS term FROM documents
), dl AS (
  SELECT d.doc_id, coalesce(c.dl, 0) AS dl
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS dl FROM toks WHERE term <> '' GROUP BY doc_id) c
  USING (doc_id)
), post AS (
  SELECT doc_id, term, count(*) AS tf FROM toks WHERE term <> '' GROUP BY doc_id, term
), stats AS (
  SELECT count(*) AS n, avg(dl) AS avgdl FROM dl
)"""


def _bm25(spark, sf):
    docs = table(spark, sf, "documents")
    qs = table(spark, sf, "benchmark")
    idx = R.bm25_index(docs, "doc_id", "text").materialize()
    top = R.bm25_topk(qs, idx, qid="item_id", qtext="text", k=10)
    return top.select(F.col("qid").alias("item_id"), F.col("rank").cast("long").alias("rank"),
                      "doc_id", F.round("score", 6).alias("score"))


register("f_bm25_topk", sql=_SQL_BM25_BASE + f""",
qt AS (
  SELECT qid, term, count(*) AS qtf FROM (
    SELECT item_id AS qid, unnest({duck_tokens('text')}) AS term FROM benchmark) WHERE term <> ''
  GROUP BY qid, term
), dfq AS (
  SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term
), sc AS (
  SELECT qt.qid, p.doc_id,
         sum(qt.qtf * ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.5
             / (p.tf + 1.5 * (0.25 + 0.75 * dl.dl / s.avgdl))) AS score
  FROM qt JOIN dfq f USING (term) JOIN post p USING (term) JOIN dl USING (doc_id) CROSS JOIN stats s
  GROUP BY qt.qid, p.doc_id
)
SELECT qid AS item_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc)
WHERE rank <= 10
""")(_bm25)


def _bm25_stats(spark, sf):
    st = R.bm25_stats(table(spark, sf, "documents"), "doc_id", "text")
    return st.select("term", F.col("df").cast("long").alias("df"), F.col("n_docs").cast("long").alias("n_docs"),
                     F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


register("a_bm25_stats", sql=_SQL_BM25_BASE + """
SELECT term, count(*) AS df, s.n AS n_docs, round(s.avgdl, 6) AS avgdl,
       round(ln(1 + (s.n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
FROM post CROSS JOIN stats s GROUP BY term, s.n, s.avgdl
""")(_bm25_stats)
