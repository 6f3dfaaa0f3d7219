"""The index refreshed in place (T2, M11) as a query: two refreshes of an
older corpus must give the index of `documents` as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papertrail.plans import duck as D
from papertrail.plans import retrieve as RT
from papertrail.plans import versions as V
from papertrail.plans.q_search import sql_chunks
from papertrail.plans.registry import register
from papertrail.session import scratch_path, table


SHARD = 10_000  # some 40 MB of text


def history(docs):
    """The corpus at three times, the last of which is ``docs`` itself.  All that
    changes lies in the tenth of the ids where the others are left alone: texts
    are edited, documents come, and old ones (negative ids) go."""
    low = docs.agg(F.max("doc_id") / 10).scalar()
    d = docs.select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"))
    busy, kind = F.col("doc_id") < low, F.col("doc_id") % 5
    gone = d.filter(busy & (kind == 3)).select((-1 - F.col("doc_id")).alias("doc_id"), "text", F.concat(F.lit("gone/"), "source").alias("source"))
    out = []
    for time in (0, 1, 2):
        edited = busy & (kind == 1) & (F.lit(time) < 1 + F.col("doc_id") % 2)
        missing = busy & (kind == 2) & (F.lit(time) < 1 + F.col("doc_id") % 2)
        now = d.filter(~missing).withColumn("mtime", F.when(busy & (kind == 1) & ~edited, F.lit(1)).otherwise(F.lit(0)))
        now = now.withColumn("text", F.when(edited, F.concat(F.lit("as it was: "), F.substring("text", 1, 500))).otherwise(F.col("text")))
        still = gone.filter(F.lit(time) < 1 - F.col("doc_id") % 2).withColumn("mtime", F.lit(0))
        out.append(now.unionByName(still))
    return out


def chunks_of(docs):
    return RT.chunk_corpus(docs, "doc_id", "text", extra=("source", "mtime"))


def _refresh_index(spark, sf):
    first, *later = history(table(spark, sf, "documents"))
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    chunks = chunks_of(first)
    V.create_index(chunks, path, shard_size=SHARD)
    for docs in later:
        V.drop_versions(spark, path, V.refresh(spark, path, docs, chunks_of, chunks.schema, shard_size=SHARD))
    idx = V.open_index(spark, path, chunks.schema)
    row = lambda kind, name, n, digest: [F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"), digest.alias("digest")]
    none = F.lit("")
    of_chunk = idx.bm25.doc_terms.select(F.col("doc_id").alias("cid"), "dl")
    out = idx.chunks.select("cid", "key").join(of_chunk, "cid").select(*row("chunk", F.col("cid").cast("string"), F.col("dl"), F.col("key")))
    out = out.unionByName(idx.vectors.select(*row("vector", F.col("cid").cast("string"), F.size(F.filter("vec", lambda x: x != 0)), none)))
    out = out.unionByName(idx.bm25.doc_freq().select(*row("term", F.col("term"), F.col("df"), none)))
    total = spark.range(1).select(F.explode(F.create_map(F.lit("chunks"), idx.bm25.n_docs, F.lit("words"), F.lit(idx.bm25.length))).alias("k", "v"))
    return out.unionByName(total.select(*row("total", F.col("k"), F.col("v"), none)))


register("t_refresh_index", sql=f"""
WITH {sql_chunks()},
toks AS (SELECT id, unnest({D.tokens('text')}) AS term FROM chunks),
per AS (SELECT id, count(*) AS dl, count(DISTINCT CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64) AS buckets FROM toks GROUP BY id),
whole AS (SELECT id, key, coalesce(dl, 0) AS dl, coalesce(buckets, 0) AS buckets FROM chunks LEFT JOIN per USING (id))
SELECT 'chunk' AS kind, CAST(id AS VARCHAR) AS name, dl AS n, key AS digest FROM whole
UNION ALL SELECT 'vector', CAST(id AS VARCHAR), buckets, '' FROM whole
UNION ALL SELECT 'term', term, count(DISTINCT id), '' FROM toks GROUP BY term
UNION ALL SELECT 'total', 'chunks', count(*), '' FROM whole
UNION ALL SELECT 'total', 'words', CAST(sum(dl) AS BIGINT), '' FROM whole
""")(_refresh_index)
