"""Index build (M11) and routed hybrid retrieval for a table of questions (M8).

Plan shape at scale
-------------------
* build: chunk (per-row generate) → embed (map-side (chunk, bucket)
  partial aggregate) → BM25 postings (map-side (chunk, term) partial
  aggregate).  All three are written once (Parquet in the shared folder)
  and reused by every question batch; the reference recomputes BM25 per
  question.
* retrieve: questions are few per batch; their terms and vectors are the
  only broadcast data (size checked).  BM25 joins postings by term on the
  map side; vector top-k is a per-partition NumPy product with partial
  top-k; fusion and top-k are per-question groupings of ≤ 2k rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.functions import prompts as PR
from papertrail.functions.text import route_query
from papertrail.operators import corpus as C
from papertrail.operators import retrieval as R
from papertrail.operators.chunk import chunk_fixed
from papertrail.sources import sinks as SK

CHUNK_SIZE = 4096
CHUNK_OVERLAP = 1024
CHUNKS_PER_DOC = 1 << 20
K_EACH = 10
TOP_N = 3
WEIGHTS = {"vector": 0.8, "bm25": 0.2}
RRF_C = 60


@dataclass
class StoreIndex:
    """Chunks of one store with their vectors and BM25 index."""

    chunks: DataFrame  # cid, doc_id, chunk_id, store_type, source, text, key
    vectors: DataFrame  # cid, vec
    bm25: R.Bm25Index


def chunk_corpus(docs: DataFrame, id_col: str, text: str, extra=(), size: int = CHUNK_SIZE,
                 overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks with a composite id ``cid = doc_id * 2**20 + chunk_id`` (a text of
    Spark's greatest size, 2 GB, has fewer chunks than that) and a content key
    (md5 of the chunk text) used to merge equal texts."""
    c = chunk_fixed(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"), *extra), "_text", size, overlap)
    c = c.drop("_text").withColumnRenamed("chunk", "text")
    return (c.withColumn("cid", F.col("doc_id") * CHUNKS_PER_DOC + F.col("chunk_id"))
             .withColumn("key", F.md5("text")))


def build_index(chunks: DataFrame, dims: int = 64, embed_fn=None, materialize: bool = True) -> StoreIndex:
    """Vectors and BM25 index of the chunks from one tokenisation.

    With ``materialize`` (default) the per-chunk term table is
    checkpointed to the shared checkpoint folder: BM25 statistics,
    postings and the default embedding all read it instead of
    re-tokenising.  A pluggable ``embed_fn`` embeds the chunk texts in
    Arrow batches instead."""
    bm = R.bm25_index(chunks, "cid", "text")
    if materialize:
        bm = bm.materialize()
    if embed_fn is None:
        vec = R.embedding_from_terms(bm.doc_terms, dims).withColumnRenamed("doc_id", "cid")
    else:
        vec = R.embed(chunks.select("cid", "text"), "cid", "text", fn=embed_fn, dims=dims).select("cid", "vec")
    return StoreIndex(chunks, vec, bm)


def write_index(chunks: DataFrame, path: str, dims: int = 64, shard_size: int = 100_000) -> StoreIndex:
    """Build the index of ``chunks`` below ``path`` and return it as read back:
    ``shards`` and ``manifest`` (save_index), ``terms`` (Bm25Index.save) and
    ``vectors``."""
    SK.save_index(chunks, path, "cid", shard_size)
    saved = read_chunks(chunks.sparkSession, path, chunks.schema)
    R.bm25_index(saved, "cid", "text").save(f"{path}/terms")
    terms = R.Bm25Index.load(chunks.sparkSession, f"{path}/terms").doc_terms
    R.embedding_from_terms(terms, dims).withColumnRenamed("doc_id", "cid").write.mode("overwrite").parquet(f"{path}/vectors")
    return read_index(chunks.sparkSession, path, chunks.schema)


def read_chunks(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/shards").select(*schema.names)


def read_index(spark, path: str, schema) -> StoreIndex:
    """The index that :func:`write_index` or :func:`refresh_index` left at
    ``path``; ``schema`` is that of its chunks."""
    return StoreIndex(read_chunks(spark, path, schema), spark.read.parquet(f"{path}/vectors"),
                      R.Bm25Index.load(spark, f"{path}/terms"))


def refresh_index(old: StoreIndex, delta: DataFrame, docs: DataFrame, path: str, chunk_fn, path_col: str = "source",
                  dims: int = 64, shard_size: int = 100_000) -> StoreIndex:
    """``old`` brought up to date with ``delta`` (path, action; T2) and written
    to the new folder ``path``.  Chunks, terms and vectors of removed and changed
    paths are dropped; only the ``docs`` of new and changed paths are chunked
    (``chunk_fn``), tokenised and embedded."""
    spark = docs.sparkSession
    at = lambda *actions: delta.filter(F.col("action").isin(*actions)).select(F.col("path").alias(path_col)).distinct()
    gone = at("removed", "changed")
    kept = old.chunks.join(gone, path_col, "left_anti")
    lost = old.chunks.join(gone, path_col, "left_semi").select("cid")
    fresh = chunk_fn(docs.join(at("new", "changed"), path_col, "left_semi")).select(*old.chunks.columns).checkpoint()
    SK.save_index(kept.unionByName(fresh), path, "cid", shard_size)
    terms = R.bm25_index(fresh, "cid", "text").materialize().doc_terms
    vectors = R.embedding_from_terms(terms, dims).withColumnRenamed("doc_id", "cid")
    R.Bm25Index(old.bm25.doc_terms.join(lost.withColumnRenamed("cid", "doc_id"), "doc_id", "left_anti").unionByName(terms)).save(f"{path}/terms")
    old.vectors.join(lost, "cid", "left_anti").unionByName(vectors).write.mode("overwrite").parquet(f"{path}/vectors")
    return read_index(spark, path, old.chunks.schema)


def build_store_indexes(chunks: DataFrame, store_col: str, stores, dims: int = 64) -> dict:
    """One tokenisation and one checkpoint for all stores; each store's
    index is a filter of the shared term table (its BM25 statistics are
    computed over its own chunks only)."""
    chunks = chunks.checkpoint()
    shared = R.bm25_index(chunks, "cid", "text", keep=(store_col,)).materialize()
    out = {}
    for s in stores:
        bm = R.Bm25Index(shared.doc_terms.filter(F.col(store_col) == s), True)
        vec = R.embedding_from_terms(bm.doc_terms, dims).withColumnRenamed("doc_id", "cid")
        out[s] = StoreIndex(chunks.filter(F.col(store_col) == s), vec, bm)
    return out


def index_manifest(chunks: DataFrame, batch_size: int = 1000, shard_size: int = 100_000,
                   embedding_model: str = "hashed-bow-64") -> DataFrame:
    """One-row manifest: chunk count, embedding batches and shards."""
    n = F.count(F.lit(1))
    return chunks.agg(n.alias("doc_chunks")).select(
        F.lit(embedding_model).alias("embedding_model"), F.col("doc_chunks").cast("long").alias("doc_chunks"),
        F.lit(batch_size).cast("long").alias("batch_size"),
        F.ceil(F.col("doc_chunks") / F.lit(batch_size)).cast("long").alias("num_batches"),
        F.lit(shard_size).cast("long").alias("shard_size"),
        F.ceil(F.col("doc_chunks") / F.lit(shard_size)).cast("long").alias("num_shards"))


def retrieve_store(questions: DataFrame, idx: StoreIndex, k: int = K_EACH, dims: int = 64,
                   embed_fn=None) -> DataFrame:
    """(qid, key, cid, fused) for one store: vector and BM25 top-k fused
    by weighted reciprocal rank on the content key."""
    bm = R.bm25_topk(questions, idx.bm25, qid="qid", qtext="text", k=k).select("qid", F.col("doc_id").alias("cid"), "rank")
    qv = R.embed(questions.select("qid", "text"), "qid", "text", fn=embed_fn, dims=dims).select("qid", "vec")
    vt = R.vector_topk(qv, idx.vectors, k=k, qid="qid", qvec="vec", iid="cid", ivec="vec").select("qid", F.col("id").alias("cid"), "rank")
    # at most 2 k rows a question: they meet the chunks' keys by broadcast, and one
    # pass fuses both lists and picks the chunk that stands for equal texts
    lists = {"vector": vt, "bm25": bm}
    parts = [df.withColumn("_w", F.lit(WEIGHTS[name]) / (F.lit(RRF_C) + F.col("rank"))) for name, df in lists.items()]
    hits = R.attach_docs(parts[0].unionByName(parts[1]).checkpoint(), idx.chunks.select("cid", "key"), "cid")
    return hits.groupBy("qid", "key").agg(F.sum("_w").alias("fused"), F.min("cid").alias("cid"))


def retrieve(questions: DataFrame, stores: dict, top_n: int = TOP_N, k: int = K_EACH, dims: int = 64,
             embed_fn=None, history: DataFrame | None = None, rerank_fn=None) -> DataFrame:
    """Routed hybrid retrieval for a table of questions (qid, text).

    route (a ``route`` column, else keywords) → per-store retrieval → fuse →
    rerank to ``top_n`` (``rerank_fn`` on (question, passage) pairs, else idf
    overlap) → numbered sources with previews; the first source of a question
    carries the prompt with its context.  A question routed to a missing store
    gets one row with an error text and no sources.  ``history``
    (qid, history_text) is put before the question for retrieval.
    """
    q = questions if "route" in questions.columns else questions.withColumn("route", route_query(F.col("text")))
    q = q.withColumn("question", F.col("text"))
    if history is not None:
        q = q.join(history, "qid", "left").withColumn(
            "text", F.concat_ws("\n", F.col("history_text"), F.col("text"))).drop("history_text")
    q = q.checkpoint()
    parts = []
    for name, idx in stores.items():
        qs = q.filter(F.col("route") == name).select("qid", "text")
        hits = retrieve_store(qs, idx, k, dims, embed_fn).withColumn("rank", F.lit(0)).checkpoint()  # at most 2 k a question
        if rerank_fn is not None:
            hits = R.attach_docs(hits, idx.chunks.select("cid", F.col("text").alias("passage")), "cid").join(
                qs.withColumnRenamed("text", "asked"), "qid")
        top = R.rerank(hits, "asked", "passage", fn=rerank_fn, top_n=top_n, index=idx.bm25, queries=qs).select(
            "qid", "cid", "rank", "fused", "rerank_score").checkpoint()
        src = R.attach_docs(top, idx.chunks.select("cid", "doc_id", "chunk_id", "source", "text"), "cid")
        parts.append(src.withColumn("type", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.checkpoint()  # top_n rows a question
    context = R.stuff_context(out, "qid", "rank", "text").join(q.select("qid", "question"), "qid")
    prompts = context.select("qid", C.render_prompt(PR.CONTEXT_TEMPLATE, context="context", question="question").alias("prompt"))
    first = F.col("rank") == 1
    sources = out.join(prompts, "qid").select(
        "qid", F.col("rank").cast("long").alias("id"), "doc_id", "chunk_id", F.coalesce("source", F.lit("N/A")).alias("source"),
        F.concat(F.substring("text", 1, 200), F.lit("...")).alias("page_content_preview"), "type",
        F.round("fused", 6).alias("fused"), F.round("rerank_score", 6).alias("rerank_score"),
        F.when(first, F.col("prompt")).alias("prompt"))
    error = F.concat(F.col("route"), F.lit(" RAG failed: index not found, please build the index first."))
    missing = q.filter(~F.col("route").isin(*stores.keys())).select(
        "qid", error.alias("page_content_preview"), F.col("route").alias("type"))
    return sources.unionByName(missing, allowMissingColumns=True)
