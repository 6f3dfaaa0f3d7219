"""Lexical and vector retrieval over chunk tables.

Scale notes
-----------
* BM25 statistics are built once into a postings table (``doc_id, term,
  tf``) plus a document-length table; the per-question work is a join of
  the (small, size-checked, broadcast) question terms against postings,
  so no shuffle by term is needed even for terms that occur in a third
  of all documents.
* Exact vector top-k never forms the query × chunk product as rows: each
  chunk partition computes a partial top-k per query with one matrix
  product (Arrow batch, NumPy) against the broadcast, size-checked query
  block, and only ``k`` rows per query and partition reach the final
  window.  Query sets above the broadcast bound are processed in blocks.
* Top-k per query uses ``row_number() <= k``; Catalyst plans a partial
  ``WindowGroupLimit`` before the exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.functions._col import col_of, let
from papertrail.functions.text import tokenize
from papertrail.operators.sizing import checked_broadcast, has_at_most

# ------------------------------------------------------------------ top-k


def top_k_per_query(df: DataFrame, query, score, id_col, k: int, rank_col: str = "rank",
                    digits: int | None = 6) -> DataFrame:
    """Keep the ``k`` best rows per query by score (desc), ties by id (asc).

    Scores are ranked after rounding to ``digits`` so that engines that
    sum floats in different orders agree on the order.
    """
    s = F.round(col_of(score), digits) if digits is not None else col_of(score)
    w = Window.partitionBy(col_of(query)).orderBy(s.desc(), col_of(id_col).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# ------------------------------------------------------------------ BM25


@dataclass
class Bm25Index:
    """One row per document: (doc_id, dl, tfs ARRAY<STRUCT<term, tf>>).

    Postings, document lengths and the hashed embedding are all derived
    from this table, so the corpus is tokenised once.  When a question
    batch is scored against an unmaterialised index, the question
    vocabulary is semi-joined to the postings on the map side.
    :meth:`materialize` checkpoints the table (shared
    ``spark.checkpoint.dir``) for indexes that serve several readers.
    """

    doc_terms: DataFrame
    ready: bool = False  # checkpointed or read from files: reading it again is cheap

    @property
    def postings(self) -> DataFrame:
        """(doc_id, term, tf, dl): a per-row generate, no shuffle."""
        # explode_outer + null filter: a plain explode makes Catalyst add a
        # size(array) > 0 filter that re-evaluates the array expression
        return (self.doc_terms.select("doc_id", "dl", F.explode_outer("tfs").alias("p"))
                .filter(F.col("p").isNotNull()).select("doc_id", "p.term", "p.tf", "dl"))

    @property
    def lengths(self) -> DataFrame:
        return self.doc_terms.select("doc_id", "dl")

    @property
    def n_docs(self) -> Column:
        return self.doc_terms.select(F.count(F.lit(1))).scalar()

    @property
    def avgdl(self) -> Column:
        return self.doc_terms.select(F.avg("dl")).scalar()

    def doc_freq(self) -> DataFrame:
        """term, df: number of documents containing the term.
        Partial aggregation collapses each partition to its vocabulary
        before the shuffle."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def materialize(self) -> "Bm25Index":
        return self if self.ready else Bm25Index(self.doc_terms.checkpoint(eager=True), True)

    def save(self, path: str, mode: str = "overwrite") -> None:
        self.doc_terms.write.mode(mode).parquet(path)

    @staticmethod
    def load(spark, path: str) -> "Bm25Index":
        return Bm25Index(spark.read.parquet(path), True)


def term_freqs(tokens) -> Column:
    """ARRAY<STRUCT<term, tf>> of a token array, computed inside the row:
    sort, find the run starts, run length = tf.  O(n log n) per document
    and no shuffle."""
    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                          lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1)))

        def pairs(st):
            return F.transform(st, lambda x, j: F.struct(
                F.element_at(s, x).alias("term"),
                (F.coalesce(F.try_element_at(st, j + 2), n + 1) - x).cast("long").alias("tf")))
        return F.when(n > 0, let(starts, pairs)).otherwise(
            F.array().cast("array<struct<term:string,tf:bigint>>"))
    return let(F.array_sort(col_of(tokens)), runs)


def bm25_index(df: DataFrame, id_col: str, text_col: str, keep=()) -> Bm25Index:
    """Tokenise once; term frequencies are counted inside each document's
    row (:func:`term_freqs`), so the index stays partitioned by document —
    no (doc, term) shuffle at all.  ``keep`` carries extra columns (e.g. a
    store name) so that one index can be filtered into several."""
    toks = df.select(F.col(id_col).alias("doc_id"), *keep, tokenize(F.col(text_col)).alias("toks"))
    return Bm25Index(toks.select("doc_id", *keep, F.coalesce(F.size("toks"), F.lit(0)).cast("long").alias("dl"),
                                 term_freqs("toks").alias("tfs")))


def bm25_stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per term: df, idf, with corpus N and average length."""
    idx = bm25_index(df, id_col, text_col)
    idx = idx.materialize()
    n, avgdl = idx.doc_terms.agg(F.count(F.lit(1)), F.avg("dl")).first()
    return (idx.doc_freq().withColumn("n_docs", F.lit(n)).withColumn("avgdl", F.lit(avgdl))
            .withColumn("idf", _idf(F.lit(n), F.col("df"))))


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def query_terms(queries: DataFrame, qid: str, qtext: str) -> DataFrame:
    """(qid, term, qtf): each occurrence of a term in the question counts."""
    return (queries.select(F.col(qid).alias("qid"), F.explode_outer(tokenize(F.col(qtext))).alias("term"))
            .filter(F.col("term").isNotNull()).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def bm25_scores(queries: DataFrame, index: Bm25Index, qid: str = "qid", qtext: str = "text",
                k1: float = 1.5, b: float = 0.75, max_broadcast_terms: int = 2_000_000) -> DataFrame:
    """(qid, doc_id, score) for every document sharing a term with the query.

    Okapi BM25 with idf = ln(1 + (N - n + 0.5) / (n + 0.5)).
    """
    qt = query_terms(queries, qid, qtext)
    # the question side is bounded by (#questions × terms per question);
    # its size is checked once and both derived tables follow the verdict
    small = has_at_most(qt, max_broadcast_terms)
    bc = F.broadcast if small else (lambda d: d)
    vocab = bc(qt.select("term").distinct())
    # postings of question terms only (semi join pushed below the aggregate)
    rel = index.postings.join(vocab, "term", "left_semi")
    q_df = rel.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = index.n_docs, index.avgdl
    qw = bc(qt.join(q_df, "term").withColumn("idf", _idf(n, F.col("df"))).select("qid", "term", "qtf", "idf"))
    p = rel.join(qw, "term")
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    contrib = F.col("qtf") * F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / norm
    return p.groupBy("qid", "doc_id").agg(F.sum(contrib).alias("score"))


def bm25_topk(queries: DataFrame, index: Bm25Index, qid: str = "qid", qtext: str = "text", k: int = 10,
              k1: float = 1.5, b: float = 0.75, block_rows: int = 256) -> DataFrame:
    """(qid, doc_id, score, rank) best ``k`` documents per question.

    Questions go to the tasks in blocks of at most ``block_rows``: a table of
    their terms and weights, bounded by the block.  Every index partition
    scores its documents in place, from the term frequencies in their rows,
    and passes on ``k`` rows per question (more only where scores tie), so no
    (question, document) pairs are shuffled.
    """
    spark = queries.sparkSession
    index = index.materialize()  # read three times below
    qt = query_terms(queries, qid, qtext).checkpoint()
    df_of = index.postings.join(checked_broadcast(qt.select("term").distinct(), 2_000_000), "term", "left_semi") \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df")).checkpoint()
    n_docs, avgdl = index.doc_terms.agg(F.count(F.lit(1)), F.avg("dl")).first()
    schema = T.StructType([T.StructField("qid", qt.schema["qid"].dataType),
                           T.StructField("doc_id", index.doc_terms.schema["doc_id"].dataType),
                           T.StructField("score", T.DoubleType())])
    parts = []
    for block in _bounded_blocks(qt.select("qid").distinct(), "qid", block_rows):
        rows = qt.join(F.broadcast(block), "qid").join(df_of, "term").collect()  # the terms of one block
        sent = spark.sparkContext.broadcast(_term_weights(rows, n_docs))
        score = _bm25_partial_fn(k, sent, k1, b, avgdl or 1.0)
        parts.append(index.doc_terms.select("doc_id", "dl", "tfs").mapInArrow(score, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k_per_query(out, "qid", "score", "doc_id", k)


def _term_weights(rows, n_docs: int) -> tuple:
    """(question ids, term → row, matrix of qtf * idf: terms x questions)."""
    import numpy as np

    qids = sorted({r["qid"] for r in rows})
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    at = {q: i for i, q in enumerate(qids)}
    w = np.zeros((len(terms), len(qids)))
    for r in rows:
        w[terms[r["term"]], at[r["qid"]]] = r["qtf"] * math.log(1.0 + (n_docs - r["df"] + 0.5) / (r["df"] + 0.5))
    return qids, terms, w


def _bm25_partial_fn(k: int, sent, k1: float, b: float, avgdl: float, rows: int = 256):
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        qids, terms, w = sent.value
        known = pa.array(list(terms), pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows if qids else 0, rows):
                part = whole.slice(start, rows)
                dl, lists = part.column(1).to_numpy().astype("float64"), part.column(2)
                ends = np.asarray(lists.offsets).astype("int64")
                flat = lists.flatten()
                term = pc.fill_null(pc.index_in(flat.field("term"), value_set=known), -1).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(term >= 0)
                doc = np.repeat(np.arange(len(dl)), np.diff(ends))[keep]
                tf = flat.field("tf").to_numpy().astype("float64")[keep]
                part_of = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl[doc] / avgdl))
                scores = np.zeros((len(dl), len(qids)))
                if len(doc):
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    scores[doc[first]] = np.add.reduceat(part_of[:, None] * w[term[keep]], first, axis=0)
                q, d = best_cells(scores.T, k, positive=True)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q]), part.column(0).take(pa.array(d)),
                                                      pa.array(scores[d, q])], ["qid", "doc_id", "score"])
    return fn


def best_cells(scores, k: int, positive: bool = False) -> tuple:
    """(row, column) of the ``k`` best cells of each row and all within 1e-6 of
    the k-th: ties are settled downstream on the rounded score, then the id."""
    import numpy as np

    bar = np.full(len(scores), -np.inf)
    if k < scores.shape[1]:
        bar = np.partition(scores, -k, axis=1)[:, -k] - 1e-6
    ok = scores >= bar[:, None]
    return np.nonzero(ok & (scores > 0) if positive else ok)


# ------------------------------------------------------------------ vectors


def l2_normalize(c) -> Column:
    """Unit vector (F22); a zero vector stays zero."""
    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return let(col_of(c), unit)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


CELLS = 1 << 20  # scores that a task holds at once
HELD = 1 << 18  # candidates that a task holds


def best_so_far(q, score, pos, k: int, bar):
    """Indices of the candidates that may be among the ``k`` best of their
    query, given those seen; raises ``bar`` to the k-th best scores.  ``pos`` is
    the order of the ids: of equal scores of a query the k first suffice."""
    import numpy as np

    order = np.lexsort((pos, -score, q))
    q, score = q[order], score[order]
    first = np.append(True, q[1:] != q[:-1])
    at = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    kth = at == k - 1
    bar[q[kth]] = np.maximum(bar[q[kth]], score[kth])
    new = first | np.append(True, score[1:] != score[:-1])
    run = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    return order[(run < k) & (score >= bar[q] - 1e-6)]


def _partial_topk_fn(k: int, bc, qid_type, held_rows: int = HELD, cells: int = CELLS):
    """Every task's candidates: the ``k`` best of each query and all within
    1e-6 of the k-th.  Memory is bounded by ``cells`` and ``held_rows``; should
    more than those come close to the k-th, they are passed on early."""
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        qids, qmat = bc.value
        if not len(qids):
            return
        names = pa.array(qids, qid_type)
        bar = np.full(len(qids), -np.inf)
        step = max(1, cells // len(qids))
        held, n_held = [], 0

        def packed():
            q, score = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            ids = pa.concat_arrays([h[2] for h in held])
            pos = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            keep = best_so_far(q, score, pos, k, bar)
            return q[keep], score[keep], ids.take(pa.array(keep))

        def out(q, score, ids):
            for at in range(0, len(q), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[part])), ids[part], pa.array(score[part])],
                                                 ["qid", "id", "score"])

        for b in batches:
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                vec = part.column(1)
                if vec.null_count:
                    raise ValueError("a vector is null")
                m = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                whole = ~np.isnan(m).any(axis=1)
                if not whole.all():  # no score, no rank
                    part, m = part.filter(pa.array(whole)), m[whole]
                scores = qmat @ m.T  # (n_queries, step)
                ok = scores >= bar[:, None] - 1e-6
                many = np.flatnonzero(ok.sum(1) > k)
                if len(many):
                    some = scores[many]
                    bar[many] = np.maximum(bar[many], np.partition(some, -k, axis=1)[:, -k])
                    ok[many] = some >= bar[many][:, None] - 1e-6
                    del some
                for rows in np.array_split(np.arange(len(qids)), max(1, -(-int(ok.sum()) // held_rows))):
                    q, i = np.nonzero(ok[rows[0]:rows[-1] + 1]) if len(rows) else (rows, rows)
                    if not len(q):
                        continue
                    q = q + rows[0]
                    held.append((q.astype("int32"), scores[q, i], part.column(0).take(pa.array(i))))
                    n_held += len(q)
                    if n_held > held_rows:
                        held = [packed()]
                        n_held = len(held[0][0])
                        if n_held > held_rows // 2:
                            yield from out(*held[0])
                            held, n_held = [], 0
        if held:
            yield from out(*packed())
    return fn


def _bounded_blocks(df: DataFrame, key: str, max_rows: int, seed: int = 0) -> list:
    if has_at_most(df, max_rows):
        return [df]
    n = df.count()
    nblk = max(2, ceil_div(2 * n, max_rows))
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(nblk))
    out = []
    for bi in range(nblk):
        out.extend(_bounded_blocks(df.filter(h == bi), key, max_rows, seed + 1))
    return out


def vector_topk(queries: DataFrame, items: DataFrame, k: int = 10, qid: str = "qid", qvec: str = "vec",
                iid: str = "id", ivec: str = "vec", block_rows: int = 4096) -> DataFrame:
    """Exact inner-product top-k of every query among ``items``.

    Query vectors are shipped to the tasks in blocks of at most
    ``block_rows`` (the only broadcast; its size is fixed by the block
    bound, not by the data).  Each item partition yields a partial top-k
    per query; a final ``row_number`` window keeps ``k``.  A task scores its
    items in slices and keeps candidates in bounded memory, however many
    items and equal scores there are.
    """
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    spark = queries.sparkSession
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec"))
    it = items.select(F.col(iid).alias("id"), F.col(ivec).alias("vec"))
    schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType),
                           T.StructField("id", it.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    # ship queries in blocks of proven size: hash-split until every block
    # holds at most block_rows rows (qids are unique, so this terminates)
    blocks = _bounded_blocks(q, "qid", block_rows)
    parts = []
    for blk in blocks:
        rows = blk.collect()  # at most block_rows query vectors
        qids = [r["qid"] for r in rows]
        qmat = np.array([list(r["vec"]) for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
        bc = spark.sparkContext.broadcast((qids, qmat))
        fn = _partial_topk_fn(k, bc, to_arrow_type(schema["qid"].dataType))
        parts.append(it.mapInArrow(fn, schema))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    return top_k_per_query(cand, "qid", "score", "id", k)


# ------------------------------------------------------------------ fusion


def fuse(ranked: dict, weights: dict, c: int = 60, key: str = "chunk_key", query: str = "qid") -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists.

    ``ranked`` maps a retriever name to a DataFrame (query, key, rank).
    fused = Σ w / (c + rank); a list that misses the key adds 0.  The
    union + groupBy form is the full outer join of all lists without
    materialising nulls.
    """
    parts = [df.select(F.col(query).alias(query), F.col(key).alias(key),
                       (F.lit(float(weights[name])) / (F.lit(c) + F.col("rank"))).alias("_w"))
             for name, df in ranked.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(query, key).agg(F.sum("_w").alias("fused"))


def number_sources(hits: DataFrame, query: str, rank: str, source: str, text: str, typ: str,
                   preview: int = 200) -> DataFrame:
    """id (1-based), source or "N/A", first ``preview`` chars + "...", type."""
    return hits.select(col_of(query).alias(query if isinstance(query, str) else "qid"),
                       col_of(rank).cast("long").alias("id"),
                       F.coalesce(col_of(source), F.lit("N/A")).alias("source"),
                       F.concat(F.substring(col_of(text), 1, preview), F.lit("...")).alias("page_content_preview"),
                       col_of(typ).alias("type"))


def stuff_context(hits: DataFrame, query: str, rank: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Retrieved texts joined in rank order, one row per query.

    Only the top-n hits of each query reach this aggregate (n is the
    rerank depth), so the collected list is bounded.
    """
    return (hits.groupBy(query)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col_of(rank).alias("r"),
                                                                                  col_of(text).alias("t")))),
                                          lambda s: s["t"]), sep).alias("context")))


def idf_overlap_rerank(hits: DataFrame, qterms: DataFrame, index: Bm25Index, qid: str, doc: str,
                       top_n: int = 3) -> DataFrame:
    """Default reranker: Σ idf over distinct question terms present in the hit."""
    n = index.n_docs
    terms = checked_broadcast(qterms.select("qid", "term").distinct().checkpoint(), 2_000_000)
    dfreq = index.postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    qt = terms.join(dfreq, "term").withColumn("idf", _idf(n, F.col("df")))
    h = hits.select(F.col(qid).alias("qid"), F.col(doc).alias("doc_id")).distinct()
    near = Bm25Index(index.doc_terms.join(checked_broadcast(h.select("doc_id").distinct(), 2_000_000), "doc_id", "left_semi"))
    m = near.postings.select("doc_id", "term").join(qt, "term").join(h, ["qid", "doc_id"])
    return m.groupBy("qid", "doc_id").agg(F.sum("idf").alias("rerank_score"))


def attach_docs(hits: DataFrame, chunks: DataFrame, key: str = "cid", max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Hits (query, key, rank, …) joined to their chunk rows (J7); the hit
    list is the small side (k rows per question) and is broadcast after a
    size check."""
    return chunks.join(checked_broadcast(hits, max_broadcast_rows), key)


def rerank(hits: DataFrame, query_text: str, doc_text: str, query: str = "qid", doc: str = "cid", fn=None,
           top_n: int = 3, index: "Bm25Index" = None, queries: DataFrame = None,
           queries_text: str = "text") -> DataFrame:
    """Rerank each question's hits and keep ``top_n`` (M7).

    ``fn(queries: pd.Series, texts: pd.Series) -> scores`` (e.g. a
    cross-encoder) runs on (question, passage) pairs in Arrow batches.
    Without ``fn`` the idf-overlap score over ``index`` is used; with
    neither, the incoming order (column ``rank``) is kept.
    """
    if fn is not None:
        from papertrail.operators.arrow_fns import pair_score_udf

        scored = hits.withColumn("rerank_score", pair_score_udf(fn)(F.col(query_text), F.col(doc_text)))
    elif index is not None and queries is not None:
        qt = query_terms(queries, query, queries_text)
        rr = idf_overlap_rerank(hits, qt, index, query, doc).withColumnRenamed("qid", query).withColumnRenamed("doc_id", doc)
        scored = hits.join(rr, [query, doc], "left").fillna(0.0, ["rerank_score"])
    else:
        scored = hits.withColumn("rerank_score", -F.col("rank").cast("double"))
    return top_k_per_query(scored.drop("rank"), query, "rerank_score", doc, top_n)


def ceil_div(a: int, b: int) -> int:
    return int(math.ceil(a / b)) if b else 0


# ------------------------------------------------------------------ embeddings (M6)


def md5_bucket(c, buckets: int) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def hashed_embedding(df: DataFrame, id_col: str, text: str, dims: int = 64, out: str = "vec") -> DataFrame:
    """Default embedding (id, vec): L2-normalised counts of word tokens
    hashed into ``dims`` buckets."""
    idx = bm25_index(df, id_col, text)
    return embedding_from_terms(idx.doc_terms, dims, out).withColumnRenamed("doc_id", id_col)


def embedding_from_terms(doc_terms: DataFrame, dims: int = 64, out: str = "vec") -> DataFrame:
    """(doc_id, vec) from per-document term frequencies, each vector built from
    its own row in Arrow batches: no shuffle."""
    kind = doc_terms.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def fn(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            n = len(lists)
            doc = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
            at, tf = lists.flatten().to_numpy(), b.column(2).flatten().to_numpy()
            v = np.bincount(doc * dims + at, tf.astype("float64"), minlength=n * dims).reshape(n, dims)
            v /= np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), vec], ["doc_id", out])

    tfs = F.coalesce("tfs", F.array().cast("array<struct<term:string,tf:bigint>>"))
    cols = [F.transform(tfs, lambda t: md5_bucket(t["term"], dims)).alias("buckets"),
            F.transform(tfs, lambda t: t["tf"]).alias("counts")]
    return doc_terms.select("doc_id", *cols).mapInArrow(fn, schema)


def embed(df: DataFrame, id_col: str, text: str, fn=None, out: str = "vec", dims: int = 64,
          batch_rows: int = 1000) -> DataFrame:
    """Sentence vectors (M6).  ``fn`` (optional) maps a pandas Series of
    texts to a list of float vectors; it runs in Arrow batches of
    ``batch_rows`` rows.  Without ``fn`` the hashed embedding is used."""
    if fn is None:
        return hashed_embedding(df, id_col, text, dims, out)
    from papertrail.operators.arrow_fns import vector_udf

    return df.withColumn(out, l2_normalize(vector_udf(lambda texts: _in_slices(fn, texts, batch_rows))(F.col(text))))


def _in_slices(fn, texts, rows: int) -> list:
    """``fn`` over slices of at most ``rows`` texts of a batch."""
    return [v for i in range(0, len(texts), rows) for v in fn(texts.iloc[i:i + rows])]
