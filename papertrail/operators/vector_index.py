"""Exact inner-product top-k over clustered vectors.

Centroids are fitted on a bounded sample (``sample_rows``, by the hash of the id);
every vector is assigned to its nearest one and stored with its cluster,
a cluster's vectors together.  No vector of a cluster scores more than
``q·c + |q| * radius`` (triangle inequality), so a cluster whose bound is below a
question's k-th best score so far is skipped for it without being read any
further: the result is exact, with no cap and no approximate bucket.

A search is two scans with the questions of one block (``block_rows``) broadcast.
The first scores each question in its best-bounded cluster only and yields the
score it has to beat; the second scores the clusters that may beat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.operators.retrieval import _bounded_blocks, best_cells, top_k_per_query

SAMPLE_ROWS = 20_000
SLACK = 1e-9  # relative, for the rounding of sums


def _matrix(lists, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1)


def fit_centroids(items: DataFrame, vec: str, clusters: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds on about ``sample_rows`` vectors.  They decide
    speed only: any assignment gives the same search results."""
    n = items.count()
    part = items if n <= sample_rows else items.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < int(sample_rows / n * (1 << 32)))
    x = np.array([list(r[0]) for r in part.select(vec).collect()], "float64")
    if not len(x):
        return np.zeros((1, 1))
    centre = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centre.T - 0.5 * (centre ** 2).sum(1)).argmax(1)
        for c in range(len(centre)):
            if (near == c).any():
                centre[c] = x[near == c].mean(0)
    return centre


@dataclass
class ClusteredVectors:
    items: DataFrame  # id, vec, cluster; a cluster's rows together
    centroids: np.ndarray
    radius: np.ndarray  # of each cluster; -1 where it is empty


def cluster_vectors(items: DataFrame, path: str, iid: str = "id", ivec: str = "vec", clusters: int = 64,
                    sample_rows: int = SAMPLE_ROWS) -> ClusteredVectors:
    """Assign every vector to its nearest centroid and write the table below ``path``.

    Rows are range-partitioned by (cluster, hash), so a large cluster is shared
    out among tasks."""
    spark = items.sparkSession
    it = items.select(F.col(iid).alias("id"), F.col(ivec).alias("vec"))
    centre = fit_centroids(it, "vec", clusters, sample_rows)
    sent = spark.sparkContext.broadcast(centre)
    schema = T.StructType([*it.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), b.num_rows)
            near = (x @ c.T - 0.5 * (c ** 2).sum(1)).argmax(1)
            far = np.sqrt(((x - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(far)], schema.names)

    out = it.mapInArrow(assign, schema)
    out.repartitionByRange("cluster", F.xxhash64("id")).sortWithinPartitions("cluster").write.mode("overwrite").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    radius = np.full(len(centre), -1.0)
    for r in stored.groupBy("cluster").agg(F.max("distance").alias("r")).collect():  # a row a cluster
        radius[r["cluster"]] = r["r"]
    return ClusteredVectors(stored.select("id", "vec", "cluster"), centre, radius)


def search(queries: DataFrame, index: ClusteredVectors, k: int = 10, qid: str = "qid", qvec: str = "vec",
           block_rows: int = 4096, scored=None) -> DataFrame:
    """(qid, id, score, rank): the exact ``k`` best of each question, ties by id.

    ``scored``: a Spark accumulator that the second scan adds its numbers of
    scored (question, vector) cells to."""
    spark = queries.sparkSession
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec"))
    schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("id", index.items.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    out = None
    for block in _bounded_blocks(q, "qid", block_rows):
        rows = block.collect()  # at most block_rows questions
        if not rows or (index.radius < 0).all():
            continue
        qids = [r["qid"] for r in rows]
        m = np.array([list(r["vec"]) for r in rows], "float64")
        length = np.sqrt((m ** 2).sum(1))[:, None]
        reach = length * np.maximum(index.radius, 0)[None, :]
        mid = m @ index.centroids.T
        bound = np.where(index.radius >= 0, mid + reach + SLACK * (np.abs(mid) + reach), -np.inf)
        first = bound.argmax(1)
        best = _scan(index.items, (qids, m, (np.arange(len(index.radius))[None, :] == first[:, None])), k, schema, None)
        ranked = top_k_per_query(best, "qid", "score", "id", k, digits=None).filter(F.col("rank") == k)
        found = {r["qid"]: r["score"] for r in ranked.select("qid", "score").collect()}  # a row a question
        beat = np.array([found.get(x, -np.inf) for x in qids])
        may = bound >= beat[:, None] - 1e-6  # scores that are equal when rounded are settled by the id
        part = _scan(index.items, (qids, m, may), k, schema, scored)
        out = part if out is None else out.unionByName(part)
    return top_k_per_query(spark.createDataFrame([], schema) if out is None else out, "qid", "score", "id", k)


def _scan(items: DataFrame, sent, k: int, schema, scored) -> DataFrame:
    """Partial top-k of each question among the clusters that it may need."""
    data = items.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        qids, m, may = data.value
        names = pa.array(qids)
        for b in batches:
            cluster = b.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])) if b.num_rows else []
            for a, z in zip(cuts, [*cuts[1:], b.num_rows]):
                ask = np.flatnonzero(may[:, cluster[a]])
                if not len(ask):
                    continue
                part = b.slice(a, z - a)
                scores = m[ask] @ _matrix(part.column(1), len(part)).T
                if scored is not None:
                    scored.add(scores.size)
                r, i = best_cells(scores, k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(ask[r])), part.column(0).take(pa.array(i)), pa.array(scores[r, i])],
                                                 ["qid", "id", "score"])

    return items.mapInArrow(run, schema)
