"""Exact clustered search against all scores, with clusters skipped."""

import uuid

import numpy as np

from papertrail.operators import vector_index as V
from papertrail.session import scratch_path

KIND = "id long, vec array<float>, cluster string"


def make(spark, n, dims, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims)) * 5
    x = (middle[rng.integers(12, size=n)] + rng.normal(size=(n, dims)) * 0.3).astype("float32")
    x[n // 2: n // 2 + n // 3] = x[0]  # a third of all rows are one vector
    return x, spark.createDataFrame([(k, v.tolist(), "clash") for k, v in enumerate(x)], KIND).repartition(4)


def path(spark):
    return scratch_path(spark, f"t-vec-{uuid.uuid4().hex}")


def expected(q, x, k):
    out = {}
    for i, v in enumerate(q):
        s = (x.astype("float64") @ v.astype("float64"))
        out[i] = sorted(range(len(x)), key=lambda j: (-round(s[j], 6), j))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def test_search_is_exact_and_skips_clusters(spark):
    x, items = make(spark, 900, 8, 1)
    q = np.vstack([x[::60], np.zeros((1, 8), "float32"), -x[5:7]])
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "qid long, vec array<float>")
    index = V.cluster_vectors(items, path(spark), clusters=12, sample_rows=300)
    assert index.items.count() == 900
    for k in (1, 10, 400):
        cells = spark.sparkContext.accumulator(0)
        assert found(V.search(asked, index, k, scored=cells)) == expected(q, x, k)
    cells = spark.sparkContext.accumulator(0)
    near = asked.filter("qid < 15")
    V.search(near, index, 5, scored=cells).collect()
    assert 0 < cells.value < 0.5 * 15 * 900
    assert found(V.search(asked, index, 10, block_rows=4)) == expected(q, x, 10)


def test_search_without_questions_or_vectors(spark):
    x, items = make(spark, 30, 4, 2)
    asked = spark.createDataFrame([(1, x[0].tolist())], "qid long, vec array<float>")
    index = V.cluster_vectors(items, path(spark), clusters=3)
    assert V.search(asked.limit(0), index).collect() == []
    none = V.cluster_vectors(items.limit(0), path(spark), clusters=3)
    assert V.search(asked, none).collect() == []


def test_topk_tasks_hold_little(spark):
    """Many queries and items, most of them copies: a task's memory and its
    candidates stay bounded, and the result is the exact one."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from papertrail.operators.retrieval import _partial_topk_fn

    rng = np.random.default_rng(5)
    items = np.repeat(rng.normal(size=(40, 8)), 500, axis=0)[rng.permutation(20_000)]
    queries = rng.normal(size=(2_000, 8))
    ids = rng.permutation(20_000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(items), pa.list_(pa.float64()))], ["id", "vec"])
    tracemalloc.start()
    fn = _partial_topk_fn(5, SimpleNamespace(value=(list(range(2_000)), queries)), pa.int64())
    out = pa.Table.from_batches(list(fn(iter([batch])))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all scores at once: 320 MB
    assert len(out) <= 2 * 5 * 2_000
    out["r"] = out["score"].round(6)
    got = out.sort_values(["qid", "r", "id"], ascending=[True, False, True]).groupby("qid").head(5)
    for q in range(0, 2_000, 97):
        want = sorted(zip(-np.round(items @ queries[q], 6), ids))[:5]
        assert got[got["qid"] == q]["id"].tolist() == [i for _, i in want]


def test_topk_passes_on_what_it_cannot_hold(spark):
    """More near ties than a task holds; null and repeated ids."""
    from types import SimpleNamespace

    import pyarrow as pa

    from papertrail.operators.retrieval import _partial_topk_fn

    vec = [[1.0 - 1e-9 * (i % 300)] for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array([None, 7, 7] + list(range(100, 697))), pa.array(vec)], ["id", "vec"])
    fn = _partial_topk_fn(2, SimpleNamespace(value=([3, None], np.array([[1.0], [2.0]]))), pa.int64(), held_rows=50, cells=64)
    out = pa.Table.from_batches(list(fn(iter([batch, batch])))).to_pylist()
    for q, score in ((3, 1.0), (None, 2.0)):
        mine = sorted((-round(r["score"], 6), r["id"] is not None, r["id"] or 0) for r in out if r["qid"] == q)
        assert mine[:2] == [(-score, False, 0)] * 2
