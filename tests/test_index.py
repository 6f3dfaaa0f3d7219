"""The index is written whole, read back, and refreshed by path."""

import uuid

import pytest
from pyspark.sql import functions as F

from papertrail.operators import retrieval as R
from papertrail.plans import catalog
from papertrail.plans import retrieve as RT
from papertrail.plans import versions as V
from papertrail.session import scratch_path
from papertrail.streaming import incremental as INC


def chunks(docs):
    return RT.chunk_corpus(docs, "doc_id", "text", extra=("source",), size=20, overlap=5)


def rows(idx):
    return (sorted(map(tuple, idx.chunks.collect())), sorted((r.cid, tuple(r.vec)) for r in idx.vectors.collect()),
            sorted((r.doc_id, r.dl, tuple(map(tuple, r.tfs))) for r in idx.bm25.doc_terms.collect()))


def new_path(spark):
    return scratch_path(spark, f"t-index-{uuid.uuid4().hex}")


def test_refreshed_index_equals_a_new_one(spark):
    kind = "doc_id long, text string, source string, mtime long"
    old = [(1, "alpha beta gamma delta epsilon", "a", 1), (2, "stale words that go away again", "b", 1), (3, "removed file text", "c", 1)]
    now = [old[0], (2, "short", "b", 2), (4, "a new file of some more words", "d", 2)]
    was, cur = spark.createDataFrame(old, kind), spark.createDataFrame(now, kind)
    idx = RT.write_index(chunks(was), new_path(spark), shard_size=2)
    assert rows(idx)[0] == sorted(map(tuple, chunks(was).collect())) and len(rows(idx)[0]) == len(rows(idx)[1]) == len(rows(idx)[2])
    delta = INC.refresh_delta(cur.withColumnRenamed("source", "path"), was.withColumnRenamed("source", "path"))
    got = RT.refresh_index(idx, delta, cur, new_path(spark), chunks, shard_size=2)
    assert rows(got) == rows(RT.write_index(chunks(cur), new_path(spark), shard_size=2))
    none = cur.limit(0)
    delta = INC.refresh_delta(none.withColumnRenamed("source", "path"), cur.withColumnRenamed("source", "path"))
    assert rows(RT.refresh_index(got, delta, none, new_path(spark), chunks)) == ([], [], [])


def test_build_index_query_writes_the_index(spark, sf, monkeypatch):
    paths = []
    write = RT.write_index
    monkeypatch.setattr(RT, "write_index", lambda ch, path, **kw: (paths.append(path), write(ch, path, **kw))[1])
    n = catalog.queries()["m_build_index"](spark, sf).first()["doc_chunks"]
    assert n > 0 and [spark.read.parquet(f"{paths[0]}/{x}").count() for x in ("shards", "vectors", "terms")] == [n] * 3


# ------------------------------------------------------------------ refreshed in place

KIND = "doc_id long, text string, source string, mtime long"


def versioned(docs):
    return RT.chunk_corpus(docs, "doc_id", "text", extra=("source", "mtime"), size=20, overlap=5)


def files(spark, path):
    v = V.latest(spark, path)
    return {r["file"]: (r["lo"], r["hi"], r["n"]) for r in V.versions(spark, path).filter(F.col("version") == v).collect()}


def whole(spark, path, schema, version=None):
    idx = V.open_index(spark, path, schema, version)
    return (*rows(idx), sorted(map(tuple, idx.bm25.doc_freq().collect())), idx.bm25.docs, idx.bm25.length)


def test_two_refreshes_in_place_equal_a_new_index(spark):
    body = "one two three four five six seven eight nine ten eleven twelve thirteen"
    first = [(k, f"{body} number {k}", f"p{k}", 1) for k in range(24)]
    second = [r for r in first if r[0] not in (3, 4)] + [(100, "brand new words", "p100", 1)]
    second = [(k, "shorter now", p, 2) if k == 5 else (k, t, p, m) for k, t, p, m in second]
    third = [r for r in second if r[0] != 100] + [(2, None, "p2b", 9), (-7, "below all ids", "p-7", 3)]
    path = new_path(spark)
    tables = [spark.createDataFrame(x, KIND) for x in (first, second, third)]
    schema = versioned(tables[0]).schema
    V.create_index(versioned(tables[0]), path, shard_size=16)
    before = files(spark, path)
    assert len(before) > 5
    for k, docs in enumerate(tables[1:], 2):
        assert V.refresh(spark, path, docs, versioned, schema, shard_size=16) == k
        fresh = new_path(spark)
        V.create_index(versioned(docs), fresh, shard_size=16)
        assert whole(spark, path, schema) == whole(spark, fresh, schema)
    after = files(spark, path)
    # only files with chunks of the paths 3, 4 and 5 were written anew; the others keep name and content
    far = {f for f, (lo, hi, _) in before.items() if lo > 6 << 20}
    assert len(far) >= len(before) - 3 and far <= set(after) and all(after[f] == before[f] for f in far)
    old = new_path(spark)  # readers of the first version still see it
    V.create_index(versioned(tables[0]), old, shard_size=16)
    assert whole(spark, path, schema, 1) == whole(spark, old, schema)
    now = whole(spark, path, schema)
    assert V.drop_versions(spark, path, 3) > 0 and whole(spark, path, schema) == now
    assert V.drop_versions(spark, path, 3) == 0


def test_a_refresh_that_changes_nothing_and_one_that_removes_all(spark):
    docs = spark.createDataFrame([(1, "some words here", "a", 1), (2, "and more", "b", 1)], KIND)
    path, schema = new_path(spark), versioned(docs).schema
    V.create_index(versioned(docs), path)
    was, names = whole(spark, path, schema), set(files(spark, path))
    assert V.refresh(spark, path, docs, versioned, schema) == 2
    assert whole(spark, path, schema) == was and set(files(spark, path)) == names
    V.refresh(spark, path, docs.limit(0), versioned, schema)
    assert whole(spark, path, schema) == ([], [], [], [], 0, 0)
    V.refresh(spark, path, docs, versioned, schema)
    assert whole(spark, path, schema) == was


def test_a_refresh_that_died_is_run_again(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words {k}", f"p{k}", 1) for k in range(9)], KIND)
    path, schema = new_path(spark), versioned(docs).schema
    V.create_index(versioned(docs), path, shard_size=3)
    was = whole(spark, path, schema)
    now = docs.filter("doc_id <> 4")
    counts = V.term_counts
    monkeypatch.setattr(V, "term_counts", lambda rows: 1 / 0)  # after the files, before the list
    with pytest.raises(ZeroDivisionError):
        V.refresh(spark, path, now, versioned, schema, shard_size=3)
    monkeypatch.setattr(V, "term_counts", counts)
    assert V.latest(spark, path) == 1 and whole(spark, path, schema) == was
    assert V.refresh(spark, path, now, versioned, schema, shard_size=3) == 2
    again = new_path(spark)
    V.create_index(versioned(now), again)
    assert whole(spark, path, schema) == whole(spark, again, schema)


def test_a_refreshed_index_answers_questions(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "a", 1), (2, "gamma delta gamma", "b", 1), (3, "beta beta", "c", 1)], KIND)
    path, schema = new_path(spark), versioned(docs).schema
    V.create_index(versioned(docs.filter("doc_id < 3")), path)
    V.refresh(spark, path, docs, versioned, schema)
    qs = spark.createDataFrame([(1, "beta"), (2, "gamma")], "qid long, text string")
    top = R.bm25_topk(qs, V.open_index(spark, path, schema).bm25, "qid", "text", 1).collect()
    assert sorted((r["qid"], r["doc_id"] >> 20) for r in top) == [(1, 3), (2, 2)]
