"""Exact deduplication through an extendible-hash index on shared files.

1. Keys.  Texts are normalised (A-Z lower-cased only, null as empty); the key
   is their 64-bit hash.  A pass over keys and lengths alone gives the load
   of every directory slot: its distinct keys, a long text counting once for
   each ``ENTRY_BYTES``.
2. Directory.  It starts with one bucket.  An overfull bucket is split on the
   next bit of the key, doubling the directory where the bucket was as deep
   as it, up to ``2 ** max_depth`` slots, whatever the corpus.  A slot that
   is still overfull is halved on further bits without more slots: its depth
   alone tells how many bits name its buckets.
3. Map tasks combine rows of equal text in at most ``HELD`` bytes (repeated
   texts stay held, so a text of a third of all rows leaves a task as one
   row) and send them to the owner of their bucket, found by the directory.
4. Owner tasks sort their buckets, which are ranges of keys, and read them in
   that order.  Rows of one key are held against the chain of its texts, byte
   by byte; a new text is a new link (``chain`` 0, 1, ...).  A link is an
   index entry (SHA-256, id that stays, group size).  Only the chain of one
   key is in memory.
5. Documents find their bucket by the directory and their link in the chain
   of their key by SHA-256; only ids and digests move, never texts.

Defined cases: a null text equals an empty one; a null id is never larger
than another id, and stays only when all ids of its group are null; rows
that repeat both id and text are one document and carry the same flags
(``dedup`` leaves one of them); an empty table gives an empty result.
Other columns are ignored, and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import lean, lower_ascii, shared_path, small, stored
from papertrail.llm.wordhash import slices

CAPACITY = 1 << 12
ENTRY_BYTES = 256
MAX_DEPTH = 16
KEY_BITS = 64
HELD = 16 << 20
MAX_BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def hash_key(norm: Column, bits: int = KEY_BITS) -> Column:
    """The 64-bit key, of which fewer ``bits`` may be set (tests make texts collide)."""
    return F.xxhash64(norm).bitwiseAND(F.lit(-1 << (64 - bits)).cast("long"))


def _slot(key: Column, depth: int) -> Column:
    """The top ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def split_directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Split overfull buckets until each holds at most ``capacity`` entries or
    is ``max_depth`` deep.  ``counts``: entries per slot of ``max_depth`` bits.
    Returns (first slot, slots, depth) per bucket, in key order."""
    per_slot = np.zeros(1 << max_depth, "int64")
    per_slot[list(counts)] = list(counts.values())
    before = np.concatenate([[0], np.cumsum(per_slot)])
    done, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        width = 1 << (max_depth - depth)
        first = prefix * width
        if before[first + width] - before[first] > capacity and depth < max_depth:
            todo += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
        else:
            done.append((first, width, depth))
    return sorted(done)


def directory(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH,
              key_bits: int = KEY_BITS) -> DataFrame:
    """slot → depth of its buckets: one row per slot, at most ``2 ** max_depth``."""
    norm = normalised(F.col(text_col))
    keys = docs.select(hash_key(norm, key_bits).alias("key"), F.octet_length(norm).cast("long").alias("bytes"))
    keys = keys.groupBy("key").agg(F.max("bytes").alias("bytes"))
    load = F.sum(1 + F.floor(F.col("bytes") / ENTRY_BYTES)).alias("load")
    counts = {r["slot"]: r["load"] for r in keys.groupBy(_slot(F.col("key"), max_depth).alias("slot")).agg(load).collect()}
    rows = []
    for first, width, depth in split_directory(counts, capacity, max_depth):
        if depth == max_depth and (held := counts.get(first, 0)) > capacity:
            depth = min(depth + math.ceil(math.log2(held / capacity)), 62)
        rows.append((first, first + width - 1, depth))
    d = docs.sparkSession.createDataFrame(rows, "first long, last long, depth int")
    return d.select(F.explode(F.sequence("first", "last")).alias("slot"), "depth")


def with_bucket(keyed: DataFrame, slots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``keyed`` with its bucket: the ``depth`` first bits of the key behind a
    1, so that buckets of any depth have different numbers."""
    prefix = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(key, 64 - depth)"))
    d = keyed.withColumn("slot", _slot(F.col("key"), max_depth)).join(F.broadcast(slots), "slot")  # 2 ** max_depth rows at most
    return d.withColumn("bucket", F.expr("shiftleft(1L, depth)") + prefix).drop("slot")


def _larger(a, b):
    return b if a is None or (b is not None and b > a) else a


def combined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS, held_bytes: int = HELD) -> DataFrame:
    """key, norm (bytes), id (the largest), n: rows of equal text made one
    inside each map task."""
    kind = docs.schema[id_col].dataType.simpleString()
    norm = normalised(F.col(text_col))
    t = docs.select(hash_key(norm, key_bits).alias("key"), norm.cast("binary").alias("norm"), F.col(id_col).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, id_type = 0, None

        def made(texts: Iterable[bytes]) -> pa.RecordBatch:
            texts = list(texts)
            keys, ids, n = zip(*(held.pop(t) for t in texts))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.binary()), pa.array(ids, id_type),
                                               pa.array(n, pa.int64())], ["key", "norm", "id", "n"])

        for whole in batches:
            id_type = whole.schema.field(2).type
            for b in slices(whole, 1):
                for key, text, doc in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if (e := held.get(text)) is None:
                        held[text] = [key, doc, 1]
                        size += len(text) + 256
                    else:
                        e[1:] = _larger(e[1], doc), e[2] + 1
                if size > held_bytes:
                    once = [t for t, e in held.items() if e[2] == 1]
                    if once:
                        yield made(once)
                    size = sum(len(t) + 256 for t in held)
                    if size > held_bytes // 2:
                        yield made(held)
                        size = 0
        if held:
            yield made(held)

    return t.mapInArrow(lean(run), f"key long, norm binary, id {kind}, n long")


def owned(rows: DataFrame) -> DataFrame:
    """The index entries of the buckets: bucket, depth, key, chain, sha256,
    keep_id, group_size.  ``rows``: bucket, depth, key, norm, id, n."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["bucket", "depth", "key", "chain", "sha256", "keep_id", "group_size"]
    r = rows.select("bucket", "depth", "key", "norm", "id", "n").repartition("bucket").sortWithinPartitions("bucket", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        chain: list[list] = []  # [text, id that stays, group size] of every text of the key at hand
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), None, pa.int64()]

        def links() -> list[tuple]:
            return [(*at, no, hashlib.sha256(text).hexdigest(), keep, n) for no, (text, keep, n) in enumerate(chain)]

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for whole in batches:
            types[5] = whole.schema.field(4).type
            for b in slices(whole, 3):
                out: list[tuple] = []
                for bucket, depth, key, text, doc, n in zip(*(b.column(k).to_pylist() for k in range(6))):
                    if at != (bucket, depth, key):
                        out += links()
                        at, chain = (bucket, depth, key), []
                    for link in chain:
                        if link[0] == text:
                            link[1:] = _larger(link[1], doc), link[2] + n
                            break
                    else:
                        chain.append([text, doc, n])
                if out:
                    yield made(out)
        if chain:
            yield made(links())

    return r.mapInArrow(lean(run), f"bucket long, depth int, key long, chain int, sha256 string, keep_id {kind}, group_size long")


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = KEY_BITS, held_bytes: int = HELD) -> DataFrame:
    """Write the index files of ``docs`` under ``path`` (default: a new folder
    in the shared one) and return the entries: bucket, depth, key, chain,
    sha256, keep_id, group_size.  Their ``directory`` is slot → depth."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "exact-index")
    directory(docs, text_col, capacity, max_depth, key_bits).coalesce(1).write.parquet(f"{path}/directory")
    slots = spark.read.parquet(f"{path}/directory")
    rows = with_bucket(combined(docs, id_col, text_col, key_bits, held_bytes), slots, max_depth)
    owned(rows).write.parquet(f"{path}/buckets")
    index = spark.read.parquet(f"{path}/buckets")
    index.directory = slots
    return index


def lookup(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_depth: int = MAX_DEPTH,
           key_bits: int = KEY_BITS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(F.col(text_col))
    d = docs.select(F.col(id_col).alias("doc_id"), hash_key(norm, key_bits).alias("key"), F.sha2(norm, 256).alias("text_sha256"))
    d = with_bucket(d, index.directory, max_depth).drop("depth")
    e = index.select("bucket", "key", F.col("sha256").alias("text_sha256"), "keep_id", "group_size")
    j = d.join(e, ["bucket", "key", "text_sha256"])
    return j.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """Flags of every document, dropped ones too."""
    cols = {k: v for k, v in options.items() if k in ("id_col", "text_col", "max_depth", "key_bits")}
    return lookup(docs, build_index(docs, **options), **cols)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs``, unchanged, for every text."""
    flags = stored(exact_dedup(docs, id_col=id_col, text_col=text_col, **options), "exact-flags")
    gone = flags.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    twice = flags.filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).count() \
        .filter("count > 1").drop("count").checkpoint()
    d = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"),
                    F.sha2(normalised(F.col(text_col)), 256).alias("_sha"))

    def same(other: DataFrame) -> Column:
        return d["_id"].eqNullSafe(other["_id"]) & (d["_sha"] == other["_sha"])

    gone = small(gone, MAX_BROADCAST_ROWS)
    d = d.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        twice = small(twice, MAX_BROADCAST_ROWS)
        d = d.join(twice, same(twice), "left_anti").unionByName(
            d.join(twice, same(twice), "left_semi").dropDuplicates(["_id", "_sha"]))
    return d.select("_row.*")
