"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.session import ensure_checkpoint_dir, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, split as the scan splits it."""
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written intermediate below ``spark.checkpoint.dir``,
    which the driver and all executors share."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again:
    lineage ends there, so a lost executor costs only a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a :func:`stored` table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of the finished steps, which
    otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A dict that the later tasks of a Python worker find again."""
    return _KEPT.setdefault(name, {})


def forget() -> None:
    """Empty all :func:`kept` dicts.  Spark uses its Python workers again for
    later stages, where the caches of finished operators only take memory."""
    if any(_KEPT.values()):
        for d in _KEPT.values():
            d.clear()
        gc.collect()


def give_back() -> None:
    """Return the memory that the allocators of this process hold free."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` (of ``mapInArrow``) as a task that leaves no free memory behind:
    its Python worker stays for later tasks beside those of other cores."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character unchanged."""
    return F.translate(c, UPPER, LOWER)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as
    needed: Catalyst would otherwise copy it into every lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when ``df``, whose rows must be of bounded width, has
    at most ``max_rows`` rows; else ``df``, joined by a shuffle that adaptive
    execution splits where a key is hot."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def sampled(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows, or all if there are no more, chosen by the hash of
    ``keys``: the same rows every time, kept where they are (a ``limit`` in the
    middle of a plan would pass them all through one task)."""
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 32)) < int(rows / total * (1 << 32)))
