"""A chunk index that is refreshed in place.

An index is a folder.  ``rows/v=<n>`` holds the Parquet files that version
``n`` wrote: chunks in id order with their length and term frequencies, of which
their vectors are made where they are read, about ``shard_size`` rows in a file.  ``shards/version=<n>`` names the files that
make version ``n`` up, each with its id range and sums; ``terms/version=<n>`` is
what version ``n`` changed in the document frequencies.

A refresh rewrites only the files that hold chunks of removed or changed
paths (without those chunks) and adds files with the chunks of new and changed
paths; all other files stay where they are and keep their names.  N and the
length sum are added up from ``shards``, document frequencies from the changes
in ``terms``; the corpus is neither chunked nor tokenised again.

The ``shards`` entry is written last: until then readers keep the version
before, a refresh that dies leaves files no version names, and running it again
overwrites them.  Readers of older versions are not disturbed until
:func:`drop_versions` removes files that only those name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.functions.text import tokenize
from papertrail.operators import retrieval as R
from papertrail.operators.sizing import checked_broadcast
from papertrail.plans.retrieve import StoreIndex
from papertrail.streaming.incremental import refresh_delta


@dataclass
class VersionedBm25(R.Bm25Index):
    """Term statistics that are kept beside the index instead of counted from it."""

    freq: DataFrame | None = None  # term, df
    docs: int = 0
    length: int = 0

    @property
    def n_docs(self) -> Column:
        return F.lit(self.docs)

    @property
    def avgdl(self) -> Column:
        return F.lit(self.length / self.docs if self.docs else None).cast("double")

    def doc_freq(self) -> DataFrame:
        return self.freq


def indexed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``dl`` and ``tfs``, made inside the row."""
    rows = chunks.withColumn("_toks", tokenize("text")).withColumn("dl", F.coalesce(F.size("_toks"), F.lit(0)).cast("long"))
    return rows.withColumn("tfs", R.term_freqs("_toks")).drop("_toks")


def _ordered(df: DataFrame, id_col: str, shard_size: int) -> DataFrame:
    """``df`` in id order, about ``shard_size`` rows in a partition."""
    return df.repartitionByRange(max(1, -(-df.count() // shard_size)), id_col).sortWithinPartitions(id_col)


def _commit(parts: list[DataFrame], path: str, version: int, id_col: str, kept: DataFrame | None = None,
            replaced: DataFrame | None = None) -> None:
    """Write ``parts`` as the files of ``version``, what they change in the
    document frequencies (``replaced``: rows of files given up), and last the list
    of the version's files: those written and ``kept`` ones."""
    spark = parts[0].sparkSession
    folder = f"{path}/rows/v={version}"
    for k, rows in enumerate(parts):
        rows.write.mode("append" if k else "overwrite").parquet(folder)
    written = spark.read.schema(parts[0].schema).parquet(folder)
    terms = term_counts(written)
    if replaced is not None:
        terms = terms.unionByName(term_counts(replaced).withColumn("df", -F.col("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    terms.filter("df <> 0").write.mode("overwrite").parquet(f"{path}/terms/version={version}")
    name = F.concat(F.lit(f"v={version}/"), F.element_at(F.split("_metadata.file_path", "/"), -1))
    shards = written.groupBy(name.alias("file")).agg(
        F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"))
    # a row without a file stands for the version, which may have none
    shards = shards.unionByName(spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in shards.schema.fields)))
    shards = shards if kept is None else kept.unionByName(shards)
    shards.coalesce(1).write.mode("overwrite").parquet(f"{path}/shards/version={version}")  # a row a file


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, df) of index rows."""
    t = rows.select(F.explode_outer(F.transform("tfs", lambda x: x["term"])).alias("term")).filter(F.col("term").isNotNull())
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def create_index(chunks: DataFrame, path: str, id_col: str = "cid", shard_size: int = 100_000) -> None:
    """Version 1 of an index of ``chunks`` (unique ``id_col``, ``text`` and more)."""
    _commit([indexed(_ordered(chunks, id_col, shard_size))], path, 1, id_col)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The files of all versions: version, file, lo, hi, n, dl."""
    return spark.read.parquet(f"{path}/shards").filter(F.col("file").isNotNull())


def latest(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/shards").agg(F.max("version")).first()[0]


def read_rows(spark: SparkSession, path: str, schema: T.StructType, shards: DataFrame) -> DataFrame:
    """The rows of the files that ``shards`` names (one name per file goes through
    the driver, as Spark's own file listing does), with ``_file``."""
    files = [f"{path}/rows/{r['file']}" for r in shards.select("file").collect()]
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType())]))
    parts = F.split("_metadata.file_path", "/")
    return spark.read.schema(schema).parquet(*files).withColumn(
        "_file", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)))


def index_schema(chunks: T.StructType) -> T.StructType:
    return T.StructType([*chunks.fields, T.StructField("dl", T.LongType()),
                         T.StructField("tfs", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])


def open_index(spark: SparkSession, path: str, chunks: T.StructType, version: int | None = None, id_col: str = "cid",
               dims: int = 64) -> StoreIndex:
    """The index at ``version`` (default: the latest); ``chunks`` is the schema of
    its chunks."""
    version = latest(spark, path) if version is None else version
    shards = versions(spark, path).filter(F.col("version") == version)
    rows = read_rows(spark, path, index_schema(chunks), shards)
    n, dl = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    freq = spark.read.parquet(f"{path}/terms").filter(F.col("version") <= version).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    bm = VersionedBm25(rows.select(F.col(id_col).alias("doc_id"), "dl", "tfs"), True, freq, n, dl)
    vectors = R.embedding_from_terms(bm.doc_terms, dims).withColumnRenamed("doc_id", id_col)
    return StoreIndex(rows.select(*chunks.names), vectors, bm)


def refresh(spark: SparkSession, path: str, docs: DataFrame, chunk_fn, chunks: T.StructType, path_col: str = "source",
            mtime: str = "mtime", id_col: str = "cid", shard_size: int = 100_000, max_paths: int = 1_000_000) -> int:
    """Bring the latest version up to ``docs`` (``path_col``, ``mtime`` and what
    ``chunk_fn`` chunks) and return the number of the version written.

    Chunks carry ``path_col`` and ``mtime``, from which the index knows its own
    files: paths whose time differs are changed, paths without documents are
    removed.  Up to ``max_paths`` changes are broadcast, more are joined by path.
    """
    version = latest(spark, path)
    shards = versions(spark, path).filter(F.col("version") == version).drop("version")
    old = read_rows(spark, path, index_schema(chunks), shards)
    delta = refresh_delta(docs.select(F.col(path_col).alias("path"), mtime).distinct(),
                          old.select(F.col(path_col).alias("path"), mtime).distinct()).checkpoint()
    at = lambda *actions: checked_broadcast(
        delta.filter(F.col("action").isin(*actions)).select(F.col("path").alias(path_col)), max_paths)
    gone = at("removed", "changed")
    touched = old.join(gone, path_col, "left_semi").select(F.col("_file").alias("file")).distinct().checkpoint()  # a row a file
    replaced = read_rows(spark, path, index_schema(chunks), touched).drop("_file")
    fresh = chunk_fn(docs.join(at("new", "changed"), path_col, "left_semi")).select(*chunks.names)
    parts = [indexed(_ordered(fresh, id_col, shard_size)), _ordered(replaced.join(gone, path_col, "left_anti"), id_col, shard_size)]
    parts[1] = parts[1].select(*parts[0].columns)
    _commit(parts, path, version + 1, id_col, shards.join(F.broadcast(touched), "file", "left_anti"), replaced)
    return version + 1


def drop_versions(spark: SparkSession, path: str, before: int) -> int:
    """Forget versions before ``before`` and delete the files that only they name;
    returns how many.  Term changes stay: later versions add them up."""
    every = versions(spark, path)
    kept = every.filter(F.col("version") >= before).select("file").distinct()
    lost = [r["file"] for r in every.filter(F.col("version") < before).select("file").distinct().join(kept, "file", "left_anti").collect()]
    listed = spark.read.parquet(f"{path}/shards").select("version").distinct()
    old = [r["version"] for r in listed.filter(F.col("version") < before).collect()]
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [f"rows/{f}" for f in lost] + [f"shards/version={v}" for v in old]:
        fs.delete(jvm(f"{path}/{name}"), True)
    return len(lost)
