"""Sinks: bib files, per-label outputs, per-document text/JSON, dead
letters, CSV reports, sharded index, run summaries and metric logs.

Writers use Spark's committers (task output becomes visible only when the
job commits), which replaces the per-record fsync of a single-process
writer; re-running a job overwrites its output directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.functions._col import col_of

# ------------------------------------------------------------------ K5


def dead_letter(df: DataFrame, stage, name, message, raw=None, raw_max_len: int | None = None) -> DataFrame:
    """(ts, stage, name, message, raw) rows (K5).  ``raw`` is often the only copy
    of a failed reply: it stays whole unless ``raw_max_len`` asks for a cut."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    r = col_of(raw) if raw is not None else F.lit(None).cast("string")
    r = F.substring(r, 1, raw_max_len) if raw_max_len is not None else r
    return df.select(F.current_timestamp().alias("ts"), lit(stage).alias("stage"), col_of(name).alias("name"),
                     lit(message).alias("message"), r.alias("raw"))


def split_status(df: DataFrame, ok: Column) -> tuple:
    """(good rows, failed rows) from one status expression; cache the input
    if both sides are written."""
    flagged = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("_ok").drop("_ok"), flagged.filter(~F.col("_ok")).drop("_ok")


# ------------------------------------------------------------------ K1-K4


def write_bib(df: DataFrame, path: str, col: str = "bib", mode: str = "overwrite") -> None:
    """One entry per record, entries separated by a blank line (K1)."""
    df.select(col).write.mode(mode).option("lineSep", "\n\n").text(path)


def write_by_label(df: DataFrame, path: str, label: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Route every row to its class folder ``label=<value>/`` (K2)."""
    df.write.mode(mode).partitionBy(label).format(fmt).save(path)


def write_text_docs(df: DataFrame, path: str, name: str, text: str, mode: str = "overwrite") -> None:
    """Text per document as Parquet rows (name, text) (K3): a document is a row,
    not a folder, however many there are."""
    df.select(col_of(name).alias("name"), col_of(text).alias("text")).write.mode(mode).parquet(path)


def qa_document(df: DataFrame, doc: str, order: str = "ord") -> DataFrame:
    """Doc-level QA JSON (K4): a bare object when the document has exactly
    one pair, else an array in pair order.  The list per document is
    bounded by the pairs generated for one paper."""
    pairs = F.struct(F.col("question"), F.col("reasoning"), F.col("answer"))
    g = df.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), pairs.alias("p")))).alias("l"))
    items = F.transform(F.col("l"), lambda s: s["p"])
    return g.select(doc, F.size(items).alias("n_pairs"),
                    F.when(F.size(items) == 1, F.to_json(items[0])).otherwise(F.to_json(items)).alias("json"))


def write_qa(df: DataFrame, path: str, doc: str, mode: str = "overwrite") -> None:
    """Both forms (K4): JSON lines, each naming its document, and the
    document-level JSON texts as Parquet rows (document, json)."""
    df.select(doc, "question", "reasoning", "answer").write.mode(mode).json(f"{path}/jsonl")
    qa_document(df, doc).select(doc, "json").write.mode(mode).parquet(f"{path}/json")


# ------------------------------------------------------------------ K6-K9


def write_results_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV (Spark writes no byte-order mark) (K6)."""
    df.write.mode(mode).option("header", True).csv(path)


def save_index(df: DataFrame, path: str, id_col: str, shard_size: int = 100_000, mode: str = "overwrite") -> DataFrame:
    """Write chunks in shards of ``shard_size`` rows, in ``id_col`` order, each in
    a folder ``shard_no=<n>`` (K7), and return the manifest row: total, shard
    size, number of shards, their folders."""
    from papertrail.operators.corpus import batch_no

    rows = batch_no(df, id_col, shard_size, "shard_no", "_seq").drop("_seq")
    # rows come range-partitioned by id: a task writes the few shards it overlaps
    rows.write.mode(mode).partitionBy("shard_no").parquet(f"{path}/shards")
    spark = df.sparkSession
    counts = spark.read.schema(rows.schema).parquet(f"{path}/shards").groupBy("shard_no").agg(F.count(F.lit(1)).alias("n"))
    man = counts.agg(F.sum("n").alias("total_docs"), F.count(F.lit(1)).alias("num_shards"),
                     F.array_sort(F.collect_list(F.concat(F.lit("shard_no="), F.col("shard_no").cast("string")))).alias("shards"))
    man = man.select(
        F.coalesce("total_docs", F.lit(0).cast("long")).alias("total_docs"), F.lit(shard_size).alias("shard_size"), "num_shards", "shards",
        F.lit("parquet").alias("persist_format"), F.lit(f"{path}/shards").alias("persist_dir"),
        F.current_timestamp().alias("built_at"))
    man.write.mode(mode).json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def load_index(spark, path: str, id_col: str, shard_col: str = "shard_no") -> DataFrame:
    """Read all shards; on equal ids the row of the later shard wins."""
    df = spark.read.parquet(f"{path}/shards")
    last = df.groupBy(id_col).agg(F.max_by(F.struct(*[c for c in df.columns if c != id_col]), F.col(shard_col)).alias("_row"))
    return last.select(id_col, "_row.*")


def run_summary(counts: DataFrame, label: str, n: str, avg_conf: Column, params: dict) -> DataFrame:
    """One-row summary: totals, per-class counts, average confidence,
    parameters (K8)."""
    per = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("string"), F.col(n)))).alias("per_class"),
                     F.sum(n).alias("total"))
    return per.select("total", "per_class", avg_conf.alias("avg_confidence"),
                      F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))]).alias("params"))


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows (trial, metrics, params, timestamp) as JSON (K9)."""
    df.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)
