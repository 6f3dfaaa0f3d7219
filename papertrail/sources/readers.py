"""File sources as DataFrames.

Directory readers use Spark's file sources (``text`` with ``wholetext``,
``binaryFile``, ``json``) with ``pathGlobFilter`` for the extension test
and ``recursiveFileLookup``; file metadata comes from the hidden
``_metadata`` column, so listing and reading happen on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.functions.bib import parse_entry, split_entries
from papertrail.functions.records import split_records
from papertrail.functions.text import path_parts


def ci_glob(ext: str) -> str:
    """Case-insensitive glob for an extension: ``.pdf`` → ``*.[pP][dD][fF]``."""
    e = ext.lstrip("*").lstrip(".")
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)


def _whole_files(spark: SparkSession, path: str, glob: str | None, recursive: bool) -> DataFrame:
    """(path, mtime, text) of every listed file; a file that cannot be read
    keeps its row with a null text."""
    options = {k: v for k, v in (("pathGlobFilter", glob), ("recursiveFileLookup", recursive or None)) if v}
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime")]
    listed = spark.read.format("binaryFile").options(**options).load(path).select(*meta)  # names only, no content
    read = spark.read.format("text").option("wholetext", True).option("ignoreCorruptFiles", True).options(**options).load(path)
    return listed.join(read.select(meta[0], F.col("value").alias("text")), "path", "left")


def read_docs(spark: SparkSession, path: str, ext: str = ".txt", recursive: bool = False,
              ignore_case: bool = True) -> DataFrame:
    """(path, name, mtime, text) per file with the extension (S3).
    ``name`` is the file stem; an unreadable file has a null text."""
    glob = ci_glob(ext) if ignore_case else "*" + ext
    df = _whole_files(spark, path, glob, recursive)
    return df.select("path", path_parts("path")["stem"].alias("name"), "mtime", "text")


def read_json_map(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(name, json text) per .json file, not parsed."""
    return read_docs(spark, path, ".json", recursive).select("name", F.col("text").alias("json"))


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents from every .json file under ``path`` (S4): one per item
    of a top-level list, else one; unparsable files give an error row."""
    from papertrail.operators.extraction import json_docs

    files = _whole_files(spark, path, ci_glob(".json"), True)
    docs = json_docs(files, "path", "text")
    return docs.withColumn("file_name", path_parts("path")["basename"]).withColumnRenamed("path", "source")


def read_text_records(spark: SparkSession, path: str, crlf: bool = True, split_files: bool = False,
                      line_sep: str = "\n\n\n") -> DataFrame:
    """(path, record_id, text): each file cut at three or more newlines.

    ``split_files=True`` is the form for very large files: the text source
    cuts at ``line_sep`` while reading, so one file is read by many tasks
    (no whole-file row), and each piece is cut again, so files with either
    kind of line end give the same records (pass ``"\\r\\n" * 3`` to cut large
    files of that kind early).  ``record_id`` is then increasing in file order
    but not dense (:func:`papertrail.operators.corpus.sequence_after_sort`
    gives ordinals).
    """
    if not split_files:
        f = _whole_files(spark, path, None, False)
        return f.select("path", F.posexplode(split_records("text", crlf)).alias("record_id", "text"))
    df = spark.read.option("lineSep", line_sep).text(path)
    out = df.select(F.col("_metadata.file_path").alias("path"), F.explode(split_records("value", crlf)).alias("text"))
    return out.select("path", F.monotonically_increasing_id().alias("record_id"), "text")


def read_bib(spark: SparkSession, path: str, ext: str = ".bib") -> DataFrame:
    """(path, entry_no, entrytype, id, fields) from .bib files.

    The text source cuts the files at ``@`` at a line start, so a large file
    is read by many tasks; ``entry_no`` increases in file order."""
    df = spark.read.option("lineSep", "\n@").option("pathGlobFilter", ci_glob(ext)).text(path)
    piece = F.when(F.col("value").rlike(r"^\s*@"), F.col("value")).otherwise(F.concat(F.lit("@"), F.col("value")))
    e = df.select(F.col("_metadata.file_path").alias("path"), F.explode(split_entries(piece)).alias("t"))
    e = e.select("path", F.monotonically_increasing_id().alias("entry_no"), parse_entry("t").alias("e"))
    return e.select("path", "entry_no", "e.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, corrupt: str = "_corrupt_record") -> DataFrame:
    """JSONL with an explicit schema (S6); blank lines are skipped, and a
    malformed line gives a row of nulls with its text in ``corrupt``."""
    if corrupt not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt).json(path))


def list_binary_docs(spark: SparkSession, path: str, ext: str = ".pdf", with_content: bool = False) -> DataFrame:
    """(path, name, mtime, length, is_empty[, content]) of the files with
    the extension, non-recursive, sorted by path (S7).  A zero-byte file
    is flagged (it is an error for the converter); its ``mtime`` is null."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", ci_glob(ext)).load(path)
    # Spark lists files of no length but never reads them: their names come from the listing
    one_slash = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(p,) for p in df.inputFiles()], "url string").select(one_slash("url").alias("_url"))
    read = df.withColumn("_url", one_slash(F.col("_metadata.file_path")))
    name = F.url_decode(F.replace(F.col("_url"), F.lit("+"), F.lit("%2B")))
    df = listed.join(read, "_url", "left").withColumn("path", F.coalesce("path", name)).withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    cols = [F.col("path"), path_parts("path")["stem"].alias("name"), F.col("modificationTime").alias("mtime"),
            F.col("length"), (F.col("length") == 0).alias("is_empty")]
    if with_content:
        cols.append(F.col("content"))
    return df.select(*cols).orderBy("path")
