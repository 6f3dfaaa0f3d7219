"""Readers and sinks on small files."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail import session
from papertrail.functions import bib as B
from papertrail.session import scratch_path
from papertrail.sources import readers as RD
from papertrail.sources import sinks as SK


def fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


BIB = """@string{jx = "J. X"}
@article{k1,
  title = {A {B}ook, of "x" = y},
  journal = "J. {X}, vol",
  year = 2011, month = jan,
  pages = {1}, volume = {2},
  date-added = {2020-01-01},
  abstract = {line one
     line two, {nested {deep}} end},
}

@book{k2, title={T}}
@article{null,
  pmid = {},
  title = {first},
  title = {last}
}
"""


@pytest.mark.parametrize("crlf", [False, True])
def test_bib_value_forms(spark, crlf):
    p = fresh(spark, "bib")
    text = BIB.replace("\n", "\r\n") if crlf else BIB
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(p)
    got = {r.id: (r.entrytype, r.fields) for r in RD.read_bib(spark, p, ".txt").collect()}
    assert got["k1"] == ("article", {"title": 'A {B}ook, of "x" = y', "journal": "J. {X}, vol", "year": "2011", "month": "jan",
                                     "pages": "1", "volume": "2", "date-added": "2020-01-01",
                                     "abstract": "line one line two, {nested {deep}} end"})
    assert got["k2"] == ("book", {"title": "T"}) and got["null"] == ("article", {"pmid": "", "title": "last"}) and len(got) == 3


def test_string_blocks_are_no_entries(spark):
    df = spark.createDataFrame([(BIB,)], "x string")
    assert df.select(F.size(B.split_entries("x"))).first()[0] == 3


@pytest.mark.parametrize("sep", ["\n\n\n", "\r\n\r\n\r\n"])
def test_records_of_either_line_end(spark, sep):
    p = fresh(spark, "records")
    text = sep.join(["rec one\r\nline two", "rec two", "rec three"])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(p)
    for line_sep in ("\n\n\n", "\r\n\r\n\r\n"):
        got = [r.text for r in RD.read_text_records(spark, p, split_files=True, line_sep=line_sep).orderBy("record_id").collect()]
        assert got == ["rec one\nline two", "rec two", "rec three"]


def test_malformed_lines_keep_their_text(spark):
    p = fresh(spark, "jsonl")
    spark.createDataFrame([('{"a": 1}',), ("{broken",), ('{"a": 2}',)], "value string").coalesce(1).write.text(p)
    got = RD.read_jsonl(spark, p, T.StructType([T.StructField("a", T.LongType())])).collect()
    assert sorted((r.a is None, r.a, r["_corrupt_record"]) for r in got if r.a is not None) == [(False, 1, None), (False, 2, None)]
    assert [r["_corrupt_record"] for r in got if r.a is None] == ["{broken"]


def test_unparsable_json_file_is_an_error_row(spark):
    p = fresh(spark, "json")
    spark.createDataFrame([('{"a": [1, {"b": null}]}',)], "value string").coalesce(1).write.text(p)
    docs = RD._whole_files(spark, p, "*.txt", False)
    assert docs.count() == 1 and docs.first().text.startswith('{"a"')


def test_binary_listing(spark):
    p = fresh(spark, "bin")
    spark.createDataFrame([("x",), ("yy",)], "value string").repartition(2).write.text(p)
    got = RD.list_binary_docs(spark, p, ".TXT", with_content=True).collect()
    assert sorted(r.length for r in got) == [2, 3] and not any(r.is_empty for r in got)
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{p}/an empty+one.Txt")
    empty.getFileSystem(spark._jsc.hadoopConfiguration()).create(empty).close()
    got = [r for r in RD.list_binary_docs(spark, p, ".txt").collect() if r.is_empty]
    assert [(r.name, r.length, r.mtime) for r in got] == [("an empty+one", 0, None)] and got[0].path.endswith("/an empty+one.Txt")


def test_shards_are_full_and_listed(spark):
    p = fresh(spark, "shards")
    df = spark.range(250).select(F.col("id").alias("cid"), F.lit("t").alias("text")).repartition(4)
    man = SK.save_index(df, p, "cid", shard_size=100).first()
    assert (man.total_docs, man.num_shards, list(man.shards)) == (250, 3, ["shard_no=0", "shard_no=1", "shard_no=2"])
    sizes = {r.shard_no: r["count"] for r in spark.read.parquet(f"{p}/shards").groupBy("shard_no").count().collect()}
    assert sizes == {0: 100, 1: 100, 2: 50}
    assert SK.load_index(spark, p, "cid").count() == 250


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Empty:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Empty)})

    fake = type("Spark", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
