"""Document pipeline over the training-data operators.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All but the last keep the columns of ``documents``.

1. quality: documents whose probability of the top grade is too low go.
2. exact_dedup: of equal texts, the largest doc_id stays.
3. near_dedup: of each group linked by five-word shingles of Jaccard 0.8 or
   more, the smallest doc_id stays.
4. decontaminate: documents with benchmark passages go.
5. pack: token pieces of all documents in sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.llm.common import discard, read, stored
from papertrail.llm.decontaminate import drop_contaminated
from papertrail.llm.exact_dedup import dedup
from papertrail.llm.jaccard_join import one_of_each
from papertrail.llm.packing import pack
from papertrail.llm.quality import ratings_of, select_top, train
from papertrail.session import ensure_checkpoint_dir

#: Of the packer's chunk cache, which lies beside the memory that the earlier stages have filled.
CACHE_ENTRIES = 1 << 17
#: Rows of whole texts that go to Python at once, where the session does not say.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own default
        spark.conf.set(key, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return select_top(docs, train(docs, ratings_of(read(spark, sf_dir, "labels"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    return dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    return one_of_each(docs, words=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_entries=CACHE_ENTRIES)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return docs
