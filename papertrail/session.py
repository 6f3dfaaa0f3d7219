"""Session and table helpers.

Everything here is configuration: the library itself never creates a
session on its own except through :func:`get_spark`, which tests, the
bench and the entry point use.  On a cluster the caller passes its own
session and the settings below are only defaults applied where unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Defaults for local runs.  Cluster deployments override these with
# spark-submit --conf; AQE re-plans shuffles and splits skewed joins.
_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # checkpoint files of dropped DataFrames are removed by Spark's cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # duplicate keys in maps built from user data: later value wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # the rule adds size(arr) > 0 before every explode, which evaluates
    # array-building expressions (tokenisation, windows) twice per row
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def get_spark(master: str | None = None, app: str = "papertrail", **conf) -> SparkSession:
    master = master or os.environ.get("PAPERTRAIL_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**_LOCAL_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...)
    folder and is used as is.  Only in a local session that has none (tests)
    a fresh scratch folder is created; a cluster without one is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="papertrail-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)  # operators checkpoint into the shared folder
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores when the scan yields fewer
    partitions than cores (a single Parquet row group is read by one
    task).  Large inputs already have many splits and pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(p) or "://" in p:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
