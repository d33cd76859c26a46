"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "memograph", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster spark-submit supplies master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names, else a local one for tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.environ.setdefault("MEMOGRAPH_LOCAL_CHECKPOINTS", tempfile.mkdtemp(prefix="memograph-"))
    return folder


def application_folder(spark: SparkSession) -> str:
    """Where one application keeps its intermediate tables."""
    return f"{shared_folder(spark).rstrip('/')}/memograph-{spark.sparkContext.applicationId}"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new, never reused folder below the application's."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a loop's intermediate result and read it back: survives lost executors."""
    spark = df.sparkSession
    path = run_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
