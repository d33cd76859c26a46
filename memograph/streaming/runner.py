"""Run a stream over everything that has landed and read its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.operators.upsert import keep_by
from memograph.session import STATE_STORE, run_folder


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a new Parquet table with its own checkpoint.

    Update mode writes every changed row with its batch number; latest() keeps
    the last of each key. Complete mode writes all rows with each batch; last_batch()
    keeps what stands at the end.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Sessions of a busy key are merged inside each task before they are shuffled.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    out, checkpoint = run_folder(spark, f"{name}-out"), run_folder(spark, f"{name}-log")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        schema = spark.createDataFrame([], stream.schema).withColumn("batch_no", F.lit(0).cast("long")).schema

        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("batch_no", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("basePath", out).parquet(out).select(*schema.names)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return keep_by(rows, keys, ["batch_no"], newest=True).drop("batch_no")


def last_batch(rows: DataFrame) -> DataFrame:
    """Rows of the newest batch; earlier ones hold sessions that later rows have merged."""
    newest = rows.agg(F.max("batch_no")).first()[0]
    return rows.filter(F.col("batch_no") == F.lit(newest)).drop("batch_no")
