"""Webhook streams: raw payloads to events and subscription state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from memograph.operators.upsert import keep_by
from memograph.sources import webhooks
from memograph.streaming.detectors import deduplicate


def read_payloads(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed payload files as a stream."""
    return spark.readStream.schema(webhooks.PAYLOAD_COLUMNS).format(fmt).load(path)


def event_stream(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events of all payload kinds, each webhook id once."""
    return webhooks.events(deduplicate(raw, delay))


def billing_log(raw: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends each trigger's subscription changes, ends included, to a table partitioned by batch.

    A batch that is repeated after a failure overwrites its own partition, and a
    webhook that is sent twice is counted once when the table is read.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        rows = webhooks.billing_changes(batch).withColumn("batch", F.lit(epoch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def subscription_table(spark: SparkSession, path: str) -> DataFrame:
    """Latest plan of each workspace from the changes logged so far, whatever their batches.

    An end names only its subscription, so it needs the sets before it, which may
    lie in any earlier batch.
    """
    changes = spark.read.parquet(path).drop("batch")
    once = keep_by(changes, ["webhook_event_id"], ["ts", "change", "subscription_id"], newest=True)
    return webhooks.subscriptions(once)
