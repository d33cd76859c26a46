"""Micro-batch ingest: documents to tagged chunks and events in keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from memograph.functions.embedding import Embedder
from memograph.operators import chunking, entities, extraction, normalize
from memograph.sources import sinks
from memograph.streaming import maintain as maintenance


def process(docs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Chunks with payload and the events found in them, for one batch of raw documents.

    A document without a time of its own gets `as_of`, the time of ingest.
    """
    clean = normalize.normalize(normalize.standardize(docs, as_of))
    cut = chunking.with_chunk_ids(chunking.recursive_chunks(clean))
    chunks = entities.payload(entities.tag(cut))
    return chunks, extraction.chunk_events(chunks)


def batch_writer(chunk_path: str, event_path: str, as_of: Column) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: rewrites the touched partitions, so a repeated batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        chunks, events = process(batch, as_of)
        sinks.upsert(chunks.select(
            "workspace_id", "chunk_id", "text", "source", "author", "ts", "entities", F.to_date("ts").alias("date"),
            F.lit(epoch).cast("long").alias("seen_at")), chunk_path, ["chunk_id"], ["seen_at"], ["workspace_id", "date"])
        sinks.upsert(events.select(
            "workspace_id", "event_id", "event_type", "title", "summary", "ts", "entities", "source_refs",
            F.to_date("ts").alias("date"), F.lit(epoch).cast("long").alias("seen_at")),
            event_path, ["event_id"], ["seen_at"], ["workspace_id", "date"])

    return write


def ingest(stream: DataFrame, chunk_path: str, event_path: str, checkpoint: str, as_of: Column) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(batch_writer(chunk_path, event_path, as_of)).option("checkpointLocation", checkpoint)


def maintain(stream: DataFrame, store: maintenance.Maintained, checkpoint: str, embed: Embedder) -> DataStreamWriter:
    """Ingest with everything that hangs on chunks and events kept in step; see `maintain`."""

    def shaped(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        chunks, events = process(batch, store.as_of)
        return chunks.withColumns({"embedding": embed(F.col("text")), "seen_at": F.unix_micros("ts")}), events

    return stream.writeStream.foreachBatch(maintenance.batch_writer(store, shaped)).option("checkpointLocation", checkpoint)
