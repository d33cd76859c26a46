"""Splitting whole documents into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine, chunk size and overlap.
SEPARATORS = ["\n\n", "\n", " ", ""]
CHUNK_SIZE = 600
CHUNK_OVERLAP = 100


def fixed_windows(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Overlapping windows of fixed length; the end offset is not clipped to the text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.length("content") - 1, F.lit(step))
    windows = docs.filter(F.length("content") > 0).select(
        *[c for c in docs.columns if c != "content"], "content", F.posexplode(starts).alias("chunk_index", "start_pos")
    )
    return windows.select(
        *[c for c in docs.columns if c != "content"], "chunk_index", "start_pos",
        (F.col("start_pos") + size).alias("end_pos"),
        F.substring(F.col("content"), F.col("start_pos") + 1, F.lit(size)).alias("text"),
    )


def _pieces(body: str, separator: str) -> list[str]:
    """Cut at a separator, leaving it at the front of what follows."""
    if not separator:
        return list(body)
    head, *rest = body.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy runs of pieces up to size, each run restarting with at most `overlap` trailing characters."""
    chunks: list[str] = []
    first = total = 0
    for at, piece in enumerate(pieces):
        if total + len(piece) > size and at > first:
            chunks.append("".join(pieces[first:at]).strip())
            while first < at and (total > overlap or total + len(piece) > size):
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    if first < len(pieces):
        chunks.append("".join(pieces[first:]).strip())
    return [c for c in chunks if c]


def split_text(body: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, level: int = 0) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that occurs."""
    while SEPARATORS[level] and SEPARATORS[level] not in body:
        level += 1
    chunks: list[str] = []
    run: list[str] = []
    for piece in _pieces(body, SEPARATORS[level]):
        if len(piece) < size:
            run.append(piece)
            continue
        chunks += _pack(run, size, overlap)
        run = []
        if level + 1 < len(SEPARATORS):
            chunks += split_text(piece, size, overlap, level + 1)
        else:
            chunks.append(piece)
    return chunks + _pack(run, size, overlap)


def recursive_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Separator-aware chunks; each Arrow batch is split where it lies, with no shuffle."""

    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda body: split_text(body, size, overlap) if body else [])

    kept = [c for c in docs.columns if c != "content"]
    return docs.select(*kept, chunks("content").alias("_chunks")).select(
        *kept, F.posexplode("_chunks").alias("chunk_index", "text")
    )


def with_chunk_ids(chunks: DataFrame, doc_id: str = "id") -> DataFrame:
    return chunks.withColumn("chunk_id", F.md5(F.concat_ws("|", doc_id, F.col("chunk_index").cast("string"))))
