"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes: each byte adds its table value to the hash shifted left,
so a 16-bit hash sees the last 16 bytes and a cut follows the content, not the position.
Bytes inserted before a passage move its chunks but do not change them. Chunks are compared
by a 128-bit digest. A chunk's first occurrence stays: in the document with the smallest id,
and there at its first place. Runs of repeated chunks of at least `min_bytes` are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import stored

GEAR = np.random.default_rng(2024).integers(0, 1 << 16, size=256, dtype=np.uint16)
FREQUENT = 4096
FLAGS = "id long, mark long, start int, size int, low long, high long, fresh boolean"


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the 16 bytes up to each position: the window doubles in four steps."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint16(step)
        h = wider
    return h


def cuts(text: bytes, least: int, bits: int, most: int) -> list[int]:
    """Ends of the chunks: where the hash's top bits are zero, `least` to `most` bytes apart."""
    if not text:
        return []
    out, start, n = [], 0, len(text)
    for c in (np.flatnonzero(gear(np.frombuffer(text, dtype=np.uint8)) >> np.uint16(16 - bits) == 0) + 1).tolist():
        while c - start > most:
            start += most
            out.append(start)
        if c - start >= least:
            out.append(c)
            start = c
    while n - start > most:
        start += most
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, least: int, bits: int, most: int) -> DataFrame:
    """A row per chunk: its place, its digest as two longs, and whether it is its own text's first of that digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, marks, starts, sizes, digests, fresh = [], [], [], [], [], []
                for k in range(at, min(at + 64, batch.num_rows)):
                    text = batch.column(2)[k].as_py() or b""
                    start, seen = 0, set()
                    ends = cuts(text, least, bits, most)
                    ids.append(np.full(len(ends), batch.column(0)[k].as_py()))
                    marks.append(np.full(len(ends), batch.column(1)[k].as_py()))
                    for end in ends:
                        digest = hashlib.blake2b(text[start:end], digest_size=16).digest()
                        starts.append(start)
                        sizes.append(end - start)
                        digests.append(digest)
                        fresh.append(digest not in seen)
                        seen.add(digest)
                        start = end
                pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(marks), pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()),
                    pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(fresh, pa.bool_())], ["id", "mark", "start", "size", "low", "high", "fresh"])

    return docs.select(_number(id_col, text_col).alias("id"), F.xxhash64(text_col).alias("mark"),
                       F.col(text_col).cast("binary").alias("text")).mapInArrow(run, FLAGS)


def _number(id_col: str, text_col: str) -> Column:
    """The id; texts without one are documents of their own, in the upper half of the numbers, by a hash of the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(text_col), 3) + F.lit(3 << 61))


def removed_spans(text: bytes, spans: list[tuple[int, int]], min_bytes: int) -> list[tuple[int, int]]:
    """Runs of adjoining (start, size), at least min_bytes long, drawn in to whole characters."""
    runs: list[list[int]] = []
    for start, size in sorted(spans):
        if runs and runs[-1][1] == start:
            runs[-1][1] = start + size
        else:
            runs.append([start, start + size])
    out = []
    for start, end in runs:
        if end - start < min_bytes:
            continue
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if end > start:
            out.append((start, end))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 16, bits: int = 5, most: int = 128,
          min_bytes: int = 80) -> DataFrame:
    """(id, n_bytes, n_repeated, n_removed, n_spans, text) of each row of docs; text is what is left.

    n_repeated counts the bytes in chunks that occur more than once anywhere. Null and empty
    texts have no chunks and give an empty text. Rows that share an id count as one document,
    and of repeated rows each has its result. Unlike texts with null ids are documents of their
    own and count as larger than any id below 6e18. Other columns are ignored. No rows give
    no rows.
    """
    pieces = chunks(docs, id_col, text_col, least, bits, most)
    repeated = stored(pieces.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"))
    # Fewer than FREQUENT digests can hold a share of 1 / FREQUENT each: they are looked up where the chunks
    # lie, and their chunks go on under a hash of their own place, which spreads them and meets nothing.
    heavy = F.col("n") > (repeated.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    often = F.broadcast(repeated.filter(heavy).select("low", "high", F.col("first").alias("often")))
    known = F.col("often").isNotNull()
    marked = pieces.join(often, ["low", "high"], "left").withColumns({
        "low": F.when(known, F.xxhash64("mark", "start", "id")).otherwise(F.col("low")), "high": F.when(known, F.lit(0)).otherwise(F.col("high"))})
    seldom = repeated.filter(~heavy).select("low", "high", "first")
    first = F.coalesce("often", "first")
    found = marked.join(seldom, ["low", "high"], "left").filter(first.isNotNull()).groupBy("id", "mark").agg(
        F.collect_set(F.struct("start", "size", (~F.col("fresh") | (F.col("id") > first)).alias("goes"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or b""
                flags = batch.column(2)[k].as_py() or []
                spans = removed_spans(text, [(f["start"], f["size"]) for f in flags if f["goes"]], min_bytes)
                left, at = [], 0
                for start, end in spans:
                    left.append(text[at:start])
                    at = end
                left.append(text[at:])
                row = (len(text), sum(f["size"] for f in flags), sum(e - s for s, e in spans), len(spans), b"".join(left).decode("utf-8", "replace"))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string())],
                                             ["id", "n_bytes", "n_repeated", "n_removed", "n_spans", "text"])

    keyed = docs.select(F.col(id_col).cast("long").alias("own"), _number(id_col, text_col).alias("id"),
                        F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"))
    joined = keyed.join(found, ["id", "mark"], "left").select("own", "text", "found")
    return joined.mapInArrow(run, "id long, n_bytes long, n_repeated long, n_removed long, n_spans long, text string").withColumnRenamed("id", id_col)
