"""Importance resampling towards a target distribution by bit-sliced aggregation.

A text's features, runs of one to `runs` words, fall into `buckets` by crc32. What the corpus
and the target hold of each bucket gives the bucket's gain, a whole number. A document's
weight is the mean gain of its features, and the sum behind it is exact: bit i of all its
bucket counts is one plane of `buckets` bits, bit j of all gains another, and the ones that
both have count 2**(i + j) each. The gains' top plane is their sign and counts negatively.

Documents are drawn by the highest weight with Gumbel noise from their id's digest, which is
sampling without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import stored
from memograph.plans.ranking import with_rank

PIECE = 1 << 20
GROUP = 64
LONG = 256
#: Every ASCII character outside 0-9, A-Z and a-z parts words; A-Z are lower-cased.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(step, shift): the crc32 step of a byte, and what byte k of a crc becomes when n zero bytes follow, at [n, 256 * k + byte]."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    shift = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LONG):
        shift.append((shift[-1] >> np.uint32(8)) ^ step[shift[-1] & np.uint32(255)])
    return step, np.stack(shift)


STEP, SHIFT = _crc_tables()
ONES = np.uint32(0xFFFFFFFF)


def word_crcs(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of every word, all words a byte further at a time, the longest first."""
    order = np.argsort(-length, kind="stable")
    begin, sizes = start[order], length[order]
    crc = np.full(len(order), ONES)
    for at in range(min(LONG, int(length.max(initial=0)))):
        n = np.searchsorted(-sizes, -at, side="left")  # words with more than `at` bytes
        crc[:n] = STEP[(crc[:n] ^ text[begin[:n] + at]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = crc ^ ONES
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = zlib.crc32(text[start[k]:start[k] + length[k]])
    return out


def run_crcs(text: np.ndarray, start: np.ndarray, length: np.ndarray, runs: int) -> Iterator[np.ndarray]:
    """For each n below `runs`, crc32 of the n + 1 words from every word on, joined by one space, without spelling them."""
    words = word_crcs(text, start, length)
    current = words
    yield current
    for n in range(1, runs):
        spaced = current[:-1] ^ ONES
        spaced = STEP[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8)) ^ ONES
        size = length[n:]
        short = np.minimum(size, LONG)
        current = words[n:].copy()
        for k in range(4):
            current ^= SHIFT[short, (spaced >> np.uint32(8 * k) & np.uint32(255)) + np.uint32(256 * k)]
        for k in np.flatnonzero(size > LONG).tolist():
            current[k] = zlib.crc32(text[start[n + k]:start[n + k] + size[k]], int(spaced[k]))
        yield current


def portions(texts: list[bytes | None], runs: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """(text number, lowered bytes, sign) in portions of about a megabyte.

    A longer text comes in pieces that end between words. Each begins with the last words of
    the one before, and what these hold on their own is taken off again.
    """
    out: list[tuple[int, bytes, int]] = []
    size = 0
    for k, text in enumerate(texts):
        text = (text or b"").translate(LOWERED)
        at, tail = 0, b""
        while at < len(text):
            end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            out.append((k, tail + text[at:end], 1))
            if tail:
                out.append((k, tail, -1))
            size += end - at
            if end < len(text) and runs > 1:
                tail = b" ".join((tail + text[at:end]).split()[-(runs - 1):])
            at = end
            if size >= PIECE:
                yield out
                out, size = [], 0
    if out:
        yield out


def bucket_counts(texts: list[bytes | None], buckets: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the count of every bucket, and the number of words."""
    counts, words = np.zeros((len(texts), buckets), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for portion in portions(texts, runs):
        text = np.frombuffer(b" ".join(t for _, t, _ in portion) + b" ", dtype=np.uint8)
        edges = np.flatnonzero(np.diff((text != 32).view(np.int8), prepend=np.int8(0)))
        start, length = edges[::2], edges[1::2] - edges[::2]
        begins = np.cumsum([0, *[len(t) + 1 for _, t, _ in portion]])
        of = np.searchsorted(begins, start, side="right") - 1
        found = np.zeros(len(portion) * buckets, dtype=np.int64)
        for n, crc in enumerate(run_crcs(text, start, length, runs)):
            one = of[:len(crc)] == of[n:]
            found += np.bincount((of[:len(crc)] * buckets + crc % np.uint32(buckets))[one], minlength=len(found))
        each = np.bincount(of, minlength=len(portion))
        for at, (k, _, sign) in enumerate(portion):
            counts[k] += sign * found[at * buckets:(at + 1) * buckets]
            words[k] += sign * each[at]
    return counts, words


def totals(texts: DataFrame, buckets: int, runs: int, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket; every task sums its own before they meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                counts += bucket_counts(batch.column(0).slice(at, GROUP).to_pylist(), buckets, runs)[0].sum(axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln(ratio of the smoothed shares)) of each bucket; the tables hold one row a bucket at most."""
    held, wanted = np.zeros(buckets), np.zeros(buckets)
    for side, frame in ((held, corpus), (wanted, target)):
        for bucket, n in frame.select("bucket", "n").collect():
            side[bucket] = n
    return np.floor(1000 * np.log((wanted + 1) * (held.sum() + buckets) / ((held + 1) * (wanted.sum() + buckets)))).astype(np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, rows, words): bit i of every value of a row, 64 to a word."""
    rows, n = values.shape
    out = np.zeros((bits, rows, -(-n // 64) * 8), dtype=np.uint8)
    for i in range(bits):
        out[i, :, :-(-n // 8)] = np.packbits((values >> i & 1).astype(np.uint8), axis=1)
    return out.view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Planes of the gains in two's complement with what a one in each counts; the last is the sign."""
    bits = int(np.abs(gain).max(initial=1)).bit_length()
    return planes(gain[None, :], bits + 1)[:, 0], [1 << j for j in range(bits)] + [-(1 << bits)]


def weighed(counts: np.ndarray, gain: np.ndarray, worth: list[int]) -> np.ndarray:
    """Sum of count times gain of each row, from the planes alone."""
    out = np.zeros(len(counts), dtype=np.int64)
    held = planes(counts, int(counts.max(initial=1)).bit_length())
    for i, plane in enumerate(held):
        for j, bits in enumerate(gain):
            out += (np.bitwise_count(plane & bits).sum(axis=1, dtype=np.int64) << i) * worth[j]
    return out


def weigh(docs: DataFrame, gain: np.ndarray, buckets: int, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row of docs."""
    bits, worth = gain_planes(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                counts, words = bucket_counts(part.column(1).to_pylist(), buckets, runs)
                features = counts.sum(axis=1)
                weight = weighed(counts, bits, worth) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                                                 ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, runs: int = 2, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each row of docs, drawn rows with their rank.

    Of the rows with `least_words` words, the share `percent` with the highest scores is
    drawn, ties to the smaller id, null ids last. Null and empty texts have no features and
    weight 0. Repeated rows are rows of their own and may both be drawn. An empty target
    leaves its buckets with the smoothing alone. Other columns are ignored. No rows give no rows.
    """
    gain = gains(totals(docs, buckets, runs, text_col), totals(target, buckets, runs, target_col), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = stored(weigh(docs, gain, buckets, runs, id_col, text_col).withColumn("score", F.col("weight") + noise))
    able = rows.filter(F.col("n_words") >= least_words)
    # Rows that are alike in everything are interchangeable: any order among them gives the same result.
    ranked = with_rank(able, [F.desc("score"), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_words")], "rank")
    drawn = F.floor(F.lit(percent) * F.lit(able.count()) / 100)
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).withColumnRenamed("id", id_col)
