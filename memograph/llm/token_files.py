"""Token ids in files of patched frame-of-reference blocks.

A file holds the texts of one id range in ascending id order, ids of all texts one after the
other, cut into blocks of 512. A block stores its minimum and packs the differences at the
width that holds a percentile of them; larger ones are exceptions, kept whole in lists of
position and value. The start of every block is indexed, so any block can be read alone.

Layout, little-endian:
  header   "PFR1", u32 ids per block, u64 ids, u64 texts
  blocks   u32 minimum, u8 width, u16 exceptions, packed words (16 lanes), u16 positions, u32 values
  index    u64 start of each block
  texts    i64 id of each text, u8 whether the id is null, u64 end of each text among the file's ids
  footer   u64 start of index, u64 start of texts, "PFR1"

Each task writes a new file and reports it; the manifest, a table that Spark commits, lists the
files that count. A lost executor's files are written anew under other names and never listed twice.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memograph.llm.bpe import BLOCK_BYTES, encode_blocks
from memograph.llm.common import blocks_for, partitions, stored
from memograph.plans.ranking import with_running_total
from memograph.session import run_folder

MAGIC = b"PFR1"
PER_BLOCK, LANES = 512, 16
LAST_ID = (1 << 63) - 1
ROW_BYTES = 1024  # what a row counts for beside its text


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 512) values below 2**width as (n, width * 16) words: 32 rows of 16 lanes, packed lane by lane."""
    rows = values.reshape(len(values), 32, LANES).astype(np.uint32)
    out = np.zeros((len(values), width, LANES), dtype=np.uint32)
    for r in range(32):
        word, shift = divmod(r * width, 32)
        if width:
            out[:, word] |= rows[:, r] << np.uint32(shift)
            if shift + width > 32:
                out[:, word + 1] |= rows[:, r] >> np.uint32(32 - shift)
    return out.reshape(len(values), width * LANES)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 32, LANES), dtype=np.uint32)
    if width:
        words = words.reshape(len(words), width, LANES)
        mask = np.uint32((1 << width) - 1)
        for r in range(32):
            word, shift = divmod(r * width, 32)
            value = words[:, word] >> np.uint32(shift)
            if shift + width > 32:
                value = value | (words[:, word + 1] << np.uint32(32 - shift))
            out[:, r] = value & mask
    return out.reshape(len(words), PER_BLOCK)


def encode_ids(ids: np.ndarray, percentile: float) -> list[bytes]:
    """The blocks of a file. The last block is filled up with its last id."""
    n = -(-len(ids) // PER_BLOCK)
    if not n:
        return []
    full = np.full(n * PER_BLOCK, ids[-1], dtype=np.uint32)
    full[:len(ids)] = ids
    full = full.reshape(n, PER_BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    rank = min(PER_BLOCK - 1, max(0, int(np.ceil(percentile / 100 * PER_BLOCK)) - 1))
    chosen = np.partition(rest, rank, axis=1)[:, rank].astype(np.int64)
    width = np.where(chosen > 0, np.frexp(chosen.astype(np.float64))[1], 0)
    limit = (np.int64(1) << width) - 1
    large = rest > limit[:, None]
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        words = pack(np.where(large[at], 0, rest[at]), int(w))
        for k, packed in zip(at.tolist(), words):
            where = np.flatnonzero(large[k])
            out[k] = b"".join((struct.pack("<IBH", low[k], w, len(where)), packed.tobytes(), where.astype("<u2").tobytes(), rest[k][where].astype("<u4").tobytes()))
    return out


def decode_ids(data: bytes, starts: np.ndarray, count: int) -> np.ndarray:
    """The ids of the blocks at these starts, the first `count` of them."""
    heads = [struct.unpack_from("<IBH", data, s) for s in starts.tolist()]
    out = np.zeros((len(starts), PER_BLOCK), dtype=np.uint32)
    widths = np.array([h[1] for h in heads], dtype=np.int64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        size = int(w) * LANES
        words = np.stack([np.frombuffer(data, "<u4", size, starts[k] + 7) for k in at])
        out[at] = unpack(words, int(w))
    for k, (low, w, n) in enumerate(heads):
        if n:
            at = int(starts[k]) + 7 + 4 * LANES * w
            out[k, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
        out[k] += np.uint32(low)
    return out.ravel()[:count]


def file_bytes(ids: np.ndarray, texts: list[int | None], sizes: np.ndarray, percentile: float) -> bytes:
    blocks = encode_ids(ids, percentile)
    head = MAGIC + struct.pack("<IQQ", PER_BLOCK, len(ids), len(texts))
    starts = len(head) + np.cumsum([0, *map(len, blocks)], dtype=np.int64)
    index_at = int(starts[-1])
    texts_at = index_at + 8 * len(blocks)
    known = np.array([t or 0 for t in texts], dtype="<i8").tobytes() + bytes(t is None for t in texts)
    return b"".join((head, *blocks, starts[:-1].astype("<u8").tobytes(), known, np.cumsum(sizes).astype("<u8").tobytes(), struct.pack("<QQ", index_at, texts_at), MAGIC))


def parse_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(ids of the texts, end of each text, token ids) of a whole file."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a token file")
    per, count, n = struct.unpack_from("<IQQ", data, 4)
    index_at, texts_at = struct.unpack_from("<QQ", data, len(data) - 20)
    starts = np.frombuffer(data, "<u8", -(-count // per), index_at).astype(np.int64)
    ids, absent = np.frombuffer(data, "<i8", n, texts_at), data[texts_at + 8 * n:texts_at + 9 * n]
    ends = np.frombuffer(data, "<u8", n, texts_at + 9 * n).astype(np.int64)
    return [None if gone else int(i) for i, gone in zip(ids, absent)], ends, decode_ids(data, starts, count)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, which the driver has named with its scheme."""
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark's default file system understands it, scheme included: tasks do not guess."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def cuts_by_bytes(rows: DataFrame, blocks: int) -> list[tuple[int, bool, int]]:
    """First (id, absent, mark) of every block but the first, of blocks of about BLOCK_BYTES of text, `blocks` or more of them.

    A key with many rows may begin several blocks. One tuple for each block passes through the driver.
    """
    order = ["id", "absent", "mark"]
    placed = stored(with_running_total(rows, [], [F.col(c) for c in order], F.col("bytes")))
    total = placed.agg(F.max(F.col("before") + F.col("bytes"))).first()[0] or 0
    share = -(-total // max(blocks, blocks_for(total, BLOCK_BYTES))) or 1
    firsts = placed.groupBy(F.floor(F.col("before") / share).alias("block")).agg(F.min(F.struct(*order)).alias("first"))
    return sorted((r["first"]["id"], r["first"]["absent"], r["first"]["mark"]) for r in firsts.filter("block > 0").collect())


def block_of(cuts: list[tuple[int, bool, int]]) -> Callable[..., Column]:
    """The block of a row by (id, absent, mark); rows of a key that begins several blocks spread over them by their number."""
    ids = np.array([c[0] for c in cuts], dtype=np.int64)

    @F.pandas_udf("long")
    def place(key: pd.Series, absent: pd.Series, mark: pd.Series, row: pd.Series) -> pd.Series:
        keys = key.to_numpy()
        low, high = np.searchsorted(ids, keys, side="left"), np.searchsorted(ids, keys, side="right")
        for k in np.flatnonzero(high > low).tolist():
            own = (int(keys[k]), bool(absent.iloc[k]), int(mark.iloc[k]))
            first, last = bisect_left(cuts, own, low[k], high[k]), bisect_right(cuts, own, low[k], high[k])
            low[k] = first + int(row.iloc[k]) % (last - first + 1)
        return pd.Series(low)

    return place


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, percentile: float = 99.0,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append the end id and write the ids in ascending id order; returns the manifest.

    Manifest: (block, path, n_texts, n_ids, start), one row per file in id order; start counts the ids of
    all files before. Null and empty texts have the end id alone. Rows that share an id follow each other by a
    hash of their text; null ids come last. Other columns of docs are ignored. No rows give no files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or run_folder(spark, "tokens"))
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(text_col)
    absent = F.col(id_col).cast("long").isNull()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES
    cuts = cuts_by_bytes(docs.select(key.alias("id"), absent.alias("absent"), mark.alias("mark"), size.alias("bytes")),
                         2 * partitions(spark))
    block = block_of(cuts)(key, absent, mark, F.monotonically_increasing_id()) if cuts else F.lit(0).cast("long")
    texts = docs.select(block.alias("block"), F.col(id_col).cast("long").alias("id"), mark.alias("mark"), F.col(text_col).cast("binary").alias("text"))

    def finish(block: int, rows: pa.Table, ids: np.ndarray, sizes: np.ndarray) -> pa.Table:
        own, marks = rows["id"].to_pylist(), rows["mark"].to_numpy()
        order = np.array(sorted(range(len(own)), key=lambda k: (own[k] is None, own[k] or 0, marks[k])), dtype=np.int64)
        ends = np.cumsum(sizes)
        pieces = []
        for k in order:
            pieces += [ids[ends[k] - sizes[k]:ends[k]], np.array([end_id], dtype=np.uint32)]
        data = file_bytes(np.concatenate(pieces), [own[k] for k in order], sizes[order] + 1, percentile)
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        name = f"block-{block:08d}-{uuid.uuid4().hex}.pfr"
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
        return pa.table({"block": [block], "path": [f"{folder}/{name}"], "n_texts": [len(own)], "n_ids": [int(sizes.sum()) + len(own)]})

    files = stored(encode_blocks(texts, path, finish, "block long, path string, n_texts long, n_ids long", len(cuts) + 1))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(id, start, ids) of every text in the manifest's files: its place among all ids, and its ids as binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                system, place = open_folder(batch.column(0)[k].as_py())
                with system.open_input_stream(place) as source:
                    own, ends, ids = parse_file(source.read())
                starts = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(own), 1000):
                    s, e = starts[at:at + 1000], ends[at:at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(own[at:at + 1000], pa.int64()), pa.array(s + batch.column(1)[k].as_py()),
                                                      pa.array([ids[a:b].tobytes() for a, b in zip(s, e)], pa.binary())], ["id", "start", "ids"])

    return manifest.select("path", "start").repartition(2 * partitions(spark), "path").mapInArrow(run, "id long, start long, ids binary")
