"""Removal of long repeated byte strings with a sparse suffix array.

A string of `length` bytes is repeated when it also starts somewhere else. Not every suffix
is sorted: each string picks as anchor the smallest 8-byte hash among its first `span`
positions, leftmost on ties, so equal strings pick the same anchor and one suffix about every
span / 2 bytes is enough. A suffix can only matter if its leading bytes, `length - span + 1`
of them, occur at another anchor; counting a hash of these leaves few suffixes.

The suffixes that are left are range-partitioned by their leading bytes. The splitters come
from a sample of these bytes that the first pass keeps, so nothing is computed twice for
them. Equal leading bytes always share a bucket, so suffixes on both sides of a bucket
boundary differ within them and no match crosses it. A bucket sorts its suffixes by multikey
quicksort, and what stands before the anchors, reversed, likewise. Common prefix lengths of
neighbours then give classes: a string is repeated exactly if another has the same class
before and after the anchor. Leading bytes with more than `group_cap` suffixes do not form a
group in one task; all their strings are counted by a 128-bit digest in an ordinary
aggregation instead.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import partitions, stored

GRAM, LOW = 8, 20
PIECE = 1 << 19
LAST_ID = (1 << 63) - 1
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))  # odd multipliers
SMALL = 32
SAMPLED = 64  # one leading string in so many is kept for the splitters
PER_SPLITTER = 8
CHUNK = 1 << 17
WITNESS = 2


def anchors(text: bytes, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each anchor with the range of string starts that pick it, in order."""
    found = [_anchors(text[at:at + PIECE + length - 1], length, span, at) for at in range(0, len(text) - length + 1, PIECE)]
    return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (zip(*found) if found else ((), (), ())))


def _anchors(text: bytes, length: int, span: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = len(text) - length + 1
    x = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    x = x[:starts + span - 1] * MIX[0]
    x ^= x >> np.uint64(32)
    x *= MIX[1]
    x ^= x >> np.uint64(29)
    # The position fills the low bits: the smallest key is the leftmost of equal hashes.
    key = (x >> np.uint64(LOW) << np.uint64(LOW)) | np.arange(len(x), dtype=np.uint64)
    blocks = -(-len(key) // span)
    grid = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:len(key)] = key
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    pick = (np.minimum(behind[:starts], ahead[span - 1:span - 1 + starts]) & np.uint64((1 << LOW) - 1)).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    return pick[change] + base, change + base, np.concatenate([change[1:], [starts]]) - 1 + base


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of big-endian words: three-way radix quicksort, one word a step."""
    n, width = words.shape
    out, at = np.empty(n, dtype=np.int64), 0
    stack = [(np.arange(n), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= SMALL or depth == width:
            if depth < width and len(rows) > 1:
                rows = rows[sorted(range(len(rows)), key=lambda k: words[rows[k], depth:].tobytes())]
            out[at:at + len(rows)] = rows
            at += len(rows)
            continue
        column = words[rows, depth].astype(np.uint64)
        pivot = np.sort(column[[0, len(column) // 2, len(column) - 1]])[1]
        for part, step in ((column > pivot, 0), (column == pivot, 1), (column < pivot, 0)):
            if part.any():
                stack.append((rows[part], depth + step))
    return out


def matrix(strings: list[bytes]) -> np.ndarray:
    """The strings as rows of big-endian 64-bit words, filled up with zeros."""
    width = -(-max(map(len, strings), default=0) // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=">u8").reshape(len(strings), width // 8)


def common_prefix(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order; 0 for the first."""
    if len(order) < 2 or not words.shape[1]:
        return np.zeros(len(order), dtype=np.int64)
    out = [np.zeros(1, dtype=np.int64)]
    for at in range(1, len(order), 4096):
        differ = words[order[at:at + 4096]].astype(np.uint64) ^ words[order[at - 1:at + 4095][:len(order[at:at + 4096])]].astype(np.uint64)
        some = differ != 0
        word = np.where(some.any(axis=1), some.argmax(axis=1), words.shape[1])
        bits = differ[np.arange(len(differ)), np.minimum(word, words.shape[1] - 1)]
        lead = np.zeros(len(bits), dtype=np.int64)
        for shift in (32, 16, 8):
            empty = bits >> np.uint64(64 - shift) == 0
            lead += empty * (shift // 8)
            bits = np.where(empty, bits << np.uint64(shift), bits)
        out.append(np.where(word < words.shape[1], 8 * word + lead, 8 * words.shape[1]))
    return np.concatenate(out)


def repeated_starts(before: list[bytes], after: list[bytes], place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> list[np.ndarray]:
    """For each suffix the string starts in first..last whose string another suffix has too.

    before ends and after begins at the anchor `place`; they hold what the strings need.
    """
    n = len(place)
    after_words, before_words = matrix(after), matrix([b[::-1] for b in before])
    after_order, before_order = multikey_order(after_words), multikey_order(before_words)
    after_shared, before_shared = common_prefix(after_words, after_order), common_prefix(before_words, before_order)
    closest = np.maximum(after_shared, np.concatenate([after_shared[1:], [0]]))
    deepest = np.empty(n, dtype=np.int64)
    deepest[after_order] = closest  # the longest prefix shared with any other
    least, most = place - last, place - first
    hits: list[list[np.ndarray]] = [[], []]
    after_class, before_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for offset in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= offset) & (offset <= most) & (deepest >= length - offset))
        if len(rows) < 2:
            continue
        after_class[after_order] = np.cumsum(after_shared < length - offset)
        before_class[before_order] = np.cumsum(before_shared < offset)
        both = after_class[rows] * (n + 1) + before_class[rows]
        order = np.argsort(both)
        equal = both[order][1:] == both[order][:-1]
        twice = np.zeros(len(rows), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        hits[0].append(rows[twice])
        hits[1].append(place[rows[twice]] - offset)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n
    if hits[0]:
        rows, starts = np.concatenate(hits[0]), np.concatenate(hits[1])
        order = np.lexsort((starts, rows))
        rows, starts = rows[order], starts[order]
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for part, own in zip(np.split(starts, cuts), rows[np.concatenate([[0], cuts])] if len(rows) else []):
            out[own] = part
    return out


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), starts[np.concatenate([gap, [len(starts) - 1]])].tolist()))


def covered(found: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [from, to) covered by the strings that start in these runs."""
    out: list[list[int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text_col).alias("mark"),
                       F.col(text_col).cast("binary").alias("text"))


def suffixes(texts: DataFrame, length: int, span: int) -> DataFrame:
    """(id, mark, place, first, last, lead, sample) of every anchor; lead is a hash of its leading bytes.

    sample holds the leading bytes where that hash chooses them, and is null elsewhere.
    """
    lead = length - span + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, marks, columns, hashes, samples = [], [], [], [], []
                for k in range(at, min(at + 64, batch.num_rows)):
                    text = batch.column(2)[k].as_py() or b""
                    if len(text) < length:
                        continue
                    found = anchors(text, length, span)
                    ids.append(np.full(len(found[0]), batch.column(0)[k].as_py()))
                    marks.append(np.full(len(found[0]), batch.column(1)[k].as_py()))
                    columns.append(found)
                    own = [xxhash.xxh3_64_intdigest(text[p:p + lead]) for p in found[0].tolist()]
                    hashes += own
                    samples += [text[p:p + lead] if h % SAMPLED == 0 else None for p, h in zip(found[0].tolist(), own)]
                if ids:
                    place, first, last = (np.concatenate(c).astype(np.int32) for c in zip(*columns))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(marks)), pa.array(place), pa.array(first), pa.array(last),
                                                      pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(samples, pa.binary())],
                                                     ["id", "mark", "place", "first", "last", "lead", "sample"])

    return texts.mapInArrow(run, "id long, mark long, place int, first int, last int, lead long, sample binary")


def find(docs: DataFrame, texts: DataFrame, length: int, span: int, group_cap: int) -> DataFrame:
    """(id, mark, runs) of the texts (the rows of docs, dealt by id and mark) with repeated strings: runs of their starts."""
    spark = docs.sparkSession
    lead = length - span + 1
    n = partitions(spark)
    every = stored(suffixes(docs, length, span))
    leads = stored(every.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.max("sample").alias("sample")).filter("n > 1"))
    crowded = (leads.agg(F.max("n")).first()[0] or 0) > group_cap
    # A few leading strings for every bucket, those with the smallest hashes; the driver holds no more than that.
    chosen = leads.filter("sample IS NOT NULL").orderBy("lead").limit(n * PER_SPLITTER).select("sample").collect()
    splitters = sorted(bytes(r["sample"]) for r in chosen)[PER_SPLITTER - 1::PER_SPLITTER]
    kept = every.drop("sample").join(leads.drop("sample"), "lead").groupBy("id", "mark").agg(
        F.collect_set(F.struct("place", "first", "last", (F.col("n") > group_cap).alias("many"))).alias("found"))
    wanted = texts.join(kept, ["id", "mark"]).select("id", "mark", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                found = [f for f in batch.column(3)[k].as_py() if not f["many"]]
                for at in range(0, len(found), 4096):
                    part = found[at:at + 4096]
                    one = pa.array(np.zeros(len(part), dtype=np.int64))
                    leading = [text[f["place"]:f["place"] + lead] for f in part]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0)[k:k + 1].take(one), batch.column(1)[k:k + 1].take(one), *[pa.array([f[c] for f in part], pa.int32()) for c in ("place", "first", "last")],
                        pa.array(leading, pa.binary()), pa.array([text[f["first"]:f["place"]] for f in part], pa.binary()),
                        pa.array([text[f["place"] + lead:f["last"] + length] for f in part], pa.binary()),
                        pa.array([bisect_right(splitters, b) for b in leading], pa.int32())],
                        ["id", "mark", "place", "first", "last", "leading", "before", "rest", "bucket"])

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        place, first, last = (table[c].to_numpy().astype(np.int64) for c in ("place", "first", "last"))
        after = [a + b for a, b in zip(table["leading"].to_pylist(), table["rest"].to_pylist())]
        found = [runs(s) for s in repeated_starts(table["before"].to_pylist(), after, place, first, last, length)]
        many = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        flat = [r for f in found for r in f]
        return pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(many), table["mark"].combine_chunks().take(many),
                                           pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.int32())], ["id", "mark", "first", "last"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket arrives ordered by leading bytes and is settled in portions that end between two of them."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if size > 1 << 24 and held:
                    previous, now = held[-1].column(5)[-1].as_py(), part.column(5).to_pylist()
                    same = next((k for k, v in enumerate(now) if v != previous), len(now))
                    if same < len(now):
                        if same:
                            held.append(part.slice(0, same))
                        yield settle(held)
                        held, size, part = [], 0, part.slice(same)
                held.append(part)
                size += part.nbytes
        if held:
            yield settle(held)

    columns = "id long, mark long, place int, first int, last int, leading binary, before binary, rest binary, bucket int"
    dealt = wanted.mapInArrow(cut, columns).repartition(n, "bucket").sortWithinPartitions("bucket", "leading")
    found = dealt.mapInArrow(bucket, "id long, mark long, first int, last int")
    if crowded:
        found = found.unionByName(count_strings(wanted, length))
    return found.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def count_strings(wanted: DataFrame, length: int) -> DataFrame:
    """(id, mark, first, last) for the suffixes marked `many`: each of their strings is counted by its digest.

    A task settles what repeats among CHUNK of its own strings and sends one witness for each
    such digest, so a string that all texts share travels once per chunk, not once per text.
    """
    names = ["id", "mark", "first", "high", "low", "state"]

    def settle(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, marks, starts, high, low = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((low, high))
        equal = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        again, more = np.concatenate([[False], equal]), np.concatenate([equal, [False]])
        state = np.zeros(len(ids), dtype=np.int32)
        state[order] = again | more
        witness = order[more & ~again]
        row = np.concatenate([np.arange(len(ids)), witness])
        state = np.concatenate([state, np.full(len(witness), WITNESS, dtype=np.int32)])
        return pa.RecordBatch.from_arrays([*(pa.array(c[row]) for c in (ids, marks, starts, high, low)), pa.array(state)], names)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                for f in batch.column(3)[k].as_py():
                    if f["many"]:
                        starts = np.arange(f["first"], f["last"] + 1, dtype=np.int32)
                        digests = np.frombuffer(b"".join(hashlib.blake2b(text[s:s + length], digest_size=16).digest() for s in starts.tolist()), np.int64).reshape(-1, 2)
                        held.append([np.full(len(starts), batch.column(0)[k].as_py()), np.full(len(starts), batch.column(1)[k].as_py()), starts,
                                     digests[:, 0], digests[:, 1]])
                        size += len(starts)
                        if size >= CHUNK:
                            yield settle(held)
                            held, size = [], 0
        if held:
            yield settle(held)

    strings = wanted.filter(F.exists("found", lambda f: f["many"])).mapInArrow(spell, "id long, mark long, first int, high long, low long, state int")
    single = strings.filter("state = 0")
    twice = strings.filter("state <> 1").groupBy("high", "low").agg(F.sum(F.greatest("state", F.lit(1))).alias("n")).filter("n > 1").select("high", "low")
    settled = strings.filter("state = 1").select("id", "mark", "first").unionByName(single.join(twice, ["high", "low"]).select("id", "mark", "first"))
    return settled.withColumn("last", F.col("first"))


def remove_repeats(docs: DataFrame, length: int = 400, span: int = 320, group_cap: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row of docs; kept is the binary of the bytes that are left.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the same
    text or another; strings are judged on the input. Null and empty texts and those shorter
    than `length` lose nothing. Repeated rows are texts of their own and repeat each other. A
    null id comes back as null. Other columns are ignored. No rows give no rows.
    """
    rows = keyed(docs, id_col, text_col)
    # One shuffle of the texts serves both the suffixes and the final join.
    texts = rows.repartition(partitions(docs.sparkSession), "id", "mark")
    found = find(rows, texts, length, span, group_cap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or b""
                spans = covered([(r["first"], r["last"]) for r in batch.column(2)[k].as_py() or []], length)
                ends = [0, *[e for _, e in spans]]
                kept = b"".join(text[a:b] for a, b in zip(ends, [*[s for s, _ in spans], len(text)]))
                for column, value in zip(out, (len(text), len(text) - len(kept), len(spans), kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(found, ["id", "mark"], "left").select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("id"), "text", "runs")
    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
