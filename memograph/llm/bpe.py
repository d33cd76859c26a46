"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are dealt into blocks by one shuffle. Each block splits its texts into words and asks
for its distinct words once; requests go by a hash of the word to buckets, where each distinct
word of the whole corpus is encoded exactly once by the tokenizers library. The replies return
to the blocks and are joined back by position: a text's ids are its words' ids in order. Both
the requests and the final join read the same shuffle of the texts. Decoding joins ids with
the table of pieces, which has one row per id of the vocabulary whatever the corpus.

Words are split as the tokenizer's own pre-tokenizer does, on arrays of code points: the classes
of letters, numbers and white space are probed from the library, so that they agree for every
character. Strings of special tokens are words of their own, as in the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import blocks_for, partitions

OTHER, LETTER, NUMBER, WHITE = range(4)
#: Endings that form one word with the apostrophe before them (fixed values of the split pattern).
SHORT, LONG = "stmd", ("re", "ve", "ll")


@cache
def character_classes() -> np.ndarray:
    """Class of every code point, as the tokenizers library's own patterns see it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything, at = "".join(map(chr, points)), np.array(points)
    classes = np.zeros(0x110000, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        hit = np.ones(len(points), dtype=bool)
        for _, (start, end) in Split(Regex(pattern), "removed").pre_tokenize_str(everything):
            hit[start:end] = False
        classes[at[hit]] = kind
    return classes


def word_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words start in concatenated segments; first marks the segments' own starts."""
    n = len(points)
    kind = classes[points]
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # White space before a word: its last character stands alone, and joins the word if it is a space.
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~first[1:])
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & starts)
    for size, endings in ((1, SHORT), (2, LONG)):
        q = quote[quote + size < n]
        if not len(q):
            continue
        inside = ~first[q + 1] & (~first[q + 2] if size == 2 else True)
        fits = np.zeros(len(q), dtype=bool)
        for e in endings:
            fits |= np.all([points[q + 1 + k] == ord(c) for k, c in enumerate(e)], axis=0)
        q = q[fits & inside]
        starts[q + 1] = False
        after = q[q + size + 1 < n] + size + 1
        starts[after] = True
    return starts


def split_words(texts: list[bytes], special: list[bytes], classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, words per text); the words of a text concatenate to it."""
    segments, owner = [], []
    for k, text in enumerate(texts):
        parts = [text]
        for s in special:
            parts = [p for part in parts for p in ([part] if part in special else _around(part, s))]
        for p in parts:
            if p:
                segments.append(p)
                owner.append(k)
    data = b"".join(segments)
    if not data:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    heads = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes that start a character
    points = raw if len(heads) == len(raw) else np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first = np.zeros(len(heads), dtype=bool)
    first[np.searchsorted(heads, begins[:-1])] = True
    offsets = heads[word_starts(points, first, classes)]
    if special:
        chosen = [k for k, s in enumerate(segments) if s in special]
        if chosen:
            inner = np.zeros(len(raw) + 1, dtype=np.int32)
            for k in chosen:
                inner[begins[k] + 1] += 1
                inner[begins[k + 1]] -= 1
            offsets = offsets[np.cumsum(inner)[offsets] == 0]
    counts = np.bincount(np.array(owner)[np.searchsorted(begins, offsets, side="right") - 1], minlength=len(texts))
    ends = pa.py_buffer(np.concatenate([offsets, [len(data)]]).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets), [None, ends, pa.py_buffer(data)]), counts


def _around(text: bytes, token: bytes) -> list[bytes]:
    out = []
    for k, part in enumerate(text.split(token)):
        out += [token, part] if k else [part]
    return out


def distinct_words(texts: list[bytes], special: list[bytes], classes: np.ndarray, most: int = 1 << 19) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words in byte order, each word's number among them, words per text)."""
    parts, counts, group, size = [pa.array([], pa.large_binary())], [np.zeros(0, dtype=np.int64)], [], 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size > most or k == len(texts) - 1:
            words, n = split_words(group, special, classes)
            parts.append(words)
            counts.append(n)
            group, size = [], 0
    coded = pa.concat_arrays(parts).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()], np.concatenate(counts)


def layout(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of words."""
    if not len(words):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = words.buffers()
    return np.frombuffer(offsets, dtype=np.int64)[words.offset:words.offset + len(words) + 1], np.frombuffer(data, dtype=np.uint8)


def by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by bucket, start of each bucket in it); the bucket hashes the length and both ends of a word."""
    offsets, data = layout(words)
    sizes = np.diff(offsets)
    hashed = sizes.astype(np.uint64)
    for k in range(8):
        inside = np.minimum(k, sizes - 1)
        for at in (offsets[:-1] + inside, offsets[1:] - 1 - inside):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + data[at]
    bucket = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """values[start:start + size] of each, concatenated; some at a time, since the places take more memory than the values."""
    out = np.empty(int(sizes.sum()), dtype=values.dtype)
    at = 0
    for k in range(0, len(sizes), step):
        size = sizes[k:k + step].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1])
        out[at:at + total] = values[np.arange(total) + np.repeat(starts[k:k + step] - (ends - size), size)]
        at += total
    return out


def squeezed(values: np.ndarray) -> bytes:
    """Numbers for the shuffle: in two bytes where they fit, compressed."""
    narrow = not len(values) or int(values.max()) < 1 << 16
    return bytes([narrow]) + zstandard.compress(values.astype("<u2" if narrow else "<u4").tobytes(), 3)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), dtype="<u2" if data[0] else "<u4").astype(np.uint32)


def special_tokens(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        return [t["content"].encode() for t in json.load(f)["added_tokens"]]


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in order, ids per word), by the tokenizers library."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids, sizes = [], []
    for at in range(0, len(words), 20000):
        for found in tokenizer.encode_batch_fast([w.decode("utf-8") for w in words[at:at + 20000]], add_special_tokens=False):
            one = found.ids
            ids += one
            sizes.append(len(one))
    return np.array(ids, dtype=np.uint32), np.array(sizes, dtype=np.uint32)


Finish = Callable[[int, pa.Table, np.ndarray, np.ndarray], pa.Table]
BLOCK_BYTES = 32 << 20  # of text in a block, about


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def encode_blocks(texts: DataFrame, path: str, finish: Finish, schema: str, blocks: int) -> DataFrame:
    """Encode the texts (block long, ..., text binary) of each block and hand them on.

    finish(block, rows, ids, sizes) gets a block's rows, all their ids in row order and the
    number of ids per row. A block is one task's work, so blocks must be of bounded size.
    """
    special, classes = special_tokens(path), character_classes()
    buckets = partitions(texts.sparkSession)
    dealt = texts.repartition(blocks, "block")

    def ask(keys: tuple, group: pa.Table) -> pa.Table:
        words, _, _ = distinct_words([t or b"" for t in group["text"].to_pylist()], special, classes)
        order, starts = by_bucket(words, buckets)
        rows = [k for k in range(buckets) if starts[k] < starts[k + 1]]
        offsets, data = layout(words.take(pa.array(order)))
        cuts = [(int(starts[k]), int(starts[k + 1])) for k in rows]
        return pa.table({"block": pa.array([keys[0].as_py()] * len(rows), pa.int64()), "bucket": pa.array(rows, pa.int32()),
                         "words": pa.array([zstandard.compress(data[offsets[a]:offsets[b]], 3) for a, b in cuts], pa.binary()),
                         "sizes": pa.array([squeezed(np.diff(offsets[a:b + 1])) for a, b in cuts], pa.binary())})

    def answer(keys: tuple, group: pa.Table) -> pa.Table:
        parts = []
        for data, sizes in zip(group["words"].to_pylist(), group["sizes"].to_pylist()):
            ends = np.concatenate([[0], np.cumsum(unsqueezed(sizes), dtype=np.int64)])
            parts.append(pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(zstandard.decompress(data))]))
        coded = pa.chunked_array([p.dictionary_encode() for p in parts]).unify_dictionaries()
        ids, sizes = encode_words(coded.chunk(0).dictionary.to_pylist(), path)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        places = [c.indices.to_numpy() for c in coded.chunks]
        return pa.table({"block": group["block"], "bucket": group["bucket"],
                         "ids": pa.array([squeezed(ragged(ids, starts[p], sizes[p])) for p in places], pa.binary()),
                         "sizes": pa.array([squeezed(sizes[p]) for p in places], pa.binary())})

    def join(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words, numbers, per_text = distinct_words([t or b"" for t in left["text"].to_pylist()], special, classes)
        order, _ = by_bucket(words, buckets)
        replies = right.sort_by("bucket")
        none = np.zeros(0, dtype=np.uint32)
        own = np.concatenate([none, *map(unsqueezed, replies["sizes"].to_pylist())])
        sizes, starts = np.empty(len(words), dtype=np.uint32), np.empty(len(words), dtype=np.int64)
        sizes[order] = own
        starts[order] = np.cumsum(own, dtype=np.int64) - own
        ids = np.concatenate([none, *map(unsqueezed, replies["ids"].to_pylist())])
        del words, own
        taken = sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(taken, dtype=np.int64)])[np.concatenate([[0], np.cumsum(per_text)])]
        out = finish(keys[0].as_py(), left, ragged(ids, starts[numbers], taken), np.diff(ends))
        pa.default_memory_pool().release_unused()
        return out

    asked = dealt.groupBy("block").applyInArrow(ask, "block long, bucket int, words binary, sizes binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, ids binary, sizes binary")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(join, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) of each row of docs: ids is the binary of little-endian unsigned 32-bit ids of the whole text.

    As the library's encode with add_special_tokens=False and without truncation and padding.
    Null and empty texts have no ids; repeated rows each have their row; other columns are
    ignored. No rows give no rows. With decoded, a column of that name holds what the ids
    decode to, joined in the same task instead of a second pass.
    """
    table = pieces(path) if decoded else []

    def finish(block: int, rows: pa.Table, ids: np.ndarray, sizes: np.ndarray) -> pa.Table:
        ends = np.cumsum(sizes)
        cut = [ids[e - s:e] for s, e in zip(sizes, ends)]
        out = {"id": rows["id"], "ids": pa.array([c.tobytes() for c in cut], pa.binary())}
        if decoded:
            known = pa.array([*table, b""], pa.large_binary())
            out["decoded"] = pa.array([join_pieces(c, known) for c in cut], pa.string())
        return pa.table(out)

    blocks = max(partitions(docs.sparkSession), blocks_for(text_bytes(docs, text_col), BLOCK_BYTES))
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(blocks))
    texts = docs.select(key.alias("block"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return encode_blocks(texts, path, finish, "id long, ids binary" + ", decoded string" * decoded, blocks).withColumnRenamed("id", id_col)


def join_pieces(ids: np.ndarray, known: pa.Array) -> str:
    """The text of some ids: each id's piece, by position in the table of pieces; the last piece is for unknown ids."""
    if not len(ids):
        return ""
    joined = known.take(pa.array(np.minimum(ids, len(known) - 1)))
    ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)
    return joined.buffers()[2].to_pybytes()[ends[joined.offset]:ends[joined.offset + len(joined)]].decode("utf-8", "replace")


def pieces(path: str) -> list[bytes]:
    """Bytes of every id of the vocabulary. Byte-level vocabularies write each byte as a printable character."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    back = {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(moved)}}
    table = {i: bytes(back[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """tokens with the decoded text: each id is joined with its piece, special tokens included.

    Null and empty ids give an empty text; ids outside the vocabulary add nothing; bytes that
    are no UTF-8 become replacement characters, as in the library. A column of tokens called
    as the result is replaced.
    """
    rest = [c for c in tokens.columns if c != name]
    table = pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([*table, b""], pa.large_binary())
        for batch in batches:
            out = [join_pieces(np.frombuffer(value.as_py() or b"", dtype=np.uint32), known) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], [*rest, name])

    schema = tokens.select(*rest).schema.add(name, "string")
    return tokens.select(*rest, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
