"""The best documents of each item by exact dual-tree search.

A document's coordinate on a term is what the term would add to its score; an item's is 1 on
each of its terms, so a score is the product of two vectors. A hierarchy over the items and
one over each batch of documents hold at every node the maxima of the coordinates below.
The product of two nodes' maxima bounds the scores of all pairs below them: where it stays
below the weakest k-th score of the node's items, the whole batch of pairs is dropped. A
k-th score over any part of the documents is a bound that holds for all, so a first round
over a share of the documents gives every task its bounds to start with, and each raises
its own as it goes. All sums are whole numbers below 2**53, so doubles hold them exactly.

Items come in blocks of about `block_bytes` of text. A block's terms and items are held by
every task; documents are read once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memograph.llm.common import blocks_for, stored
from memograph.llm.importance import LOWERED, PIECE

LAST_ID = (1 << 63) - 1
CELLS = 1 << 21
LEAF = 4


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of about a megabyte at a time."""
    text, at = (text or b"").translate(LOWERED), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def vectors(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Documents with a term: (kind 0, row, id, n, terms, times) with their known terms.

    Each task adds one row of kind 1: its documents, their terms with repeats, and for each
    known term the documents that hold it.
    """
    width = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, total = np.zeros(width, dtype=np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found, sizes = [], np.zeros(part.num_rows, dtype=np.int64)
                for k, text in enumerate(part.column(2).to_pylist()):
                    for words in terms_of(text):
                        sizes[k] += len(words)
                        found.append(np.fromiter((known.get(w, -1) for w in words), dtype=np.int64, count=len(words)))
                        found[-1] = found[-1][found[-1] >= 0] + k * width
                cells, times = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)
                doc, term = np.divmod(cells, max(1, width))
                held += np.bincount(term, minlength=width)
                some = np.flatnonzero(sizes)
                documents, total = documents + len(some), total + int(sizes.sum())
                ends = np.searchsorted(doc, some, side="right")
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(some), dtype=np.int32)), part.column(0).take(pa.array(some)), part.column(1).take(pa.array(some)), pa.array(sizes[some]),
                    pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                    ["kind", "row", "id", "n", "terms", "times"])
        any_doc = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([
            pa.array([1], pa.int32()), pa.array([documents], pa.int64()), pa.array([None], pa.int64()), pa.array([total], pa.int64()),
            pa.array([any_doc.tolist()], pa.list_(pa.int32())), pa.array([held[any_doc].tolist()], pa.list_(pa.int64()))],
            ["kind", "row", "id", "n", "terms", "times"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "kind int, row long, id long, n long, terms array<int>, times array<long>")


def similar_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Order of the rows in which halves, quarters, ... hold rows that are alike, down to `leaf` rows.

    A set is cut in the middle of its projection on the line between two of its rows that lie far apart.
    """
    order, stack = np.arange(len(x)), [(0, len(x))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            continue
        rows = x[order[a:b]]
        norms = np.einsum("ij,ij->i", rows, rows)
        one = int((norms - 2 * rows @ rows.mean(axis=0)).argmax())
        two = int((norms - 2 * rows @ rows[one]).argmax())
        order[a:b] = order[a:b][np.argsort(rows @ (rows[two] - rows[one]), kind="stable")]
        middle = a + half(b - a, leaf)
        stack += [(a, middle), (middle, b)]
    return order


def half(n: int, leaf: int) -> int:
    """Where a set of n rows is cut: the left part is a full power of two of leaves."""
    size = leaf
    while size * 2 < n:
        size *= 2
    return size


def maxima(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima of the nodes of a hierarchy, level by level from the root; the last level has the leaves."""
    levels = [np.maximum.reduceat(x, np.arange(0, len(x), leaf), axis=0)]
    while len(levels[0]) > 1:
        levels.insert(0, np.maximum.reduceat(levels[0], np.arange(0, len(levels[0]), 2), axis=0))
    return levels


def pairs_left(docs: list[np.ndarray], items: list[np.ndarray], weakest: np.ndarray, leaf: int) -> np.ndarray:
    """(document leaf, item leaf): whether the bounds leave their pairs in. weakest: each item's k-th score so far."""
    least = [np.minimum.reduceat(weakest, np.arange(0, len(weakest), leaf))]
    for _ in items[1:]:
        least.insert(0, np.minimum.reduceat(least[0], np.arange(0, len(least[0]), 2)))
    alive = np.ones((1, 1), dtype=bool)
    for level in range(max(len(docs), len(items))):
        d, i = min(level, len(docs) - 1), min(level, len(items) - 1)
        if level:  # children take over what is left of their parents
            alive = alive[np.arange(len(docs[d])) // (1 + (d == level))][:, np.arange(len(items[i])) // (1 + (i == level))]
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        bound = docs[d][rows] @ items[i][columns].T
        left = np.zeros_like(alive)
        left[np.ix_(rows, columns)] = bound >= least[i][columns]
        alive &= left
    return alive


class Best:
    """The k best documents of each item so far."""

    def __init__(self, k: int, floors: np.ndarray) -> None:
        self.k, self.floor = k, np.maximum(floors, 1).astype(np.float64)  # a score of 0 is no hit
        self.rows = [np.zeros((3, 0), dtype=np.int64) for _ in floors]

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        both = np.concatenate([self.rows[item], np.stack([score, ids, rows])], axis=1)
        both = both[:, np.lexsort((both[2], both[1], -both[0]))[:self.k]]
        self.rows[item] = both
        if both.shape[1] == self.k:
            self.floor[item] = max(self.floor[item], both[0, -1])


def search(found: DataFrame, items: list[np.ndarray], weight: np.ndarray, documents: int, total: int, k: int, floors: np.ndarray) -> DataFrame:
    """(item, id, row, score): what each task finds above its bounds, at most k documents of an item."""
    width = len(weight)
    size = int(min(1024, max(64, CELLS // max(1, width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros((len(items), width))
        for row, terms in enumerate(items):
            wanted[row, terms] = 1.0
        order = similar_order(wanted, LEAF)
        wanted = wanted[order]
        tree, best = maxima(wanted, LEAF), Best(k, floors[order])
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = part.column(3)
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                term, times = lists.flatten().to_numpy(), part.column(4).flatten().to_numpy()
                length = 50 + divided(part.column(2).to_numpy(), documents, total)
                x = np.zeros((part.num_rows, width))
                x[doc, term] = weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * length[doc]))
                alike = similar_order(x, LEAF)
                x = x[alike]
                ids, rows = part.column(1).fill_null(LAST_ID).to_numpy()[alike], part.column(0).to_numpy()[alike]
                left = pairs_left(maxima(x, LEAF), tree, best.floor, LEAF)
                for leaf in np.flatnonzero(left.any(axis=0)).tolist():
                    mine = np.flatnonzero(np.repeat(left[:, leaf], LEAF)[:len(x)])
                    score = x[mine] @ wanted[leaf * LEAF:(leaf + 1) * LEAF].T
                    for c in range(score.shape[1]):
                        item = leaf * LEAF + c
                        hit = np.flatnonzero(score[:, c] >= best.floor[item])
                        if len(hit):
                            best.add(item, score[hit, c].astype(np.int64), ids[mine[hit]], rows[mine[hit]])
        for item, held in zip(order.tolist(), best.rows):
            if held.shape[1]:
                ids = [None if i == LAST_ID else i for i in held[1].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(held.shape[1], item, dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(held[2]), pa.array(held[0])],
                                                 ["item", "id", "row", "score"])

    return found.select("row", "id", "n", "terms", "times").mapInArrow(run, "item int, id long, row long, score long")


def divided(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(50 * n * documents) div total, also where the product leaves 64 bits."""
    if int(n.max(initial=0)) * 50 * documents < 1 << 63:
        return (50 * n * documents) // total
    return np.array([50 * v * documents // total for v in n.tolist()], dtype=np.int64)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, share: int = 64, block_bytes: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0.

    Equal scores go by ascending id, null ids last, then by row. Null and empty texts have no
    terms: such documents and items have no results. Rows of a repeated id are documents, or
    items, of their own. One item is never split, so its distinct terms must fit a task. Other
    columns are ignored. No rows give no rows. The first round reads one document in `share`.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("at")))
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = blocks_for(size, block_bytes)
    out = None
    for block in range(blocks):
        mine = [(r["item_id"], set(w for words in terms_of(bytes(r["text"])) for w in words))
                for r in asked.filter(F.pmod(F.xxhash64("at"), F.lit(blocks)) == block).filter("text IS NOT NULL").select("item_id", "text").collect()]
        mine = [(i, terms) for i, terms in mine if terms]
        if not mine:
            continue
        known = {term: at for at, term in enumerate(sorted(set().union(*(terms for _, terms in mine))))}
        every = stored(vectors(docs, known, id_col, text_col))
        stats = every.filter("kind = 1")
        documents, total = stats.agg(F.coalesce(F.sum("row"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(known), dtype=np.int64)
        for r in stats.select(F.explode(F.arrays_zip("terms", "times")).alias("t")).groupBy("t.terms").agg(F.sum("t.times").alias("n")).collect():
            holding[r["terms"]] = r["n"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()], dtype=np.int64)
        if len(known) * int(weight.max()) * 1_000_000 >= 1 << 53:
            raise ValueError("scores of this block of items leave the range that doubles hold exactly: lower block_bytes")
        places = [np.array(sorted(known[t] for t in terms)) for _, terms in mine]
        rows = every.filter("kind = 0")
        floors = np.zeros(len(mine), dtype=np.int64)
        first = search(rows.filter(F.pmod(F.xxhash64("row"), F.lit(share)) == 0), places, weight, documents, total, k, floors)
        for r in best_rows(first, k).filter(F.col("rank") == k).select("item", "score").collect():
            floors[r["item"]] = r["score"]
        ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(mine)], f"item int, item_id {items.schema[item_col].dataType.simpleString()}")
        best = best_rows(search(rows, places, weight, documents, total, k, floors), k).join(F.broadcast(ids), "item").select(
            F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} long, score long")
    return out


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
