"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are 64 majority bits over the hashes of word shingles. Bits that vary
together are grouped into one part, so that the parts vary independently. Parts get
unequal thresholds that sum to `distance - parts + 1`, chosen by dynamic programming
on the candidate pairs each threshold would cost. Two fingerprints within the distance
then agree within the threshold in at least one part: each part is probed with the
values in reach, and the pairs met are verified on the whole fingerprint.

Equal fingerprints are one node. A bucket of more than `bucket_cap` fingerprints forms
no pairs: its members go to radius-1 balls instead. Two fingerprints within distance 2
lie in a common ball around some centre, all members of a ball are within distance 2 of
each other, and a ball has at most 65 members, so linking each to the smallest is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import components, stored

BITS = 64
LAST_ID = (1 << 63) - 1


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Majority bits over the XXH64 of every word shingle, repeats included. No words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1:] or ends[-1:]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(last), 1 << 16):
        part = last[at:at + (1 << 16)]
        hashes = np.fromiter((digest(joined[s:e - 1], seed) for s, e in zip(starts[at:], part)), dtype=np.uint64, count=len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(last), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, mark, fp) of each row; mark is a hash of the whole text that tells rows of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["id", "mark", "fp"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text_col).alias("mark"),
                       F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "id long, mark long, fp long"))


def bit_statistics(classes: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints in which two bits are both set, over all fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for row in classes.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[row[0], row[1]] = row[2]  # 4,096 rows whatever the input
    return out


def group_bits(both: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS * (k + 1) // parts - BITS * k // parts
        order = sorted(left)
        first = max(order, key=lambda b: (corr[b, order].sum() - corr[b, b], -b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds, one per part, that sum to `total` at the least summed cost (dynamic programming)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        following: dict[int, tuple[float, list[int]]] = {}
        for s, (spent, chosen) in best.items():
            for t, c in options.items():
                if s + t not in following or spent + c < following[s + t][0]:
                    following[s + t] = (spent + c, [*chosen, t])
        best = following
    return best[total][1]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(bits: list[int], reach: int) -> list[int]:
    """Masks that flip up to `reach` of these bits."""
    masks = {0}
    for _ in range(max(reach, 0)):
        masks |= {m ^ (1 << b) for m in masks for b in bits}
    return sorted(m - (1 << BITS) if m >> (BITS - 1) else m for m in masks)


def plan(classes: DataFrame, distance: int, parts: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, from counts over all fingerprints."""
    rows = classes.count()
    both = bit_statistics(classes)
    groups = group_bits(both, rows, parts)
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("value")) for k, g in enumerate(groups)])
    exact = {r["part"]: r["pairs"] for r in classes.select(F.explode(keys).alias("k")).groupBy("k.part", "k.value").agg(
        F.count(F.lit(1)).cast("double").alias("c")).groupBy("part").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(both) / max(rows, 1)
    agree = np.maximum(p * p + (1 - p) * (1 - p), 1e-9)
    cost = []
    for k, g in enumerate(groups):
        odds = ((1 - agree[g]) / agree[g]).sum()
        options, pairs = {-1: 0.0}, exact.get(k, 0.0) + 1e-3
        term, reach = 1.0, 0.0
        for t in range(distance + 1):
            # Pairs t bits apart follow from those that agree, by each bit's odds to differ; probing has its own cost.
            reach += term
            options[t] = pairs * reach + rows * len(_flips(g, t))
            term *= odds / (t + 1)
        cost.append(options)
    chosen = allocate(cost, distance - parts + 1)
    return [(g, t) for g, t in zip(groups, chosen) if t >= 0]


def link(classes: DataFrame, distance: int = 2, parts: int = 3, bucket_cap: int = 64) -> DataFrame:
    """Edges (a, b) between the roots of classes (fp, root) whose fingerprints differ in at most `distance` bits.

    A pair is linked directly or, inside a ball, through the ball's smallest member.
    """
    if distance != 2:
        raise ValueError("balls of radius 1 give the exact rest for distance 2")
    probes, own = [], []
    for k, (bits, reach) in enumerate(plan(classes, distance, parts)):
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        own.append(F.struct(F.lit(k).alias("part"), value.alias("value"), F.lit(0).alias("flipped")))
        probes += [F.struct(F.lit(k).alias("part"), value.bitwiseXOR(F.lit(m)).alias("value"), F.lit(int(m != 0)).alias("flipped"))
                   for m in _flips(bits, reach)]

    def keyed(keys: list[Column]) -> DataFrame:
        return classes.select("fp", "root", F.explode(F.array(*keys)).alias("k")).select("fp", "root", "k.part", "k.value", "k.flipped")

    sizes = keyed(own).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    probed = keyed(probes).join(sizes.filter("n > 1") if len(probes) == len(own) else sizes, ["part", "value"])
    small = probed.filter(F.col("n") <= bucket_cap)
    index = keyed(own).select("part", "value", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    met = small.join(index, ["part", "value"]).filter(F.col("fp") < F.col("fp2")) if len(probes) == len(own) else \
        small.join(index, ["part", "value"]).filter(F.col("fp") != F.col("fp2"))
    pairs = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance).select(
        F.col("root").alias("a"), F.col("root2").alias("b"))
    crowded = probed.filter(F.col("n") > bucket_cap).select("fp", "root").distinct()
    return pairs.unionByName(balls(crowded))


def balls(classes: DataFrame) -> DataFrame:
    """Edges that connect exactly the fingerprints within distance 2, 65 rows per fingerprint and no pairs."""
    centres = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(BITS)])
    members = classes.select(F.explode(centres).alias("centre"), "root").groupBy("centre").agg(F.collect_list("root").alias("roots"))
    met = members.filter(F.size("roots") > 1).select(F.array_min("roots").alias("b"), F.explode("roots").alias("a"))
    return met.filter("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2,
                    parts: int = 3, bucket_cap: int = 64) -> DataFrame:
    """(id, mark, fp, component, component_id) of each row of docs: component numbers what links reach, component_id is its smallest id.

    Null and empty texts, and texts without words, have fingerprint zero and link as any
    other. Repeated rows are linked and each has its row. A null id counts as larger than
    any other and comes back as null. Other columns are ignored. No rows give no rows.
    """
    rows = fingerprints(docs, id_col, text_col, shingle)
    # A fingerprint numbers its class: an id would not, as unlike texts can share one or have none.
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("low")).withColumn("root", F.col("fp")))
    found = components(link(classes, distance, parts, bucket_cap))
    placed = stored(classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "low", F.coalesce(found["root"], classes["fp"]).alias("component")))
    named = placed.select("fp", "component").join(placed.groupBy("component").agg(F.min("low").alias("component_id")), "component")
    back = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return rows.join(named, "fp").select(back("id").alias(id_col), "mark", "fp", "component", back("component_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Rows of docs that stay: of each component the one with the smallest (id, text hash); repeated rows stay once."""
    return stay(docs, near_duplicates(docs, id_col, text_col, **params), id_col, text_col)


def stay(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each component found."""
    kept = found.groupBy("component").agg(F.min(F.struct(F.coalesce(id_col, F.lit(LAST_ID)).alias("id"), "mark")).alias("k")).select(
        F.col("k.id").alias("__id"), F.col("k.mark").alias("__mark"))
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))).withColumn("__mark", F.xxhash64(text_col))
    return keyed.join(kept, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"]).drop("__id", "__mark")
