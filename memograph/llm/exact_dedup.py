"""Exact de-duplication with a heavy-hitter split. DataFrame and SQL functions only.

A Misra-Gries summary of the digests (the engine's frequent-items sketch) names at
most `tracked` candidates. Their exact counts decide which of them are heavy; at
most `tracked` heavy winners are broadcast, and copies of them are settled where
they are read, without a shuffle. All other digests are grouped by an ordinary
shuffle, in which no group exceeds the share that makes a digest heavy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import ascii_lower, stored


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest) of each row: SHA-256 of the text with A-Z lower-cased. Written once, read by each step."""
    return stored(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)).alias("digest")))


def heavy(rows: DataFrame, tracked: int, share: float) -> DataFrame:
    """(digest, winner, n) of the digests that hold at least `share` of all rows, verified; at most `tracked` rows.

    The sketch misses no digest above its error bound, 3.5 / (4 / 3 * tracked) of
    all rows; a digest missed below that goes through the ordinary shuffle and
    changes no result.
    """
    found = rows.agg(F.expr(f"approx_top_k(hex(digest), {tracked}, {4 * tracked})").alias("top"), F.count(F.lit(1)).alias("total"))
    candidates = found.select(F.explode("top").alias("t"), "total").filter(
        F.col("t.count") >= F.greatest(F.lit(2.0), F.col("total") * share)).select(F.unhex("t.item").alias("digest"), "total")
    exact = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.max(F.struct("id", "row")).alias("winner"), F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    return exact.filter((F.col("n") >= 2) & (F.col("n") >= F.col("total") * share)).select("digest", "winner", "n")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 256, share: float = 0.001) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays, a null id being smaller than
    any other. Repeated rows (same id and text): exactly one of them stays. Other
    columns of docs are ignored, so their names cannot clash. No rows give no rows.
    """
    rows = digests(docs, id_col, text_col)
    winners = stored(heavy(rows, tracked, share))
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("winner"), F.count(F.lit(1)).alias("n"))
    light = rest.join(groups, "digest")
    return settled.unionByName(light).select(
        F.col("id").alias(id_col), F.col("winner.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("winner.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that stay, with their own columns. Of repeated rows (same id and text) one stays."""
    # Plain keys without nulls, so that one exchange of the texts serves the join and the grouping after it.
    def plain(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    kept = decide(docs, id_col, text_col, **params).filter("kept").select(plain(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumns({"__sha": F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256), "__id": plain(id_col)})
    return keyed.join(kept, ["__sha", "__id"], "left_semi").dropDuplicates(["__sha", "__id"]).select(*docs.columns)
