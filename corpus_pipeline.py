"""From raw documents to token ids: the training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.llm import bpe, exact_dedup, minhash, mixing, quality
from memograph.llm.common import stored, table
from memograph.llm.queries import MIX_WEIGHTS, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of the input, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="__score").filter(f"__score >= {quality.ACCEPT}").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: candidates by SimHash and by minimum hashes, links at a similarity of 0.8 on shingles of five words."""
    return minhash.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mixing.take(docs, MIX_WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of the ids and of the text they decode to."""
    coded = bpe.encode(docs, tokenizer_path(), decoded=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("source mixing", mix_sources),
          ("tokenizing", tokenize)]
#: Hashes, the trained classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
