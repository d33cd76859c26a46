"""The registered queries of the training-data operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.llm import (bpe, chunk_dedup, embedding_dedup, exact_dedup, html_text, importance, lexical_search, mixing, quality, simhash,
                           suffix_dedup, token_files, vector_search)
from memograph.llm.common import UPPER, WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The tokenizer's file comes with an installed package; its place is a parameter.
TOKENIZER = "byte_bpe_50k.json"
MIX_WEIGHTS = [5.0, 2.0, 1.0]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op2_simhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_files.read(spark, manifest).select(
        F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op4_bpe_roundtrip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_source_mixing", f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         CASE WHEN length(text) > 0 THEN greatest(0.05, length(translate(text, '{mixing.SYMBOLS}', '')) / length(text)) ELSE 1.0 END AS weight,
         (CAST('0x' || substr(md5('1:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
budgets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap), 1e300) * weight) AS target
  FROM levels),
placed AS (
  SELECT d.*, b.source_size, b.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / d.weight, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN b.source_size > 0 THEN floor(b.target / b.source_size) ELSE 0 END AS epochs
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size) - before)))::BIGINT AS taken
FROM placed""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.0, max_epochs=3.0).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op6_embedding_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS digest FROM documents)
WINDOW g AS (PARTITION BY digest)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.learn(pages))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


LOWERED_TEXT = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


@query("op11_importance_resampling", rf"""
WITH step AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, regexp_extract_all({LOWERED_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target AS (SELECT regexp_extract_all({LOWERED_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
features AS (
  SELECT doc_id, false AS wanted, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM docs
  UNION ALL
  SELECT NULL, true, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM target),
bytes AS (
  SELECT f, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM features GROUP BY f)),
codes AS (
  SELECT f, xor(list_reduce([4294967295] || b, lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, step),
placed AS (SELECT doc_id, wanted, bucket FROM features JOIN codes USING (f)),
counts AS (SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM counts) + 10000)
                                 / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM placed JOIN gains USING (bucket) WHERE NOT wanted GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
         coalesce(CASE WHEN total < 0 THEN -((n - 1 - total) // n) ELSE total // n END, 0) AS weight,
         ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM docs d LEFT JOIN weights x ON d.doc_id = x.doc_id),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM noisy)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
       CASE WHEN words >= 20 AND place <= 25 * (SELECT count(*) FROM noisy WHERE words >= 20) // 100 THEN place END AS rank
FROM ranked""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_lexical_search", rf"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all({LOWERED_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM docs),
lengths AS (SELECT place, 50 + (50 * len(w) * docs) // total AS m FROM docs, sizes WHERE len(w) > 0),
held AS (SELECT place, doc_id, term, count(*) AS tf FROM (SELECT place, doc_id, unnest(w) AS term FROM docs) GROUP BY place, doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM sizes) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM held GROUP BY term),
scores AS (
  SELECT item_id, place, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (place) GROUP BY item_id, place, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query("op13_vector_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50).select(
        "query_id", "rank", "vec_id", "score")
