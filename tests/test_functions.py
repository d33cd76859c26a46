"""Scalar rules on inline rows."""

import pytest
from pyspark.sql import functions as F

from memograph.functions import phrases, scoring, text
from memograph.operators import chunking, extraction, normalize

ANCHOR = "2026-05-25 10:00:00"


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], [*given]) if given else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("question, start, end, clean", [
    ("outages in the last 24 hours", "2026-05-24 10:00:00", ANCHOR, "outages"),
    ("errors past 3 days please", "2026-05-22 10:00:00", ANCHOR, "errors please"),
    ("what broke today", "2026-05-25 00:00:00", ANCHOR, "what broke"),
    ("what broke yesterday", "2026-05-24 00:00:00", "2026-05-25 00:00:00", "what broke"),
    ("incidents since Q2", "2026-04-01 00:00:00", "2026-06-30 23:59:59", "incidents"),
    ("deploys since March 12", "2026-03-12 00:00:00", ANCHOR, "deploys"),
    ("deploys since December 24", "2025-12-24 00:00:00", ANCHOR, "deploys"),
    ("deploys after 2026-05-20", "2026-05-20 00:00:00", ANCHOR, "deploys"),
    ("since Feb 30 nothing", None, None, "since Feb 30 nothing"),
    ("no time at all", None, None, "no time at all"),
])
def test_calendar_phrases(spark, question, start, end, clean):
    df = spark.createDataFrame([(question,)], "q string").withColumn(
        "r", phrases.calendar_range(F.col("q"), F.lit(ANCHOR).cast("timestamp")))
    row = df.select(F.col("r.start").cast("string").alias("s"), F.col("r.end").cast("string").alias("e"),
                    phrases.without_phrase(F.col("q"), F.col("r.phrase")).alias("c")).first()
    assert (row["s"], row["e"], row["c"]) == (start, end, clean)


def test_mentions_keep_the_first_case_and_order(spark):
    body = "Project Apollo hit INC-42; @ana.k and apollo team paged, postgres postgresql in PROD. sev-1 é-prod aprod"
    found = value(spark, text.mentions(F.col("t")), t=body)
    names = [(m["name"], m["type"]) for m in found]
    assert names == [("Apollo", "project"), ("INC-42", "incident"), ("sev-1", "incident"), ("ana.k", "person"),
                     ("PostgreSQL", "system"), ("prod", "environment")]


@pytest.mark.parametrize("seconds, shown", [(0, "0s"), (59.9, "59s"), (61, "1m"), (3660, "1h 1m"), (90000, "1d 1h")])
def test_durations(spark, seconds, shown):
    assert value(spark, text.duration_text(F.lit(float(seconds)))) == shown


def test_cosine_cases(spark):
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert value(spark, scoring.cosine(a, a)) == pytest.approx(1.0)
    assert value(spark, scoring.cosine(a, F.array(F.lit(-2.0), F.lit(1.0)))) == pytest.approx(0.0)
    assert value(spark, scoring.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


@pytest.mark.parametrize("raw, found", [
    ('{"a": 1}', True), ('Sure! {"a": 1} done', True), ('```json\n{"a": 1}\n```', True), ("[1, 2]", False), ("{broken", False), ("", False)])
def test_json_salvage(spark, raw, found):
    assert (value(spark, extraction.salvage_json(F.col("r")), r=raw) is not None) == found


def test_model_answers_are_checked(spark):
    raw = ('Here: {"entities": [{"name": " Billing API ", "type": "SYSTEM"}, {"name": "Ana", "type": "wizard"}],'
           '"relationships": [{"source": "ana", "target": "billing api", "type": "Depends-On", "confidence": "7"},'
           '{"source": "Ana", "target": "Ghost", "type": "owns"}, {"source": "Ana", "target": "Ana", "type": "likes", "confidence": "?"}]}')
    row = extraction.parse_responses(spark.createDataFrame([(raw,), ("nope",)], "response string")).collect()
    good, bad = row
    assert [(e["name"], e["type"]) for e in good["entities"]] == [("Billing API", "system"), ("Ana", "document")]
    assert [(r["type"], r["confidence"]) for r in good["relationships"]] == [("depends_on", 1.0), ("related_to", 0.8)]
    assert bad["entities"] == [] and bad["relationships"] == []


def test_event_answers_are_checked(spark):
    raw = ('{"events": [{"event_type": "Major Outage", "title": "DB down", "severity": "HIGH", "timestamp": "2026-05-25T10:00:00Z"},'
           '{"event_type": "party", "title": "Launch", "severity": "wild"}],'
           '"relationships": [{"source_title": "db down ", "target_title": "Launch", "relationship_type": "caused by"},'
           '{"source_title": "x", "target_title": "Launch", "relationship_type": "affects"}]}')
    row = extraction.parse_event_responses(spark.createDataFrame([(raw,)], "response string")).first()
    assert [(e["event_type"], e["severity"]) for e in row["events"]] == [("incident", "high"), ("decision", None)]
    assert [r["relationship_type"] for r in row["relationships"]] == ["caused_by"]


def test_recursive_chunks_cover_the_text():
    body = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(60)) for i in range(9)) + "\n" + "".join(f"q{i:04d}" for i in range(300))
    chunks = chunking.split_text(body)
    assert all(0 < len(c) <= 600 for c in chunks)
    squeezed = "".join(body.split())
    at = 0
    for c in chunks:
        piece = "".join(c.split())
        found = squeezed.find(piece, max(0, at - 700))
        assert 0 <= found <= at, "a gap between chunks"
        at = max(at, found + len(piece))
    assert at == len(squeezed)
    assert chunking.split_text("short") == ["short"]


def test_workspace_scope(spark):
    rows = [(None, None, "default_workspace"), ("a", None, "a"), ("a", "b", "b"), (" a ", "", "a"), ("  ", None, "default_workspace")]
    df = spark.createDataFrame(rows, "q string, t string, want string")
    for r in df.select("want", normalize.workspace_scope(F.col("q"), F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_enrichment_falls_back_to_the_original(spark):
    docs = spark.createDataFrame([("1", "ok"), ("2", "12")], "id string, content string")
    out = normalize.enrich(docs, lambda d: d.withColumn("content", F.col("content").try_cast("int").cast("string")))
    assert sorted(map(tuple, out.collect())) == [("1", "ok"), ("2", "12")]
