import random

from memograph.llm import chunk_dedup

SCHEMA = "doc_id long, text string, found string, start int"


def brute(rows, least=16, bits=5, most=128, min_bytes=80):
    """Chunk by a byte-by-byte gear hash, count digests as the bytes themselves."""
    def pieces(data):
        out, start, h = [], 0, 0
        for i, byte in enumerate(data):
            h = ((h << 1) + int(chunk_dedup.GEAR[byte])) & 0xFFFF
            size = i + 1 - start
            if size == most or (size >= least and h >> (16 - bits) == 0):
                out.append((start, i + 1))
                start = i + 1
        return out + ([(start, len(data))] if start < len(data) else [])
    seen, count, first = {}, {}, {}
    cut = [(d, t.encode() if t else b"", pieces(t.encode() if t else b"")) for d, t in rows]
    for d, data, parts in cut:
        for s, e in parts:
            count[data[s:e]] = count.get(data[s:e], 0) + 1
            first[data[s:e]] = min(first.get(data[s:e], d), d)
    out = []
    for d, data, parts in cut:
        own, goes = set(), []
        for s, e in parts:
            c = data[s:e]
            if count[c] > 1 and (c in own or d > first[c]):
                goes.append((s, e - s))
            own.add(c)
        spans = chunk_dedup.removed_spans(data, goes, min_bytes)
        left, at = b"", 0
        for s, e in spans:
            left, at = left + data[at:s], e
        out.append((d, len(data), sum(e - s for s, e in parts if count[data[s:e]] > 1), sum(e - s for s, e in spans), len(spans), (left + data[at:]).decode()))
    return sorted(out)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(n))


def data():
    rng = random.Random(2)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, rng.randint(0, 90))} {passage} {prose(rng, 30)}") for i in range(12)]
    rows += [(50 + i, prose(rng, 200)) for i in range(10)]
    rows += [(90, rows[3][1]), (91, None), (92, ""), (93, "a" * 5000), (94, prose(rng, 30000)), (95, passage + passage)]
    return rows, passage


def test_matches_byte_by_byte(spark):
    rows, passage = data()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in chunk_dedup.dedup(docs).collect())
    assert got == brute(rows)
    by_id = {r[0]: r for r in got}
    assert all(by_id[i][3] > 0 for i in range(1, 12)) and all(by_id[i][3] == 0 for i in range(50, 60)) and by_id[0][3] == 0
    assert sum(passage in r[5] for r in got) == 1


def test_repeated_rows_and_empty(spark):
    rows, _ = data()
    docs = spark.createDataFrame([(1, rows[0][1], "x", 1)] * 2 + [(None, rows[0][1], "x", 1)], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in chunk_dedup.dedup(docs).collect())
    assert got == [(0, True), (1, False), (1, False)]
    assert chunk_dedup.dedup(docs.limit(0)).count() == 0
