"""The pipeline's stages against brute force, each on what the one before kept."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from memograph.llm import minhash, quality, simhash
from test_minhash import brute
from test_mixing import fill

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, kept = docs.columns, rows(docs), []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        folder = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{at}"
        after.write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        kept.append(rows(docs))
    good, exact, near, mixed, coded = kept

    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert good == [r for r in before if model.score([r[1].encode()])[0] >= quality.ACCEPT]
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r[0] for r in good}
    assert all((i in ids) == bool(q) for i, q in truth.items())

    groups = {}
    for r in good:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), []).append(r)
    assert exact == sorted((max(g) for g in groups.values()), key=str)

    root = brute([(r[0], r[1]) for r in exact])
    heads = {r[0] for r in exact if root[r[0]] == r[0]}
    assert set(near) <= set(exact) and len(heads ^ {r[0] for r in near}) <= 0.02 * len(exact)

    times, sizes = Counter(r[0] for r in mixed), {}
    for r in near:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    order = sorted(sizes)
    want = fill(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, sum(sizes.values()), 3)
    for s in sizes:
        own = [r for r in near if r[3] == s]
        taken = sum(times[r[0]] * len(r[1].split()) for r in own)
        assert abs(taken - want[s]) <= max(len(r[1].split()) for r in own)
        assert max(times[r[0]] for r in own) - min(times[r[0]] for r in own) <= 1 and max(times[r[0]] for r in own) <= 3
    assert {r for r in mixed} <= set(near)

    tokenizer, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r[0]: r[1] for r in near}
    assert Counter(r[0] for r in coded) == times
    for i, n, raw, digest, back in coded:
        ids = np.array(tokenizer.encode(text[i], add_special_tokens=False).ids, dtype="<u4")
        assert (n, bytes(raw), digest) == (len(ids), ids.tobytes(), hashlib.sha256(ids.tobytes()).hexdigest())
        assert back == hashlib.sha256(text[i].encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_near_dedup_takes_candidates_from_fingerprints(spark, monkeypatch):
    """The stage's SimHash links texts within two bits, each pair then checked at 0.8."""
    words = [f"w{k}" for k in range(3000)]
    other = [f"v{k}" for k in range(3000)]
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), " ".join(other), "one\n" * 400 + "a b c d e f", "one\n" * 400 + "g h i j k l"]
    fps = [simhash.fingerprint(t.encode(), 5, 42) for t in texts]
    assert [(fps[a] ^ fps[b] & (1 << 64) - 1).bit_count() <= 2 for a, b in ((0, 1), (3, 4), (0, 2))] == [True, True, False]
    classes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    assert sorted(map(tuple, minhash.fingerprint_pairs(classes).collect())) == [(0, 1), (3, 4)]

    asked, link = [], simhash.link
    monkeypatch.setattr(simhash, "link", lambda *given: asked.append(1) or link(*given))
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 2, 3, 4]
    assert asked == [1]
