import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from memograph.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(1), np.full(512, 7), np.arange(513), rng.integers(0, 50257, 5000), rng.integers(0, 1 << 32, 1500),
                np.where(rng.random(4000) < 0.03, 2 ** 32 - 1, rng.integers(100, 130, 4000)), np.array([0, 2 ** 32 - 1] * 700)):
        ids = ids.astype(np.uint32)
        for percentile in (1.0, 50.0, 95.0, 100.0):
            data = token_files.file_bytes(ids, [5, None], np.array([len(ids), 0]), percentile)
            own, ends, back = token_files.parse_file(data)
            assert own == [5, None] and ends.tolist() == [len(ids)] * 2 and (back == ids).all()
    narrow = token_files.file_bytes(np.where(rng.random(5120) < 0.03, 50000, rng.integers(0, 16, 5120)).astype(np.uint32), [], np.zeros(0, int), 95.0)
    assert len(narrow) < 5120 * 1.1


def test_files_in_id_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-5, 60) if k % 3 else 17, " ".join(rng.choices(["the", "naïve", "x", "\n", "zz"], k=rng.randint(0, 30))), 1) for k in range(300)]
    rows += [(None, "no id", 1), (70, None, 1), (71, "", 1), (72, "long " * 40000, 1), (70, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(5)
    manifest = token_files.write(docs, PATH).cache()
    assert manifest.count() > 3
    got = token_files.read(spark, manifest).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    coded = {}
    for i, t, _ in rows:
        coded.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r["id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["start"] == at
        coded[r["id"]].remove(ids)
        at += len(ids)
    assert not any(coded.values())
    # The hot id is spread over several files.
    hot = [m for m in manifest.collect() if m["n_texts"]]
    assert max(m["n_texts"] for m in hot) < 0.5 * len(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = token_files.write(docs, PATH)
    assert manifest.count() == 0 and token_files.read(spark, manifest).count() == 0


def test_query(spark):
    from memograph.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    tokenizer, at = Tokenizer.from_file(PATH), 0
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op3_token_files"](spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
