import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memograph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", " ", "\n", "  a", "a  ", " \n b", "\n\n c\n", "it's", "''s", "it's's they'll'd x'ready 'tis 'Re", " 's", "a 's b", "!'s", "don't", "'", "'s", "x'", "'l", "'ll",
          "<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "x y  z", "\x1c\x1d a\x85b", "1½²Ⅷ٣ 4", "naïve Ünï 中文字 日本",
          "\U0001f600 👍🏽", "é ‍", "tab\tand\r\n", "'<|endoftext|>s", "'r<|endoftext|>e", "\x00a", "a\n", "  \n  "]


def random_texts(rng, n):
    letters = "ab'stmdrevl \n\t!é1٣½中 　😀<|>"
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_split_as_the_library(tokenizer):
    classes = bpe.character_classes()
    texts = [t for t in TRICKY + random_texts(random.Random(1), 5000) if "<|endoftext|>" not in t]
    words, counts = bpe.split_words([t.encode() for t in texts], [b"<|endoftext|>"], classes)
    words, at = words.to_pylist(), 0
    for t, n in zip(texts, counts):
        own = tokenizer.pre_tokenizer.pre_tokenize_str(t)
        assert [w.decode() for w in words[at:at + n]] == [t[s:e] for _, (s, e) in own], t
        at += n


def test_encode_and_decode(spark, tokenizer):
    texts = TRICKY + random_texts(random.Random(2), 300) + ["word " * 50000, None, "same", "same"]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "no id", 1, "x")], "doc_id long, text string, ids int, block string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).withColumn("n", F.length("ids")).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], dtype="<u4").tolist() == ids, t
        assert got[k]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) == (t or "")
    together = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode(docs, PATH, decoded=True).collect()}
    assert together == {k: (r["ids"], r["decoded"]) for k, r in got.items()}
    assert bpe.encode(docs.limit(0), PATH, decoded=True).count() == 0


def test_numbers_round_trip():
    for values in ([], [0], [65535, 3], [65536, 1], [2 ** 32 - 1]):
        v = np.array(values, dtype=np.uint32)
        assert bpe.unsqueezed(bpe.squeezed(v)).tolist() == values


def test_decode_any_ids(spark, tokenizer):
    rng = random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 12))] for _ in range(300)]
    rows = spark.createDataFrame([(k, bytearray(np.array(x, dtype="<u4").tobytes())) for k, x in enumerate(lists)] + [(-1, None)], "k long, ids binary")
    got = {r["k"]: r["decoded"] for r in bpe.decode(rows, PATH).collect()}
    assert got.pop(-1) == ""
    assert got == {k: tokenizer.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)}


def test_query(spark, tokenizer):
    from memograph.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op4_bpe_roundtrip"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
