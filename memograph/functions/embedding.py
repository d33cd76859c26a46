"""Text vectors: a hashing default that needs no model, and the hook for a real one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]


def batched(encode: Callable[[list[str]], list[list[float]]]) -> Embedder:
    """Wrap a model's batch encoder as an Arrow UDF; the model loads where the data is."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()))

    return lambda c: vectors(c)


def hashed_trigrams(size: int = 128) -> Embedder:
    """Counts of hashed letter trigrams: a vector for short names that tolerates spelling."""

    def encode(names: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out, slots = [], {}
        for name in names:
            padded = f"  {name.lower()} "
            three = [padded[i:i + 3] for i in range(len(padded) - 2)]
            for t in set(three).difference(slots):
                slots[t] = zlib.crc32(t.encode()) % size
            out.append(np.bincount([slots[t] for t in three], minlength=size).astype("float32"))
        return out

    return batched(encode)


def hashed_text(size: int = 384) -> Embedder:
    """Counts of hashed words over whole texts, computed per Arrow batch."""

    def encode(texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        import numpy as np

        out = []
        for body in texts:
            words = re.findall(r"\w+", body.lower())
            slots = [zlib.crc32(w.encode()) % size for w in words]
            out.append(np.bincount(slots, minlength=size).astype(float).tolist() if slots else [0.0] * size)
        return out

    return batched(encode)
