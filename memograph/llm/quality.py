"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its own and of its neighbours; the field labels it good or bad
given the labels beside it. Forward-backward gives each line's marginal, and a document's
quality is the length-weighted mean of them, calibrated to a probability.

Training reads a bounded sample of labelled rows: at most `per_class` documents of each
label, first in hash order, from the folds that are not held out. Document labels stand
in for line labels at first; then the lines of bad documents that the field itself finds
good are relabelled and it is trained once more, since such documents often open well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER, DIGIT, SPACE, STOP, SYMBOL, PIPE, HIGH = range(8)
OWN = 13
#: Documents that score below are rejected.
ACCEPT = 0.7
PIECE = 1 << 22


def _classes() -> np.ndarray:
    kind = np.full(256, SYMBOL, dtype=np.int64)
    kind[128:] = HIGH
    for chars, k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"0123456789", DIGIT),
                     (b" \t\r\x0b\x0c\n", SPACE), (b".,;:?'\"-()", STOP), (b"|", PIPE)):
        kind[list(chars)] = k
    return kind


KINDS = _classes()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their lengths, lines per text). A text without line ends, or an empty one, is one line."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    per_text = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    n = int(per_text.sum())
    counts = np.zeros(n * 8, dtype=np.int64)
    line = 0
    for at in range(0, len(data), PIECE):
        piece = data[at:at + PIECE]
        ends = piece == 10
        lines = line + np.cumsum(ends) - ends
        counts += np.bincount(lines * 8 + KINDS[piece], minlength=n * 8)
        line = int(lines[-1] + ends[-1])
    counts = counts.reshape(n, 8).astype(np.float64)
    words, repeats, distinct, again, stops = (np.zeros(n) for _ in range(5))
    i = 0
    for text in texts:
        seen: set[bytes] = set()
        for raw in text.split(b"\n"):
            found = raw.split()
            words[i] = len(found)
            distinct[i] = len(set(found))
            repeats[i] = sum(map(eq, found, found[1:]))
            again[i] = bool(found) and raw in seen
            stops[i] = raw.rstrip()[-1:] in b".!?" and bool(found)
            seen.add(raw)
            i += 1
    length = counts.sum(axis=1)
    ends_of_lines = np.ones(n)
    ends_of_lines[-1] = 0
    length = length - ends_of_lines  # the line end itself
    some = np.maximum(length, 1.0)
    letters = counts[:, UPPER] + counts[:, LOWER] + counts[:, HIGH]
    x = np.stack([
        np.log1p(length), letters / some, counts[:, UPPER] / np.maximum(counts[:, UPPER] + counts[:, LOWER], 1.0), counts[:, DIGIT] / some,
        counts[:, SYMBOL] / some, counts[:, STOP] / some, counts[:, PIPE] / some, repeats / np.maximum(words - 1, 1.0),
        distinct / np.maximum(words, 1.0), np.minimum(length / np.maximum(words, 1.0), 40.0), again, stops, words == 0], axis=1)
    return x, np.maximum(length, 1.0), per_text


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after (zero at the ends), first and last flags, and a constant."""
    starts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    first, last = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    first[starts] = True
    last[starts + per_text - 1] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first] = 0
    after[last] = 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], axis=1)


def marginals(good: np.ndarray, trans: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once: (P(good) per line, expected transitions summed, log partition summed).

    good: a line's score for good, against 0 for bad. Chains are advanced together,
    longest first, so each step touches only the chains that are still running.
    """
    order = np.argsort(-per_text, kind="stable")
    length = per_text[order]
    start = np.concatenate([[0], np.cumsum(per_text)[:-1]])[order]
    unary = np.stack([np.zeros_like(good), good], axis=1)
    steps = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than t
    alpha, beta = unary.copy(), np.zeros_like(unary)
    for t in range(1, steps):
        at = start[:running[t]] + t
        prior = alpha[at - 1]
        alpha[at] += np.logaddexp(prior[:, :1] + trans[0], prior[:, 1:] + trans[1])
    for t in range(steps - 1, 0, -1):
        at = start[:running[t]] + t
        after = beta[at] + unary[at]
        beta[at - 1] = np.logaddexp(trans[:, 0] + after[:, :1], trans[:, 1] + after[:, 1:])
    ends = start + length - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z_line = np.empty(len(good))
    z_line[np.concatenate([[0], np.cumsum(per_text)[:-1]])] = 0
    chain = np.repeat(np.arange(len(per_text)), per_text)
    z_text = np.empty(len(per_text))
    z_text[order] = log_z
    p = np.exp(alpha[:, 1] + beta[:, 1] - z_text[chain])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(good), dtype=bool)
    inner[np.concatenate([[0], np.cumsum(per_text)[:-1]])] = False
    to = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(alpha[to - 1, a] + trans[a, b] + unary[to, b] + beta[to, b] - z_text[chain[to]]).sum()
    return p, pairs, float(log_z.sum())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def lines(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        full = (with_neighbours(x, per_text) - self.mean) / self.scale
        return marginals(full @ self.weights, self.trans, per_text)[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, length, per_text = line_features(texts)
        return self.calibrated(document_means(self.lines(x, per_text), length, per_text))

    def calibrated(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * spread(means) + self.offset)))


def spread(means: np.ndarray) -> np.ndarray:
    kept = np.clip(means, 1e-4, 1 - 1e-4)
    return np.log(kept / (1 - kept))


def document_means(p: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    return np.add.reduceat(p * length, starts) / np.add.reduceat(length, starts)


def _climb(full: np.ndarray, y: np.ndarray, per_text: np.ndarray, weight: np.ndarray, w: np.ndarray, trans: np.ndarray,
           steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the conditional likelihood of the line labels."""
    starts = np.zeros(len(y), dtype=bool)
    starts[np.concatenate([[0], np.cumsum(per_text)[:-1]])] = True
    to = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1], y[to]), 1.0)
    n = len(y)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        p, pairs, _ = marginals(full @ w, trans, per_text)
        grad = np.concatenate([full.T @ ((y - p) * weight), (seen - pairs).ravel()]) / n
        grad -= ridge * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    return w, trans


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], prior: float, chain: int = 64, steps: int = 120, rounds: int = 2, ridge: float = 1e-4) -> Model:
    """The field from (line features, line lengths, label) of documents. Chains are cut every `chain` lines for training only."""
    x = np.concatenate([t[0] for t in texts])
    length = np.concatenate([t[1] for t in texts])
    per_text = np.array([len(t[1]) for t in texts], dtype=np.int64)
    label = np.array([t[2] for t in texts], dtype=np.int64)
    full = with_neighbours(x, per_text)
    mean, scale = full.mean(axis=0), full.std(axis=0)
    mean[-1], scale[-1] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    full = (full - mean) / scale
    pieces = np.array([c for n in per_text for c in [chain] * (n // chain) + ([n % chain] if n % chain else [])], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), per_text)
    y = label[owner]
    w, trans = np.zeros(full.shape[1]), np.zeros((2, 2))
    for again in range(rounds):
        share = np.bincount(y, minlength=2) / len(y)
        weight = 0.5 / np.maximum(share[y], 1e-3)
        w, trans = _climb(full, y, pieces, weight, w, trans, steps, ridge)
        p = marginals(full @ w, trans, per_text)[0]
        if again < rounds - 1:
            starts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
            worst = np.minimum.reduceat(p, starts)[owner]
            y = np.where(label[owner] == 1, 1, np.where((p < 0.5) | (p <= worst), 0, 1))
    means = spread(document_means(p, length, per_text))
    # Calibration: logistic, each class weighted to its share among all labelled rows.
    mass = np.where(label == 1, prior / max((label == 1).mean(), 1e-9), (1 - prior) / max((label == 0).mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-(a * means + b)))
        g = np.array([((label - s) * mass * means).sum() - 0.01 * (a - 1), ((label - s) * mass).sum() - 0.01 * b])
        h = mass * s * (1 - s)
        hess = np.array([[(h * means * means).sum() + 0.01, (h * means).sum()], [(h * means).sum(), h.sum() + 0.01]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return Model(mean, scale, w, trans, max(a, 1e-3), b)


def held_out(id_col: Column, folds: int = 4, held: int = 2) -> Column:
    """Rows whose crc32 of the id's text leaves the held remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == held, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_class: int = 1500) -> Model | float:
    """The model, or the share of good rows (0.5 without any) where the labels hold fewer than two classes."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = None
    for k in (0, 1):
        some = known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return float(next(iter(totals), 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, length, _ = line_features([batch.column(2)[at].as_py() or b""])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[at:at + 1], batch.column(1)[at:at + 1], pa.array([x.astype(np.float32).tobytes()], pa.binary()),
                    pa.array([length.astype(np.float32).tobytes()], pa.binary())], ["id", "label", "x", "length"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(run, "id long, label int, x binary, length binary")
    sample = sorted((r["id"], r["label"], bytes(r["x"]), bytes(r["length"])) for r in rows.collect())  # at most 2 * per_class documents' features
    if len({r[1] for r in sample}) < 2:
        return totals.get(1, 0) / sum(totals.values())
    return fit([(np.frombuffer(x, np.float32).reshape(-1, OWN).astype(np.float64), np.frombuffer(n, np.float32).astype(np.float64), k)
                for _, k, x, n in sample], totals[1] / sum(totals.values()))


def _groups(column: pa.Array, most: int = 1 << 21) -> Iterator[list[bytes]]:
    """Texts in groups of about `most` bytes; a longer text is a group of its own."""
    group, size = [], 0
    for value in column:
        text = value.as_py() or b""
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def score(docs: DataFrame, model: Model | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column between 0 and 1 (higher: better), from the whole text alone.

    Null counts as empty; an empty text is one empty line and is scored. Repeated and tied
    rows score alike. Without a model (fewer than two classes were labelled) each row scores
    the given share. A column of docs called as the score is replaced; others are kept.
    """
    rest = [c for c in docs.columns if c != name]
    if not isinstance(model, Model):
        return docs.select(*rest, F.lit(float(model)).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            parts = [model.score(g) for g in _groups(texts)]
            value = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value, pa.float64())], [*rest, name])

    schema = docs.select(*rest).schema.add(name, "double")
    return docs.select(*rest, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)
