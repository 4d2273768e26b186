"""Toxicity by subword bags: averaged embeddings under a linear softmax, fitted together.

A word is the bag of its byte n-grams (3 to 5, with its boundaries), hashed to 2 ** BUCKET_BITS vectors; a window of WINDOW words is
the average of its words. Embeddings and softmax are trained jointly with numpy on windows. Labels are of documents, and an
insult may be one word of thousands, so training goes in rounds: at first all windows carry their document's label, then toxic
documents send their most toxic windows only, clean ones their most toxic-looking ones. A misspelling never seen shares most of
its n-gram vectors with the word it comes from. As the softmax is linear, scoring needs one number for each bucket; every window of
the whole text is scored, and a logistic fit on held-back training texts maps the highest window and the text's length to a probability.

The fit uses at most SAMPLE texts of each class of at most SAMPLE_BYTES bytes, by the order of their ids' hashes. Defined cases:
texts without words, null ones included, get the fit's score for no evidence; with labels of one class only the score is that
class's rate (0.5 without labels); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fit import fold, labelled_sample, logistic, sigmoid
from ._text import ALNUM, LOWER, blocks, prefix, read, span_hash, spans

SAMPLE, SAMPLE_BYTES = 900, 16_384
BUCKET_BITS, DIM, GRAMS, WINDOW = 16, 8, (3, 4, 5), 8
ROUNDS, STEPS, RATE, DECAY, TOP = 3, 40, 0.05, 1e-5, 2
THRESHOLD = 0.7
PLAIN = np.where(ALNUM, np.arange(256), 32).astype(np.uint8)


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, others than words' as a blank, with one blank before each text and at the end."""
    out = np.full(len(data) + len(offs), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(offs)), np.diff(offs))] = PLAIN[LOWER[data]]
    return out, offs + np.arange(len(offs))


def gram_ids(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that starts at each place)."""
    x = text.astype(np.uint32)
    h = x[:-1] * np.uint32(0x01000193) + x[1:] if len(x) > 1 else x[:0]
    for n in range(3, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :] if len(x) >= n else x[:0]
        yield n, (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)


def words_of(data: np.ndarray, offs: np.ndarray):
    text, at = padded(data, offs)
    s, e, wb = spans(text != 32, at)
    return text, s, e, wb


def word_scores(text: np.ndarray, s: np.ndarray, e: np.ndarray, per_bucket: np.ndarray) -> np.ndarray:
    """Mean of the bucket numbers of each word's n-grams."""
    total, count = np.zeros(len(s)), np.zeros(len(s))
    for n, ids in gram_ids(text):
        c = np.concatenate([[0.0], np.cumsum(per_bucket[ids])])
        to = np.maximum(e + 2 - n, s - 1)
        total += c[np.minimum(to, len(ids))] - c[np.minimum(s - 1, len(ids))]
        count += to - (s - 1)
    return total / np.maximum(count, 1)


@dataclass
class Model:
    per_bucket: np.ndarray | None
    weights: np.ndarray
    rate: float


def highest(text: np.ndarray, s: np.ndarray, e: np.ndarray, wb: np.ndarray, per_bucket: np.ndarray) -> np.ndarray:
    """(highest window, log of 1 + words) of each text."""
    c = np.concatenate([[0.0], np.cumsum(word_scores(text, s, e, per_bucket))])
    out = np.zeros((len(wb) - 1, 2))
    for i, (a, b) in enumerate(zip(wb.tolist(), wb[1:].tolist())):
        if b > a:
            k = min(WINDOW, b - a)
            out[i] = (c[a + k : b + 1] - c[a : b + 1 - k]).max() / k, np.log1p(b - a)
    return out


def _train(windows: np.ndarray, y: np.ndarray, grams: np.ndarray, starts: np.ndarray, state: list, steps: int) -> None:
    """Adam steps on all windows at once; windows: word numbers, -1 for none; grams[starts[w]:starts[w+1]] are word w's."""
    emb, soft = state
    n_grams = np.diff(starts)
    there = windows >= 0
    size = there.sum(1, keepdims=True)
    flat, row = windows[there], np.nonzero(there)[0]
    goal = np.eye(2)[y]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))[:, None]
    of = np.repeat(np.arange(len(n_grams)), n_grams)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in state]
    for t in range(1, steps + 1):
        word = np.add.reduceat(emb[grams], starts[:-1], axis=0) / n_grams[:, None]
        mean = np.stack([np.bincount(row, word[flat, d], len(windows)) for d in range(DIM)], 1) / size
        z = mean @ soft[:-1] + soft[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - goal) * weight
        d_soft = np.vstack([mean.T @ dz, dz.sum(0)])
        d_mean = dz @ soft[:-1].T / size
        d_word = np.stack([np.bincount(flat, d_mean[row, d], len(n_grams)) for d in range(DIM)], 1) / n_grams[:, None]
        d_emb = np.stack([np.bincount(grams, d_word[of, d], len(emb)) for d in range(DIM)], 1)
        for p_, g, m in zip(state, (d_emb + DECAY * emb, d_soft + DECAY * soft), moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            p_ -= RATE * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)


def fit(rows: list[tuple[int, str]], totals: dict[int, int], seed: int = 7) -> Model:
    """rows: (label, text); every third text calibrates only."""
    total = sum(totals.values())
    rate = totals.get(1, 0) / total if total else 0.5
    rows = [(y, t) for y, t in rows if t]
    part = [[r for i, r in enumerate([r for r in rows if r[0] == y]) if (i % 3 > 0) == learn] for learn in (True, False) for y in (0, 1)]
    if min(map(len, part)) < 2:
        return Model(None, np.zeros(3), rate)
    learn, check = part[0] + part[1], part[2] + part[3]

    def joined(some):
        data = [t.encode() for _, t in some]
        return words_of(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))

    text, s, e, wb = joined(learn)
    _, first, number = np.unique(span_hash(prefix(text), s, e), return_index=True, return_inverse=True)
    ids = dict(gram_ids(text))
    bags = [np.concatenate([ids[n][max(a - 1, 0) : max(b + 2 - n, a - 1)] for n in GRAMS]) for a, b in zip(s[first].tolist(), e[first].tolist())]
    bags = [b if len(b) else np.zeros(1, np.uint32) for b in bags]
    grams, starts = np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    windows, doc = [], []
    for i, (a, b) in enumerate(zip(wb.tolist(), wb[1:].tolist())):
        for at in range(a, b, WINDOW):
            w = number[at : min(b, at + WINDOW)]
            windows.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1))
            doc.append(i)
    windows, doc = np.array(windows), np.array(doc)
    label = np.array([y for y, _ in learn])
    rng = np.random.default_rng(seed)
    state = [rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)), rng.normal(0, 0.1, (DIM + 1, 2))]
    chosen = np.arange(len(windows))
    for _ in range(ROUNDS):
        _train(windows[chosen], label[doc[chosen]], grams, starts, state, STEPS)
        per_bucket = state[0] @ (state[1][:-1, 1] - state[1][:-1, 0])
        by_word = np.add.reduceat(per_bucket[grams], starts[:-1]) / np.diff(starts)
        value = np.where(windows >= 0, by_word[windows], 0).sum(1) / (windows >= 0).sum(1)
        order = np.lexsort((-value, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        chosen = order[(rank < TOP) | ((label[doc[order]] == 0) & (rank < 6 * TOP))]
    text, s, e, wb = joined(check)
    x = highest(text, s, e, wb, per_bucket)
    y = np.array([y for y, _ in check], float)
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    return Model(per_bucket.astype(np.float32), logistic(x, y, weight * len(y) / weight.sum(), ridge=0.01), rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(1)):
                if m.per_bucket is None:
                    out = np.full(b - a, m.rate)
                else:
                    out = sigmoid(highest(*words_of(data, offs), m.per_bucket) @ m.weights[:-1] + m.weights[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = fit(*labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", ~held, SAMPLE, SAMPLE_BYTES))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
