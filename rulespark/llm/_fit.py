"""What the two classifiers share: bounded samples of labelled rows and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, most_bytes: int) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """(label, text) of at most `rows` labelled ids of each class, the first by their hashes, whose texts have at most most_bytes bytes; and
    the number of all labelled ids to learn from by class. Null labels and ids are left out; the largest of repeated labels and one text of
    a repeated id (the least by hash, then by itself) count."""
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    chosen = [marks.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 * rows at most
    short = docs.filter(F.octet_length("text") <= most_bytes).select("doc_id", "text")
    one = short.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))  # so 2 * rows at most are collected
    got = [(r["y"], r["text"]) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").select("y", "t.text").collect()]
    return got, totals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic fit by Newton steps, the intercept last; x should be near unit scale."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
