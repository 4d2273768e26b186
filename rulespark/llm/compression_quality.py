"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled text. A text is compressed block by block under each, and the difference of the
sizes, divided by the plain size, says which dictionary knows it better. A logistic fit on labelled texts that the
dictionaries have not seen turns the mean and the worst block of that difference, and the same of the compression ratio itself
(repetition compresses well under any dictionary), into a probability.

The fit uses at most SAMPLE texts of each class of at most SAMPLE_BYTES bytes, taken by the order of their ids' hashes, whatever
the number of labels; scoring reads whole texts. Defined cases: null and empty texts get the score of neutral
features, the means of the fit; with labels of one class only the score is that class's rate (0.5 without labels); repeated rows each
give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fit import fold, labelled_sample, logistic, sigmoid
from ._text import blocks, read

SAMPLE, SAMPLE_BYTES, PIECE, DICT_BYTES, LEVEL = 2000, 32_768, 2048, 65_536, 1
THRESHOLD = 0.3


@dataclass
class Model:
    """dictionaries: good and bad; without them every text gets `rate`."""

    dictionaries: tuple[bytes, bytes] | None
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = []
        for d in model.dictionaries or ():
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: memoryview) -> np.ndarray:
        """Mean and worst size difference, mean and least ratio; NaN for an empty text."""
        if not len(text):
            return np.full(4, np.nan)
        n = max(1, round(len(text) / PIECE))
        cuts = [len(text) * i // n for i in range(n + 1)]
        length = np.diff(cuts)
        good, bad = (np.array([len(c.compress(text[a:b])) for a, b in zip(cuts, cuts[1:])]) for c in self.pair)
        lean, ratio = (bad - good) / length, np.minimum(good, bad) / length
        return np.array([(bad - good).sum() / len(text), lean.min(), np.minimum(good, bad).sum() / len(text), ratio.min()])

    def scores(self, x: np.ndarray) -> np.ndarray:
        m = self.model
        z = np.nan_to_num((x - m.centre) / m.scale)
        return sigmoid(np.hstack([z, z**2]) @ m.weights[:-1] + m.weights[-1])


def fit(rows: list[tuple[int, str]], totals: dict[int, int]) -> Model:
    """rows: (label, text); every third of a class calibrates, the others make its dictionary."""
    total = sum(totals.values())
    rate = totals.get(1, 0) / total if total else 0.5
    texts = {y: [t.encode() for z, t in rows if z == y and t] for y in (0, 1)}
    nothing = Model(None, np.zeros(4), np.ones(4), np.zeros(9), rate)
    if min(map(len, texts.values())) < 8:
        return nothing
    made = []
    for y in (1, 0):
        pieces = [t[a : a + PIECE] for i, t in enumerate(texts[y]) if i % 3 for a in range(0, len(t), PIECE)]
        try:
            made.append(zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text for statistics: the text itself is the dictionary
            made.append(b"".join(pieces)[-DICT_BYTES:])
    scorer = Scorer(Model((made[0], made[1]), np.zeros(4), np.ones(4), np.zeros(9), rate))
    held = [(y, scorer.features(memoryview(t))) for y in (0, 1) for i, t in enumerate(texts[y]) if i % 3 == 0]
    x, label = np.array([f for _, f in held]), np.array([y for y, _ in held], float)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    weight = np.where(label == 1, totals[1] / max(1, label.sum()), totals[0] / max(1, (1 - label).sum()))
    weight *= len(label) / weight.sum()
    return Model((made[0], made[1]), centre, scale, logistic(np.hstack([z, z**2]), label, weight, ridge=0.1), rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(1)):
                if scorer.pair:
                    view = memoryview(np.ascontiguousarray(data))
                    out = scorer.scores(np.array([scorer.features(view[p:q]) for p, q in zip(offs.tolist(), offs[1:].tolist())]))
                else:
                    out = np.full(b - a, scorer.model.rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = fit(*labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", ~held, SAMPLE, SAMPLE_BYTES))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
