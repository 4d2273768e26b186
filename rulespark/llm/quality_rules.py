"""Quality rules whose cutoffs come with a guarantee.

Every rule is a ratio of counts (larger is worse) with a fixed ladder of STEPS cutoffs, loosest first. The ladders are climbed together: at step t
every rule has its t-th cutoff, and a document is rejected if any rule rejects it. On labelled good documents (quality 1), per stratum, the
steps are tested from the loose end: a step passes if the exact binomial tail P(Bin(n, ALPHA) <= false rejections) is at most
DELTA / strata, and testing stops at the first that doesn't. So with probability 1 - DELTA, in all strata at once, at most ALPHA of the good documents
of each stratum are rejected (fixed sequence within the ladder, Bonferroni over strata; one test for all rules needs no correction
over rules). Of the steps that passed, the one in use has the largest share of bad documents rejected less WEIGHT times that of good ones.
A stratum with too few labels has no cutoffs and keeps what the base rules keep.

Labels are counted over all labelled rows. Each value of the stratum column is a stratum, however many there are: strata are counted and
certified by executors, and cutoffs are a table (stratum, step) that is joined with the documents. It has only strata that were certified, which takes about 100
good labels of each at least. Values are never folded.

Defined cases: null and empty texts have no words and fail the base rules; a null stratum is a stratum of its own; null labels
are ignored, the worst of repeated ones counts; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import SOLID, U64, blocks, gram_hash, mix, per_text, prefix, read, span_hash, spans

ALPHA, DELTA, WEIGHT = 0.03, 0.05, 5.0
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(65, 91)))
BANG = np.isin(np.arange(256), list(b"!?"))
#: Numerator, denominator and the ladder's ends of each rule; every ladder has STEPS cutoffs in geometric steps.
STEPS = 24
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.5, 0.005),
    "repeats": ("n_repeat_words", "n_words", 0.5, 0.01),
    "same_lines": ("n_dup_lines", "n_word_lines", 0.9, 0.02),
    "capitals": ("n_upper", "word_chars", 0.9, 0.05),
    "shouts": ("n_bangs", "n_words", 0.9, 0.01),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_upper", "n_bangs")


def ladder(rule: str) -> list[float]:
    hi, lo = RULES[rule][2:]
    return [round(hi * (lo / hi) ** (i / (STEPS - 1)), 6) for i in range(STEPS)]


def _counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    solid = SOLID[data]
    s, e, wb = spans(solid, offs)
    n_words = wb[1:] - wb[:-1]
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    c = prefix(data)
    flat = lambda mask: per_text(mask, offs)
    out = {
        "n_words": n_words, "word_chars": flat(solid & ((data & 0xC0) != 0x80)), "n_symbols": flat(SYMBOLS[data]), "n_upper": flat(UPPER[data]), "n_bangs": flat(BANG[data]),
    }
    ls, le, lb = spans(data != 10, offs)
    n_solid = np.concatenate([[0], np.cumsum(solid)])
    full = n_solid[le] > n_solid[ls]
    line_text = np.repeat(np.arange(len(n_words)), lb[1:] - lb[:-1])[full]
    out["n_word_lines"] = np.bincount(line_text, minlength=len(n_words))
    keys = mix(span_hash(c, ls[full], le[full]) + line_text.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_text[same], minlength=len(n_words))
    cover = np.zeros(len(s), bool)
    if len(s) >= 3:
        g = gram_hash(span_hash(c, s, e), 3)
        at = np.flatnonzero(text_of[2:] == text_of[:-2])
        keys = mix(g[at] + text_of[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        twin = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][twin]] = twice[order[:-1][twin]] = True
        for i in range(3):
            cover[at[twice] + i] = True
    out["n_repeat_words"] = per_text(cover, wb)
    return out


def text_counts(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and COUNTS for each row."""
    kinds = dict(docs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(len(keys))):
                n = _counts(data, offs)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keys))), *(pa.array(n[k].astype(np.int64)) for k in COUNTS)], names=[*keys, *COUNTS])

    return docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").alias("_text")).mapInArrow(work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{k} long" for k in COUNTS)]))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), exactly."""
    top = lgamma(n + 1)
    return min(1.0, sum(exp(top - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(x + 1)))


def certify(good: list[int], bad: list[int], alpha: float, level: float, weight: float = WEIGHT) -> int | None:
    """The step in use, or None. good and bad: documents by the first step that rejects them; the last entry: by none."""
    n, m = sum(good), sum(bad)
    best, found, x, y = 0.0, None, 0, 0
    for step in range(len(good) - 1):
        x, y = x + good[step], y + bad[step]
        if not n or binomial_tail(x, n, alpha) > level:
            break
        gain = y / max(1, m) - weight * x / n
        if gain > best:
            best, found = gain, step
    return found


def _ratio(rule: str):
    top, under = RULES[rule][:2]
    return F.col(top) / F.greatest(F.col(under), F.lit(1))


def calibrate(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step): the step in use of each stratum that has one; counts has doc_id, stratum and COUNTS."""
    scratch = Scratch(counts.sparkSession)
    marks = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # The first step at which some rule rejects; STEPS: none does.
    step = lambda rule: F.size(F.filter(F.lit(ladder(rule)), lambda c: c >= _ratio(rule)))
    first = counts.select("doc_id", "stratum", F.least(*[step(rule) for rule in RULES]).alias("step"))
    cells = first.join(marks, "doc_id").groupBy("stratum", (F.col("quality") > 0).alias("good"), "step").count()
    strata = scratch.written(cells.groupBy("stratum").agg(F.collect_list(F.struct("good", "step", "count")).alias("cells")))  # at most 2 x (STEPS + 1) in each
    level = delta / max(1, strata.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for cells in batch.column(1).to_pylist():
                bad, good = [0] * (STEPS + 1), [0] * (STEPS + 1)
                for c in cells:
                    (good if c["good"] else bad)[c["step"]] += c["count"]
                at.append(certify(good, bad, alpha, level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], names=["stratum", "step"])

    out = scratch.written(strata.mapInArrow(work, "stratum string, step int").filter("step IS NOT NULL"))  # its size is known, so a small one is broadcast
    scratch.drop(strata)
    return out


def with_stratum(docs: DataFrame, col: str = "lang") -> DataFrame:
    """docs with stratum: "=" and the value, "" for null."""
    value = F.coalesce(F.concat(F.lit("="), F.col(f"`{col}`").cast("string")), F.lit(""))
    return docs.drop("stratum").withColumn("stratum", value)


def judged(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """doc_id, COUNTS, base_failed, failed_rules and kept for each row of docs. Texts are read twice, for cutoffs and for the verdict."""
    counts = text_counts(with_stratum(docs, stratum_col), ["doc_id", "stratum"])
    return verdicts(counts, calibrate(counts, labels))


def kept_rows(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, as they are. Texts are read twice, for cutoffs and for the verdict."""
    cutoffs = calibrate(text_counts(with_stratum(docs, stratum_col), ["doc_id", "stratum"]), labels)
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)]  # whatever they are called
    rows = with_stratum(docs.withColumn("_lang", F.col(f"`{stratum_col}`")).select(*own, "_lang", F.col("text").alias("_whole")), "_lang")
    kept = verdicts(text_counts(rows, [*(f"_own{i}" for i in range(len(own))), "stratum"], "_whole"), cutoffs).filter("kept")
    return kept.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)])


def verdicts(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counts with base_failed, failed_rules and kept; cutoffs (stratum, step) as of `calibrate`."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(_ratio(rule) > F.get(F.lit(ladder(rule)), F.col("_step")), F.lit(rule)) for rule in RULES]))
    used = cutoffs.select(F.col("stratum").alias("_of"), F.col("step").alias("_step"))
    both = counts.join(used, F.col("stratum") == F.col("_of"), "left").withColumn("base_failed", base).withColumn("failed_rules", failed)
    return both.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_of", "_step")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
