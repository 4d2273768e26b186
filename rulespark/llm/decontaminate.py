"""Benchmark decontamination by winnowing.

Both sides keep, of each WINDOW consecutive k-gram hashes, the least (all of them when tied). A shared span of
k + WINDOW - 1 = 10 words holds one whole such window, so it has a kept hash in common wherever it stands: no shared span
is missed. Kept hashes of documents that may be in the benchmark (a Bloom filter of BLOOM_BITS bits, whatever the
benchmark's size) meet the benchmark's by a join on the hash; a hit carries the words around it, and is extended
to both sides word by word, which also settles hash collisions. Items of fewer than ten words are one window each, looked up
by the hash of all their words at each length that occurs (nine lengths at most).

Defined cases: null and empty texts have no words and no hits; a null item_id or an item without words matches nothing; rows
that repeat a doc_id each give a row; repeated items count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import ALNUM, LOWER, U64, blocks, gram_hash, list_array, mix, prefix, read, span_hash, spans, to_long

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: 1 MB, whatever the input; a fuller filter lets more through to the join and loses nothing.
BLOOM_BITS = 1 << 23
MAX = U64((1 << 64) - 1)
SEEDS = "array<struct<fp:long,size:int,pos:int,left:array<string>,body:array<string>,right:array<string>>>"


def _winnow(grams: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions of the least hashes; last: how many windows may begin before each text's end, per word, as a mask."""
    n = len(grams)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    least = grams[: n - WINDOW + 1].copy()
    for i in range(1, WINDOW):
        np.minimum(least, grams[i : n - WINDOW + 1 + i], out=least)
    valid = last[: len(least)]
    kept = np.zeros(n, bool)
    for i in range(WINDOW):
        kept[i : i + len(least)] |= valid & (grams[i : i + len(least)] == least)
    return np.flatnonzero(kept)


def _seeds(data: np.ndarray, offs: np.ndarray, short: list[int], bloom: np.ndarray | None, exact: bool) -> tuple[np.ndarray, pa.Array]:
    """Words of each text and its seeds. exact: a text's own short form (an item); else all short windows (a document)."""
    low = LOWER[data]
    s, e, wb = spans(ALNUM[low], offs)
    n_words = wb[1:] - wb[:-1]
    h = span_hash(prefix(low), s, e)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    left_in = wb[1:][text_of] - np.arange(len(s)) if len(s) else np.zeros(0, np.int64)  # words from here to the text's end
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    g = gram_hash(h, K)
    at = _winnow(g, left_in >= SPAN)
    found.append((at, g[at], K))
    for m in range(1, SPAN) if exact else short:
        g = gram_hash(h, m, seed=m)
        ok = left_in[: len(g)] >= m
        if exact:
            ok = ok & (n_words[text_of[: len(g)]] == m)
        at = np.flatnonzero(ok)
        found.append((at, g[at], m if m != K else -K))
    at = np.concatenate([x[0] for x in found])
    fp = np.concatenate([x[1] for x in found])
    size = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in found])
    if bloom is not None:
        hit = np.ones(len(fp), bool)
        for bit in _bits(fp):
            hit &= (bloom[bit >> U64(6)] >> (bit & U64(63))) & U64(1) == 1
        at, fp, size = at[hit], fp[hit], size[hit]
    order = np.argsort(at, kind="stable")
    at, fp, size = at[order], fp[order], size[order]
    raw = low.tobytes()
    word = lambda i: raw[s[i] : e[i]].decode("utf-8", "replace")
    rows = []
    for p, f, z in zip(at.tolist(), to_long(fp).tolist(), size.tolist(), strict=True):
        t = text_of[p]
        a, b, k = int(wb[t]), int(wb[t + 1]), abs(z)
        lo, hi = (max(a, p - WINDOW + 1), min(b, p + k + WINDOW - 1)) if z == K else (p, p + k)
        rows.append({"fp": f, "size": z, "pos": p - a, "left": [word(i) for i in range(p - 1, lo - 1, -1)], "body": [word(i) for i in range(p, p + k)], "right": [word(i) for i in range(p + k, hi)]})
    kind = pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("left", pa.list_(pa.string())), ("body", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
    return n_words, list_array(np.bincount(text_of[at], minlength=len(n_words)) if len(at) else np.zeros(len(n_words), np.int64), pa.array(rows, kind))


def _bits(fp: np.ndarray) -> list[np.ndarray]:
    return [(mix(fp + U64(i * 0x632BE59BD9B4E019 & (1 << 64) - 1))) & U64(BLOOM_BITS - 1) for i in range(1, 4)]


def fingerprints(texts: DataFrame, id_col: str, text_col: str, short: list[int] = (), bloom: bytes | None = None, exact: bool = False) -> DataFrame:
    """(id, n_words, seeds) for each row."""
    short = list(short)
    shared = texts.sparkSession.sparkContext.broadcast(bloom) if bloom is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, U64) if shared is not None else None
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(1)):
                n_words, seeds = _seeds(data, offs, short, bits, exact)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words), seeds], names=[id_col, "n_words", "seeds"])

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_words long, seeds {SEEDS}")


def _bloom(fps: DataFrame) -> bytes:
    """The filter: one row for each word of it that isn't 0 comes to the driver, BLOOM_BITS / 64 at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(U64)
            bit = np.concatenate(_bits(fp))
            yield pa.RecordBatch.from_arrays([pa.array(to_long(bit >> U64(6))), pa.array(to_long(U64(1) << (bit & U64(63))))], names=["at", "bits"])

    out = np.zeros(BLOOM_BITS // 64, U64)
    got = fps.mapInArrow(work, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[np.asarray(got["at"])] = np.asarray(got["bits"]).view(U64)
    return out.tobytes()


def _agree(a: Column, b: Column) -> Column:
    """How many words agree from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of docs; items: sorted ids, as strings, of the items with occurring windows."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL").distinct()
    tests = (
        fingerprints(items, "item_id", "text", exact=True).select("item_id", F.explode("seeds").alias("s"))
        .select("item_id", *[F.col(f"s.{c}").alias(f"b_{c}") for c in ("fp", "size", "left", "body", "right")]).distinct()
    )
    sizes = [r[0] for r in tests.select("b_size").distinct().collect()]
    short = sorted({abs(z) for z in sizes if z != K})
    bloom = _bloom(tests.select("b_fp").distinct())
    # A document without seeds goes on under a key of its own, so no key is common to all of them.
    seeds = fingerprints(docs, "doc_id", "text", short, bloom).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "seeds")
    each = seeds.select("row", "doc_id", "n_words", F.explode_outer("seeds").alias("s")).select(
        "row", "doc_id", "n_words", "s.*", F.coalesce("s.fp", F.xxhash64("row")).alias("key"), F.coalesce("s.size", F.lit(0)).alias("z")
    )
    left, right = _agree(F.col("left"), F.col("b_left")), _agree(F.col("right"), F.col("b_right"))
    long = F.col("z") == K
    real = (F.col("body") == F.col("b_body")) & (~long | (left + right + K >= SPAN))
    hits = (
        each.join(tests, (F.col("key") == F.col("b_fp")) & (F.col("z") == F.col("b_size")), "left")
        .withColumn("hit", F.when(real, F.struct(F.when(long, F.col("pos") - left).otherwise(F.col("pos")).alias("a"), (F.col("pos") + F.abs("z") + F.when(long, right).otherwise(0)).alias("b"))))
    )
    by_doc = hits.groupBy("row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_set("hit")).alias("spans"), F.sort_array(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("item_id")))).alias("items")
    )
    total = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["to"], x["a"]))).alias("n"), F.greatest(acc["to"], x["b"]).alias("to")),
        lambda acc: acc["n"].cast("long"),
    )
    return by_doc.select("doc_id", "n_words", total.alias("n_hit"), "items")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, len(g) AS m, array_to_string(g, ' ') AS g FROM (SELECT item_id, w[i:i + least(len(w), 10) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT m FROM win),
dg AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM dg JOIN win USING (m, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
"""
ORACLE = "WITH " + SQL.format(docs="documents") + """
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
