"""Source divergence: which terms a source uses more than its language, and how far sources of a language lie apart.

A term's smoothed rate is p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)); V terms are kept in a language, N is the sum of their counts. All of it is whole
numbers: rates are divided as decimals, everything after them fits 64 bits.

* Counts: Arrow batches send each (lang, source, term) once a batch; one shuffle by (lang, term) gives sums, document frequencies and postings.
* Terms of a group (lang, source): its postings fall into buckets of like counts; a bucket's largest rate less its smallest language rate bounds every
  difference in it. Buckets are read best-first in SALTS streams a group, and a stream stops when the bounds that are left lie strictly
  below its TOP-th difference (an equal bound may hide an equal difference of a smaller term). The streams' bests meet in one ranking.
* Pairs of sources: if no term occurred, the distance would be V times the difference of the rates of count 0. A source's buckets of equal rates
  add what its own terms change, found by a search in their prefix sums. What remains are terms that both sources have: these come from postings, lists
  of at most about BLOCK sources of a term; two lists of a term give the pairs of a cell of two blocks, summed in the task before
  anything is sent. Every ordered pair is a row of the result, so their number is the result's own.

Defined cases: null text, lang and source are empty texts; every row is a document, repeated ones and those without an id too; a group
without terms has pairs but no terms; a language without kept terms has distances of 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import LOWER, blocks, read, trim

SCALE, PRIOR, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
SALTS = 8
BLOCK = 256
HELD = 1 << 18  # counts that a task holds before it sends them
AT_ONCE = 1 << 20  # pairs in one sum; their values then add up exactly as doubles
#: ASCII letters, here after lower-casing, and all bytes of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) in parts: sums of a term's occurrences and documents over some rows of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: defaultdict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        where: defaultdict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in times.items():
                n, own = len(terms), where[lang, source]
                names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([x], pa.string())).cast(pa.string()) for x in (lang, source)]
                counts = [pa.array(terms.values(), pa.int64()), pa.array((own[t] for t in terms), pa.int64(), size=n)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(terms.keys(), pa.binary()).cast(pa.string()), *counts], names=["lang", "source", "term", "n", "docs"])
            times.clear()
            where.clear()

        for batch in batches:
            groups = list(zip(*(pc.fill_null(batch.column(c), "").to_pylist() for c in (0, 1)), strict=True))
            for first, last, data, offs in blocks(batch.column(2)):
                raw = LOWER[data].tobytes()
                for k in range(last - first):
                    found = Counter(TERM.findall(raw[offs[k] : offs[k + 1]]))
                    if found:
                        times[groups[first + k]].update(found)
                        where[groups[first + k]].update(found.keys())
                if sum(map(len, times.values())) >= HELD:
                    yield from sent()
        yield from sent()
        trim()

    texts = docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return texts.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def rate(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed rate; NULL where no term is kept."""
    over, under = (F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")), (total + PRIOR * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", over, under)).cast("long")


def postings(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, kept, p0) of docs, p0 the rate of count 0; and the postings (lang, source, term, p, q) of kept terms, q the language's rate. Both are written tables."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = term_counts(docs).repartition(n, "lang", "term")  # grouping by source as well moves nothing more
    each = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    each = each.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("all"), F.sum("docs").over(of_term).alias("docs"), (F.min("source").over(of_term) == F.col("source")).alias("lead"))
    counts = scratch.written(each.filter(F.col("docs") >= LEAST_DOCS).drop("docs"))
    langs = counts.groupBy(F.col("lang").alias("of")).agg(F.sum(F.col("lead").cast("long")).alias("kept"), F.sum("n").alias("lang_total"))
    sums = counts.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("total"))
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = there.join(sums, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").join(langs, F.col("lang") == F.col("of"), "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")])
    groups = scratch.written(groups.withColumn("p0", rate(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))
    of = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "total", "kept", "lang_total")
    rated = counts.join(of, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    p, q = rate(F.col("n"), F.col("total"), F.col("kept")), rate(F.col("all"), F.col("lang_total"), F.col("kept"))
    rated = scratch.written(rated.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")))
    scratch.drop(counts)
    return groups.select("lang", "source", "kept", "p0"), rated


# -- terms


def bests(stream: Iterator[tuple[int, np.ndarray, list[bytes]]], top: int) -> tuple[list[tuple[int, bytes]], int]:
    """The top (difference, term) of a stream of buckets (bound, differences, terms) by falling bounds, the differences falling and equal ones by term, and
    how many buckets were read; stops when the next bound lies strictly below the last of them."""
    best: list[tuple[int, bytes]] = []
    n = 0
    for bound, values, terms in stream:
        if len(best) == top and bound < best[-1][0]:
            break
        n += 1
        if len(best) == top:
            some = np.flatnonzero(values >= best[-1][0])
        else:
            some = np.arange(len(values))
        best = sorted([*best, *((int(values[k]), terms[k]) for k in some)], key=lambda x: (-x[0], x[1]))[:top]
    return best, n


def level(n: Column) -> Column:
    """A bucket of counts: each of the small ones, four to a doubling beyond."""
    return F.when(n < 16, n).otherwise(F.floor(4 * F.log2(n.cast("double")))).cast("int")


def outstanding(rated: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the first TOP terms of each group by how much its rate is above its language's."""
    above = rated.filter("p > q").select("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"), level(F.col("n")).alias("level"), "term", "p", "q")
    keys = ["lang", "source", "salt", "level"]
    limits = above.groupBy(*keys).agg((F.max("p") - F.min("q")).alias("bound")).withColumnsRenamed({k: f"_{k}" for k in keys})
    bound = above.join(limits, [F.col(k) == F.col(f"_{k}") for k in keys])
    bound = bound.select("lang", "source", "salt", "bound", "level", (F.col("p") - F.col("q")).alias("value"), "term")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def buckets() -> Iterator[tuple[tuple, int, np.ndarray, list[bytes]]]:
            """(stream, bound, differences, terms); a bucket that ends with a batch may come in two."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
                edge = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
                values, terms = np.asarray(batch.column(5)), batch.column(6).cast(pa.binary())
                for a, b in zip(edge, edge[1:], strict=False):
                    yield keys[a][:3], keys[a][3], values[a:b], terms.slice(a, b - a).to_pylist()

        rest = buckets()
        ahead = next(rest, None)
        while ahead is not None:
            of = ahead[0]

            def stream(of=of):
                nonlocal ahead
                while ahead is not None and ahead[0] == of:
                    now, ahead = ahead, None
                    yield now[1:]
                    ahead = next(rest, None)

            own = stream()
            best, _ = bests(own, TOP)
            own.close()
            while ahead is None or ahead[0] == of:  # what the bounds rule out
                ahead = next(rest, None)
                if ahead is None:
                    break
            yield pa.RecordBatch.from_pydict({"lang": [of[0]] * len(best), "source": [of[1]] * len(best), "item": pa.array([t.decode() for _, t in best], pa.string()), "value": pa.array([v for v, _ in best], pa.int64())})

    n = int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = bound.repartition(n, "lang", "source", "salt").sortWithinPartitions("lang", "source", "salt", F.desc("bound"), "level")
    found = sent.mapInArrow(work, "lang string, source string, item string, value long")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= TOP)


# -- pairs


def alone(groups: DataFrame, rated: DataFrame, n_blocks: int) -> DataFrame:
    """(lang, source, item, value) in parts: the distances if no term were in both sources. Each source's buckets meet the sources of its language in blocks."""
    equal = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("b"))
    own = groups.join(equal, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").select("lang", "source", "kept", "p0", F.col("b.p").alias("p"), F.col("b.m").alias("m"))
    lists = groups.groupBy(F.col("lang").alias("l"), _block(F.col("source"), n_blocks).alias("block")).agg(F.collect_list(F.struct("source", "p0")).alias("t")).select("l", F.col("t.source").alias("items"), F.col("t.p0").alias("zeros"))
    met = own.join(lists, F.col("lang") == F.col("l")).select("lang", "source", "kept", "p0", "p", "m", "items", "zeros")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lang, source, kept, p0, p, m, items, zeros = (batch.column(c)[r].as_py() for c in range(8))
                value = own = np.zeros(len(items), np.int64)
                if kept:
                    x, p, m = np.array(zeros, np.int64), np.array(p or [], np.int64), np.array(m or [], np.int64)
                    count, total = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(p * m)])
                    k = np.searchsorted(p, x)
                    away = np.abs(p0 - x)
                    own = x * (2 * count[k] - count[-1]) + total[-1] - 2 * total[k] - count[-1] * away
                    value = kept * away + own
                ok = np.array([t != source for t in items])
                names, n = pa.array(items, pa.string()).filter(pa.array(ok)), int(ok.sum())
                me = pa.array([source] * n, pa.string())
                for a, b, v in ((me, names, value), (names, me, own)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), a, b, pa.array(v[ok], pa.int64())], names=["lang", "source", "item", "value"])

    return met.mapInArrow(work, "lang string, source string, item string, value long")


def _block(source: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(n_blocks)).cast("int")


def shared_sums(of: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], width: tuple[int, int]) -> np.ndarray:
    """What terms in both sources add to the distances, for each pair of numbers: of has for either side the lists' offsets, numbers, rates and rates of count 0."""
    (oa, ia, pa_, za), (ob, ib, pb, zb) = of
    out = np.zeros(width[0] * width[1], np.int64)
    na, nb = np.diff(oa), np.diff(ob)
    row = 0
    ends = np.cumsum(na * nb)
    while row < len(na):
        to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + AT_ONCE, "right")))
        many = (na * nb)[row:to]
        of_row = np.repeat(np.arange(row, to), many)
        within = np.arange(len(of_row)) - np.repeat(np.cumsum(many) - many, many)
        a, b = oa[of_row] + within // nb[of_row], ob[of_row] + within % nb[of_row]
        value = np.abs(pa_[a] - pb[b]) - np.abs(pa_[a] - zb[b]) - np.abs(za[a] - pb[b]) + np.abs(za[a] - zb[b])
        out += np.bincount(ia[a] * width[1] + ib[b], value, len(out)).astype(np.int64)
        row = to
    return out.reshape(width)


def together(groups: DataFrame, rated: DataFrame, n_blocks: int) -> DataFrame:
    """(lang, source, item, value) in parts: what terms that are in both sources change."""
    zero = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "p0")
    full = rated.join(zero, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    lists = full.groupBy("lang", "term", _block(F.col("source"), n_blocks).alias("block")).agg(F.collect_list(F.struct("source", "p", "p0")).alias("t"))
    a = lists.select("lang", "term", F.col("block").alias("i"), F.col("t").alias("a"))
    b = lists.select(F.col("lang").alias("l"), F.col("term").alias("w"), F.col("block").alias("j"), F.col("t").alias("b"))
    cells = a.join(b, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("w")) & (F.col("i") <= F.col("j")))
    cells = cells.select("lang", "i", "j", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "ab" for f in ("source", "p", "p0")]).sortWithinPartitions("lang", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, sums = None, ({}, {}), np.zeros((0, 0), np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if cell is None:
                return
            x, y = np.nonzero(sums)
            left, right = (np.array(list(n), object) for n in names)
            apart = left[x] != right[y]
            x, y = x[apart], y[apart]
            ways = [(left[x], right[y])] if cell[1] == cell[2] else [(left[x], right[y]), (right[y], left[x])]
            for s, t in ways:
                yield pa.RecordBatch.from_arrays([pa.array([cell[0]] * len(x), pa.string()), pa.array(s, pa.string()), pa.array(t, pa.string()), pa.array(sums[x, y])], names=["lang", "source", "item", "value"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            edge = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for p, q in zip(edge, edge[1:], strict=False):
                if p == q:
                    continue
                if keys[p] != cell:
                    yield from done()
                    cell, names, sums = keys[p], ({}, {}), np.zeros((0, 0), np.int64)
                rows, sides = batch.slice(p, q - p), []
                for side in (0, 1):
                    s, rates, zeros = (rows.column(3 + 3 * side + k) for k in range(3))
                    coded, known = pc.dictionary_encode(s.flatten()), names[side]
                    number = np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
                    offs = np.asarray(s.offsets).astype(np.int64)
                    sides.append((offs - offs[0], number, np.asarray(rates.flatten()), np.asarray(zeros.flatten())))
                width = tuple(map(len, names))
                grown = np.zeros(width, np.int64)
                grown[: sums.shape[0], : sums.shape[1]] = sums
                sums = grown + shared_sums(sides, width)
        yield from done()

    return cells.mapInArrow(work, "lang string, source string, item string, value long")


def distances(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each group's distances to the other sources of its language, the largest first."""
    n_blocks = max(1, -(-groups.count() // BLOCK))
    parts = alone(groups, rated, n_blocks).union(together(groups, rated, n_blocks))
    whole = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` and `term` of docs (lang, source, text)."""
    groups, rated = postings(docs, Scratch(docs.sparkSession))
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", distances(groups, rated)), ("term", outstanding(rated)))]
    return out[0].union(out[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(x.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
sums AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
f AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // CAST(s.total + 5 * v AS HUGEINT) AS p, 1 + (1000000000 * (all_n + 5)) // CAST(l.total + 5 * v AS HUGEINT) AS q FROM c JOIN sums s USING (lang, source) JOIN langs l USING (lang)),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(s.value, 0) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN
 (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
listed AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM listed) WHERE part = 'pair' OR rank <= 50
"""
