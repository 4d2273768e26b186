"""Line dedup: ranges of line hashes, sorted by document and position, streamed for first occurrences.

Only DataFrame functions. A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of
`min_chars` code points or more stand as two 64-bit hashes (the second with its salt first, as Spark chains columns), so texts never move for the comparison.

Two passes keep a hot line from landing in one task. The first deals (key, salt of the document) out by range, sorted by
document and position, and streams each group's first document: what isn't first there is dropped for good. Hashes are uniform, so
the ranges are equal ones of all 64-bit values; none are sampled, which would split and hash every text once more. The second
deals the rest out by key alone, of which a key has the lines of one document for each salt; what the first pass
dropped is scattered. Dropped positions become, per document, a keep bitmap as runs (start, length) of kept lines.

Defined cases: null and empty texts are one empty line, kept. Rows that repeat a doc_id count as one document, and each
row keeps its own bitmap by its text; null doc_ids are one document after all others. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import read

MIN_CHARS = 10
#: `[\x20\x09-\x0D]` at both ends.
ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.regexp_replace(line, ENDS, ""), UPPER, LOW)


def _spread(df: DataFrame, value: Column) -> DataFrame:
    """df with part, the equal range of all longs that the value, a hash, lies in; dealt out by it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright((F.shiftright(value, 32) + F.lit(1 << 31)) * F.lit(n), 32).cast("int")
    return df.withColumn("part", part).repartitionById(n, "part")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, n_lines, pos): lines that a smaller doc_id holds; th tells rows of the same doc_id apart."""
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("lines"))
    keyed = (
        split.select("doc_id", "th", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .withColumn("key", _key(F.col("line"))).filter(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "th", "n_lines", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("th"), F.col("pos")]

    def later(*keys: str) -> Column:
        stream = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ~F.col("doc_id").eqNullSafe(F.first("doc_id").over(stream))

    one = _spread(keyed, F.xxhash64("h1", "salt")).withColumn("out", later("part", "h1", "h2", "salt"))
    two = one.select(
        F.when(F.col("out"), F.xxhash64("doc_id", "th", "pos")).otherwise(F.col("h1")).alias("h1"), "h2", "out", "doc_id", "th", "n_lines", "pos"
    )
    return _spread(two, F.col("h1")).withColumn("late", later("part", "h1", "h2", "out")).filter(F.col("out") | F.col("late")).select("doc_id", "th", "n_lines", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, n_dropped, kept): a row for each text with a line to drop; kept has runs (start, length)."""
    gone = dropped_lines(docs, min_chars).groupBy("doc_id", "th").agg(F.first("n_lines").alias("n"), F.sort_array(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1)), lambda x: x + 1)
    runs = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array("n")), lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return gone.select("doc_id", "th", F.size("p").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("kept"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; a text without a bitmap stays whole. Columns of docs may have any names but those three."""
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)]
    d = docs.select(*own, F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.xxhash64("text").alias("_th"))
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("th").alias("_bth"), F.col("n_dropped").alias("_gone"), F.col("kept").alias("_kept"))
    both = d.join(b, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_bth")), "left").withColumn("_lines", _lines(F.col("_text")))
    kept = F.flatten(F.transform("_kept", lambda r: F.slice("_lines", r["start"] + 1, r["length"])))
    return both.select(
        *[F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)], F.size("_lines").cast("long").alias("n_lines"), F.coalesce("_gone", F.lit(0)).alias("n_dropped"),
        F.when(F.col("_kept").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: What follows `documents` in the pipeline's SQL too; {docs} is the table.
SQL = """
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs}),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS least FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.least AS gone FROM keyed k LEFT JOIN firsts f USING (key)),
deduped AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
"""
ORACLE = "WITH " + SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped"
