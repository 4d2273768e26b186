"""Suffix-array dedup: repeated SPAN-byte strings, found by merging Burrows-Wheeler transforms of shards.

Only text that may repeat is sorted. The least hash of the K-byte strings within each SPAN-byte string is its key: equal strings have equal
keys. Keys that one document has alone are cut off in one shuffle of keys (then the keys that are left go back to their documents); for the
others the maximal runs of starts with one key are cut out as pieces of SPAN to 2 * SPAN bytes. Equal pieces become one, with its
least document; what is left, the different pieces of each key, is where suffixes are sorted (but for pieces of which no string has a hash
that another document's have).

A task's pieces form shards by document. Each shard has its suffix array and Burrows-Wheeler transform. The transforms are merged by
refining their interleave: a stable distribution of the interleaved symbols orders the suffixes of all shards by one more
symbol, without comparing any again; the positions where groups part in round h are those with a common prefix of h - 1. After SPAN rounds the
groups are the intervals of suffixes with SPAN bytes in common, and a start is a repeat if its group has a smaller document.

Strings are judged on the input; bytes covered by repeats go, and matches never cross documents. Defined cases: null and empty texts
have no bytes; a null doc_id comes after all others; rows that repeat a doc_id are one document to each other, each with its own
result; other columns are ignored. Keys and the equality of pieces are told by hashes of 48 and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import U64, blocks, list_array, mix, prefix, read, span_hash, to_long, _powers

SPAN, K, SHARDS = 50, 24, 4
#: Bytes of pieces that are sorted at once, in whole keys.
GROUP = 1 << 18
LAST = (1 << 63) - 1
#: Keys that are sorted at once before they are shuffled; kinds of rows then.
HELD = 1 << 21
SINGLE, WITNESS, SURE = 0, 1, 2


def start_keys(data: np.ndarray) -> np.ndarray:
    """The least K-byte hash (48 bits) within the SPAN bytes from each place."""
    n = len(data) - K + 1
    if len(data) < SPAN:
        return np.zeros(0, U64)
    c = prefix(data)
    m = mix((c[K:] - c[:n]) * _powers(max(10, int(len(data)).bit_length()))[1][:n]) >> U64(16)
    width, have = SPAN - K + 1, 1
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


def _per_text(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, its first byte, keys of its starts) from one pass over the block; keys across texts fall away."""
    keys = start_keys(data)
    for i, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
        yield i, a, keys[a : max(a, b - SPAN + 1)]


def shared_keys(docs: DataFrame) -> DataFrame:
    """(d, shared): for each doc the keys of its starts that other docs have too.

    Keys are shuffled once. What several docs of a stretch of about HELD keys have is known to be shared: their rows need no group, and one witness
    (the least and the largest of them) stands for all, so a key of very many docs is a few rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
            keys, doc = keys[new], doc[new]
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(edge, len(keys)))
            sure, many = np.repeat(size > 1, size), edge[size > 1]
            k, d = keys.view(np.int64), doc
            groups = [k[~sure], k[many], to_long(mix(keys[sure] ^ mix(doc[sure].view(U64))))]
            of = [d[~sure], d[many], d[sure]]
            more = [np.zeros(int((~sure).sum()), np.int64), d[many + size[size > 1] - 1], k[sure]]
            kind = np.repeat(np.array([SINGLE, WITNESS, SURE], np.int8), [len(x) for x in groups])
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (groups, of, more)), pa.array(kind)], names=["g", "doc", "more", "kind"])

        keys, doc, n = [], [], 0
        for batch in batches:
            for a, _, data, offs in blocks(batch.column(1)):
                for i, _, x in _per_text(data, offs):
                    if len(x):
                        x = np.unique(x[np.concatenate([[True], x[1:] != x[:-1]])])
                        keys.append(x)
                        doc.append(np.full(len(x), batch.column(0)[a + i].as_py(), np.int64))
                        n += len(x)
                if n >= HELD:
                    yield told(np.concatenate(keys), np.concatenate(doc))
                    keys, doc, n = [], [], 0
        if n:
            yield told(np.concatenate(keys), np.concatenate(doc))

    w = Window.partitionBy("g")
    each = docs.select("doc", "text").mapInArrow(work, "g long, doc long, more long, kind byte")
    each = each.select("*", F.min("doc").over(w).alias("lo"), F.max(F.when(F.col("kind") == WITNESS, F.col("more")).otherwise(F.col("doc"))).over(w).alias("hi"))
    each = each.filter((F.col("kind") == SURE) | ((F.col("kind") == SINGLE) & (F.col("lo") != F.col("hi"))))
    return each.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.when(F.col("kind") == SURE, F.col("more")).otherwise(F.col("g"))).alias("shared"))


def pieces(docs: DataFrame) -> DataFrame:
    """(key, body, doc, th, at) of the runs of starts whose key is in the row's `shared`; at: the first start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = {n: i for i, n in enumerate(batch.schema.names)}
            shared = batch.column(names["shared"])
            flat, ends = np.asarray(shared.flatten()).view(U64), np.asarray(shared.offsets) - shared.offsets[0].as_py()
            for lo, hi, data, offs in blocks(batch.column(names["text"])):
                raw = data.tobytes()
                out_key, body, row, at = [], [], [], []
                for i, base, keys in _per_text(data, offs):
                    if not len(keys):
                        continue
                    turn = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    stop = np.append(turn[1:], len(keys))
                    keep = np.isin(keys[turn], flat[ends[lo + i] : ends[lo + i + 1]])
                    for p, q in zip(turn[keep].tolist(), stop[keep].tolist(), strict=True):
                        for s in range(p, q, SPAN):
                            e = min(q, s + SPAN)
                            out_key.append(int(keys[p]))
                            body.append(raw[base + s : base + e + SPAN - 1])
                            row.append(lo + i)
                            at.append(s)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(body, pa.binary()), batch.column(names["doc"]).take(rows), batch.column(names["th"]).take(rows), pa.array(at, pa.int32())], names=["key", "body", "doc", "th", "at"])

    return docs.select("doc", "th", "text", "shared").mapInArrow(work, "key long, body binary, doc long, th long, at int")


def suffix_array(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes of strings laid one after another, sorted up to their string's end (end[i]: where i's string ends), ties by place."""
    n, place = len(text), np.arange(len(text))
    rank, width = text.astype(np.int64) + 1, 1
    for step in (1, 2):  # four symbols at once, then seven
        rank = rank * (1 << 8 * step) + np.where(place + step < end, rank[np.minimum(place + step, n - 1)], 0)
    width, both = 7, rank << 24 | np.where(place + 4 < end, rank[np.minimum(place + 4, n - 1)], 0) >> 8
    longest = int((end - place).max(initial=1))
    while True:
        order = np.argsort(both)
        s = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
        if width >= longest or rank.max(initial=0) == n:
            return order if rank.max(initial=0) == n else np.argsort(rank * n + place)
        both = rank << 32 | np.where(place + width < end, rank[np.minimum(place + width, n - 1)], 0)
        width *= 2


class Shard:
    """Pieces, their suffix array and transform. Each piece ends in a symbol 0, smaller for earlier pieces."""

    def __init__(self, bodies: list[bytes]):
        self.size = np.array([len(b) for b in bodies])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        text = np.frombuffer(b"".join(bodies), np.uint8)
        piece = np.repeat(np.arange(len(bodies)), self.size)
        sa = suffix_array(text, self.first[1:][piece])
        lead = np.concatenate([np.zeros(1, np.uint8), text[:-1] + np.uint8(1)])
        lead[self.first[:-1]] = 0
        # The ends come first, by piece; before an end stands its piece's last symbol.
        self.symbols = np.concatenate([text[self.first[1:] - 1] + np.uint8(1), lead[sa]])  # UTF-8 has no byte 255
        self.piece = np.concatenate([np.arange(len(bodies)), piece[sa]])
        self.start = np.concatenate([self.size, sa - self.first[:-1][piece[sa]]])


def merged_groups(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes of all shards, by number (shards one after another, each in its own order), in the order of their first
    `rounds` symbols, and the number of the group with those in common."""
    symbols = np.concatenate([s.symbols for s in shards])
    n = len(symbols)
    origin = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.symbols) for s in shards])
    interleave, group = origin, np.zeros(n, np.int32)
    counts = np.bincount(origin, minlength=len(shards))
    edges = np.concatenate([[0], np.cumsum(counts)])
    take = np.arange(n, dtype=np.int32)
    for _ in range(rounds):
        here = symbols[take]
        to = np.argsort(here, kind="stable")
        interleave = interleave[to]
        here, was = here[to], group[to]
        apart = np.concatenate([[False], (here[1:] != here[:-1]) | (was[1:] != was[:-1]) | (here[1:] == 0)])
        group = np.cumsum(apart, dtype=np.int32)
        # Each shard's suffixes keep their own order, so the interleave alone says which stands where.
        for s in range(len(shards)):
            take[interleave == s] = np.arange(edges[s], edges[s + 1], dtype=np.int32)
    return take, group


def repeated_starts(bodies: list[bytes], docs: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each piece the starts, ascending, whose `span` bytes also stand in a piece of a smaller document."""
    shard_of = mix(docs.astype(U64)) % U64(SHARDS)
    members = [m for m in (np.flatnonzero(shard_of == s) for s in range(SHARDS)) if len(m)]
    shards = [Shard([bodies[i] for i in m]) for m in members]
    take, group = merged_groups(shards, span)
    piece = np.concatenate([m[s.piece] for m, s in zip(members, shards, strict=True)])[take]
    start = np.concatenate([s.start for s in shards])[take]
    whole = start + span <= np.array([len(b) for b in bodies])[piece]
    piece, start, group = piece[whole], start[whole], group[whole]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(docs[piece], edge), np.diff(np.append(edge, len(group)))) if len(group) else docs[:0]
    again = least < docs[piece]
    piece, start = piece[again], start[again]
    order = np.lexsort((start, piece))
    return np.split(start[order], np.searchsorted(piece[order], np.arange(1, len(bodies))))


def may_repeat(bodies: list[bytes], docs: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Whether a piece has a string of `span` bytes whose hash pieces of other documents have too; the others needn't be sorted."""
    size = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    windows = np.maximum(size - span + 1, 0)
    piece = np.repeat(np.arange(len(bodies)), windows)
    start = np.repeat(np.cumsum(size) - size, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    out = np.zeros(len(bodies), bool)
    if len(start):
        h = span_hash(prefix(data), start, start + span)
        order = np.argsort(h)
        h, of = h[order], docs[piece[order]]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        apart = np.minimum.reduceat(of, edge) < np.maximum.reduceat(of, edge)
        out[piece[order][np.repeat(apart, np.diff(np.append(edge, len(h))))]] = True
    return out


def repeats(unique: DataFrame) -> DataFrame:
    """(h1, h2, lead, starts) from (key, body, lead); starts that repeat a smaller document's string in another piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            # A key with one piece only needs no sorting.
            keys = np.array([r[0] for r in rows])
            some = np.flatnonzero(np.isin(keys, keys[1:][keys[1:] == keys[:-1]])) if len(keys) > 1 else np.zeros(0, np.int64)
            some = some[may_repeat([rows[i][1] for i in some], np.array([rows[i][2] for i in some]))] if len(some) else some
            starts: list = [[]] * len(rows)
            if len(some):
                for i, x in zip(some.tolist(), repeated_starts([rows[i][1] for i in some], np.array([rows[i][2] for i in some])), strict=True):
                    starts[i] = x.tolist()
            return pa.RecordBatch.from_arrays([pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(starts, pa.list_(pa.int32()))], names=["h1", "h2", "lead", "starts"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= GROUP and row[0] != last:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[1]), row[0]
        if held:
            yield done(held)

    n = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = unique.repartition(n, "key").sortWithinPartitions("key")
    return dealt.select("key", "body", "lead", *_two_hashes()).mapInArrow(work, "h1 long, h2 long, lead long, starts array<int>")


def _two_hashes():
    return F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("second"), "body").alias("h2")


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, th, ranges): for each text with repeats the maximal runs (a, b) of bytes to remove, from (doc, th, text)."""
    shared = scratch.written(shared_keys(docs))
    cut = scratch.written(pieces(docs.join(shared, F.col("doc") == F.col("d")).select("doc", "th", "text", "shared")))
    scratch.drop(shared)
    found = scratch.written(repeats(cut.groupBy("key", "body").agg(F.min("doc").alias("lead"))))
    # Every start of a piece that a smaller document has whole; of a piece of its least document, those found above.
    mine = found.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "lead", F.transform("starts", lambda s: F.struct(s.alias("a"), (s + SPAN).alias("b"))).alias("some"))
    rows = cut.select("doc", "th", "at", F.octet_length("body").alias("size"), *_two_hashes()).join(mine, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")))
    all_of = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    ranges = rows.withColumn("own", F.when(F.col("doc") > F.col("lead"), all_of).otherwise(F.col("some")))
    ranges = ranges.select("doc", "th", F.explode(F.transform("own", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"]).alias("b")))).alias("r"))
    out = scratch.written(ranges.groupBy("doc", "th").agg(F.sort_array(F.collect_set("r")).alias("ranges")).withColumnsRenamed({"doc": "d", "th": "h"}))
    scratch.drop(cut, found)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; kept: the bytes that stay."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    out = repeated_ranges(own.select("doc", "th", "text"), scratch)
    both = own.join(out, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "ranges")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                size.append(len(text))
                if not ranges.is_valid:
                    gone.append(0), runs.append(0), kept.append(text)
                    continue
                a, b = (np.asarray(ranges.values.field(f)) for f in ("a", "b"))
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, a, 1)
                np.add.at(change, b, -1)
                mask = np.cumsum(change[:-1]) > 0
                gone.append(int(mask.sum()))
                runs.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0)
                kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
