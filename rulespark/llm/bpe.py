"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words.

Texts are cut into chunks of about CHUNK bytes, each split once into words (matches of the split pattern) and written, in a table
bucketed by chunk, as its list of distinct words and its texts as places in that list. The lists are gathered by word over all
partitions, so a word is folded once, however many chunks have it (once for every 2 ** FAR_BITS partitions: that bounds the
list of the chunks that have a common word). The fold is a Spark expression: a word's bytes become token numbers, and `aggregate` merges, again and
again, the adjacent pair of the least rank, which it finds in a map of pairs to ranks (from the rank file, so its size doesn't
grow with the texts). The map comes as JSON beside each row of words, from a broadcast: as a literal it would be in every form and text of the plan, which
the driver makes and keeps. Words of more than LONG bytes, for which a fold is too slow, are merged in the same order by a heap. Numbers go back to the chunks as places and numbers, without the words; the texts stay where their buckets are.
Decoding puts the pieces of the numbers, from a literal table, one after another; `encode` does so on request in the same pass.
Folded words are written before they go back, so every task has one Python worker: several of them beside a full heap are what an executor's memory is short of.

Chunks are numbered once, when they are written; a word that has no numbers when texts and words meet fails the task.
Defined cases: null and empty texts have no tokens; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import blocks, read, trim

CHUNK, PLAN_TEXT = 16 << 20, 1 << 16
#: A place in a chunk's list (a chunk has no more words than bytes, but for one text longer than CHUNK: 2 ** 31 at most), chunks in a partition.
PLACE_BITS, CHUNK_BITS, FAR_BITS = 31, 12, 12
PLACE = (1 << PLACE_BITS) - 1
#: Places of words that are packed at once on their way back, and places of texts whose numbers are looked up at once.
HELD, AT_ONCE = 1 << 18, 1 << 18
#: zstandard's level for the table of chunks, which is what takes most room.
LEVEL = 9
#: Row groups of folded words: Spark's reader holds a whole one.
GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
#: Words that are folded in one row; the fold is quadratic in a word's length, so longer ones than LONG bytes are merged by a heap.
MANY, LONG = 1 << 15, 1024
#: Bits of a number and of a rank, so vocabularies have fewer than NONE pieces; a word's place takes what is left.
ID_BITS, RANK_AT, BUCKET_BITS, STEP = 18, 45, 16, 262_147
ID = NONE = (1 << ID_BITS) - 1


@lru_cache(2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _literal(path: str) -> str:
    """JSON of the rank map: pairs (as low and high part of a number) and their ranks in buckets, and the bytes' numbers."""
    ranks = ranks_of(path)
    if max(ranks.values()) >= NONE:
        raise ValueError(f"ranks of {NONE} and more don't fit")
    keys, values = ([[] for _ in range(1 << BUCKET_BITS)] for _ in range(2))
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                at = (a * STEP + b) & (1 << BUCKET_BITS) - 1
                keys[at].append((a * STEP + b) >> BUCKET_BITS)
                values[at].append(rank)
    return json.dumps({"k": keys, "v": values, "s": [ranks[bytes([i])] for i in range(256)]}, separators=(",", ":"))


def folded(words: Column, ranks: Column) -> Column:
    """The token numbers of each of the words (arrays of bytes): array<array<int>>; ranks: the JSON of `_literal`.

    A word's state is an array of longs, one for each piece: the rank of its pair with the next piece, its place and its number. The least
    one is the pair of the least rank, the leftmost if there are several. The map is parsed once for an array of words."""
    table = F.from_json(ranks, "k array<array<int>>, v array<array<int>>, s array<int>")

    def bind(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def fold(m: Column, word: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            def found(key: Column) -> Column:
                at = key.bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")
                place = F.array_position(F.get(m["k"], at), F.shiftright(key, BUCKET_BITS).cast("int"))
                return F.coalesce(F.get(F.get(m["v"], at), place.cast("int") - 1), F.lit(NONE))

            return F.shiftleft(bind(a * STEP + b, found).cast("long"), RANK_AT)

        def merge(state: Column, _) -> Column:
            def at(least: Column) -> Column:
                def cut(k: Column) -> Column:
                    new, own = F.shiftright(least, RANK_AT), least.bitwiseAND(((1 << RANK_AT) - 1) ^ ID)
                    after = F.when(k + 1 < F.size(state), rank(new, F.element_at(state, k + 2).bitwiseAND(ID))).otherwise(F.lit(NONE << RANK_AT))
                    merged = after + own + new
                    before = bind(F.element_at(state, k - 1), lambda e: rank(e.bitwiseAND(ID), new) + e.bitwiseAND((1 << RANK_AT) - 1))
                    rest = F.slice(state, k + 2, F.size(state))
                    return F.when(k > 1, F.concat(F.slice(state, F.lit(1), F.greatest(k - 2, F.lit(0))), F.array(before, merged), rest)).otherwise(F.concat(F.array(merged), rest))

                return F.when(least >= NONE << RANK_AT, state).otherwise(bind(F.array_position(state, least).cast("int"), cut))

            return bind(F.array_min(state), at)

        first = bind(
            F.transform(word, lambda b: F.get(m["s"], b.cast("int")).cast("long")),
            lambda ids: F.transform(ids, lambda x, i: F.when(i + 1 < F.size(ids), rank(x, F.get(ids, i + 1))).otherwise(F.lit(NONE << RANK_AT)) + F.shiftleft(i.cast("long"), ID_BITS) + x),
        )
        return F.aggregate(F.slice(word, F.lit(1), F.greatest(F.size(word) - 1, F.lit(0))), first, merge, lambda s: F.transform(s, lambda x: x.bitwiseAND(ID).cast("int")))

    return bind(table, lambda m: F.transform(words, lambda w: fold(m, w)))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token numbers of one very long word, by a heap of pairs."""
    start, after, before = list(range(len(word))), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    end = [i + 1 for i in start]
    pair = lambda i: ranks.get(word[i : end[after[i]]]) if after[i] < len(word) else None
    heap = [(r, i, i + 2) for i in start if (r := pair(i)) is not None]
    heapq.heapify(heap)
    gone = bytearray(len(word))
    while heap:
        _, i, stop = heapq.heappop(heap)
        if gone[i] or after[i] >= len(word) or end[after[i]] != stop:
            continue
        j = after[i]
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in start if not gone[i]]


def _planes(x: np.ndarray) -> bytes:
    """int32 values with their lowest bytes first, then the next ones: far smaller when compressed."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _ranked(counts: np.ndarray) -> np.ndarray:
    """Places of words that occur so often: the most frequent first, words as frequent as each other in the order given."""
    places = np.empty(len(counts), np.int32)
    places[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    return places


def _one(array: pa.Array) -> pa.Array:
    """A list of one row that holds the array."""
    return pa.LargeListArray.from_arrays(pa.array([0, len(array)], pa.int64()), array)


def chunked(rows: DataFrame, pattern: str) -> DataFrame:
    """(chunk, words, texts) for each chunk of rows (doc_id, text): its distinct words, sorted, with their counts, and its texts as
    places of words. A word's place follows from the counts, frequent words first, so that most places are small numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        n = TaskContext.get().partitionId() << CHUNK_BITS
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(1), CHUNK):
                places: dict[str, int] = defaultdict(count().__next__)
                found = []
                for text in batch.column(1).slice(a, b - a):
                    found.append(np.fromiter(map(places.__getitem__, split.findall(text.as_py())), np.int32))
                at = np.concatenate(found)
                words = pa.array(list(places), pa.string())
                order = np.asarray(pc.sort_indices(words))  # neighbours have much in common, so they take less room here and in the shuffle
                counts = np.bincount(at, minlength=len(words))[order]
                ranks = np.empty(len(words), np.int32)
                ranks[order] = _ranked(counts)
                sizes = np.array([len(x) for x in found])
                texts = pa.RecordBatch.from_arrays([_one(batch.column(0).slice(a, b - a)), pa.array([_planes(sizes)]), pa.array([_planes(ranks[at])])], names=["docs", "sizes", "places"])
                words = pa.RecordBatch.from_arrays([_one(words.take(pa.array(order))), pa.array([_planes(counts)])], names=["words", "counts"])
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([_packed(words)]), pa.array([_packed(texts)])], names=["chunk", "words", "texts"])
                del places, found, at, words, order, counts, ranks, sizes, texts
                trim()
                n += 1
                if not n & (1 << CHUNK_BITS) - 1:
                    raise OverflowError("a partition has too many chunks: read it in smaller ones")

    return rows.mapInArrow(work, "chunk long, words binary, texts binary")


def distinct_words(chunks: DataFrame) -> DataFrame:
    """(word, far, at): every different word once for FAR partitions of texts; at: chunk << PLACE_BITS | place, for each chunk that has it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = _unpacked(blob.as_py())
                words, at = row.column(0).flatten(), _ranked(_values(row.column(1)[0].as_py())) + (np.int64(chunk) << PLACE_BITS)
                for i in range(0, len(words), 50_000):
                    yield pa.RecordBatch.from_arrays([words.slice(i, 50_000), pa.array(at[i : i + 50_000])], names=["word", "at"])

    each = chunks.select("chunk", "words").mapInArrow(work, "word string, at long")
    # A chunk has a word once, so nothing can be gathered before the shuffle.
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.withColumn("far", F.shiftright("at", PLACE_BITS + CHUNK_BITS + FAR_BITS)).repartition(n, "word", "far")
    return dealt.groupBy("word", "far").agg(F.collect_list("at").alias("at"))


def in_rows(words: DataFrame, path: str) -> DataFrame:
    """(words, long, at, ranks): up to MANY of the distinct words in a row, as bytes; those of over LONG bytes in `long`, where others are null; ranks: the JSON of `_literal`."""
    ranks = words.sparkSession.sparkContext.broadcast(_literal(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            word = table.column(0)
            long = pc.greater(pc.binary_length(word), LONG)
            short = pc.if_else(long, pa.scalar(b"", pa.binary()), word)
            offsets = np.frombuffer(short.buffers()[1], np.int32)[short.offset : short.offset + len(short) + 1]
            data = np.frombuffer(short.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            bytes_ = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(data.astype(np.int16)))
            only = pc.if_else(long, word, pa.scalar(None, pa.binary()))
            whole = [pa.ListArray.from_arrays(pa.array([0, len(word)], pa.int32()), x) for x in (bytes_, only, table.column(1))]
            return pa.RecordBatch.from_arrays([*whole, pa.array([ranks.value])], names=["words", "long", "at", "ranks"])

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= MANY:
                yield row(held)
                held, n = [], 0
        if n:
            yield row(held)

    return words.select(F.encode("word", "UTF-8").alias("word"), "at").mapInArrow(work, "words array<array<smallint>>, long array<binary>, at array<array<long>>, ranks string")


def by_chunk(known: DataFrame, path: str) -> DataFrame:
    """(chunk, n, blob) from rows (ids, long, at) of many words: numbers of words gathered for the chunks that have them; n words in a blob."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def done() -> pa.RecordBatch:
            at, size = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            first = np.cumsum(size) - size
            ids = np.concatenate([x[2] for x in held])
            order = np.argsort(at)
            at, size, first = at[order], size[order], first[order]
            chunk = at >> PLACE_BITS
            edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            blobs = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)], strict=True):
                some = size[a:b]
                take = np.arange(some.sum()) + np.repeat(first[a:b] - (np.cumsum(some) - some), some)
                blobs.append(pack(_planes(np.diff(at[a:b] & PLACE, prepend=0)) + _planes(some) + _planes(ids[take])))
            return pa.RecordBatch.from_arrays([pa.array(chunk[edge]), pa.array(np.diff(np.append(edge, len(at)))), pa.array(blobs, pa.binary())], names=["chunk", "n", "blob"])

        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            ids, long, at = (batch.column(i).flatten() for i in range(3))
            if len(long) > long.null_count:
                ids = pa.array([x if w is None else merged(w, ranks_of(path)) for x, w in zip(ids.to_pylist(), long.to_pylist(), strict=True)], ids.type)
            sizes, times = (np.diff(np.asarray(x.offsets)) for x in (ids, at))
            # A word's numbers stand once for each chunk that has it.
            flat, many = np.asarray(ids.flatten()), np.repeat(sizes, times)
            start = np.repeat(np.cumsum(sizes) - sizes, times)
            held.append((np.asarray(at.flatten()), many, flat[np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield done()
                held = []
        if sum(len(x[0]) for x in held):
            yield done()
        held = []
        trim()

    return known.select("ids", "long", "at").mapInArrow(work, "chunk long, n long, blob binary")


def _encoded(texts: pa.Table, known: pa.Table, at_once: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids of the texts of one chunk, and their token numbers, about at_once words (one text at least) at a time."""
    open_ = zstandard.ZstdDecompressor().decompress
    size, parts = np.zeros(0, np.int32), []
    for n, blob in zip(known.column("n").to_pylist(), known.column("blob"), strict=True):
        raw = open_(blob.as_py())
        at, some, ids = np.cumsum(_values(raw[: 4 * n])), _values(raw[4 * n : 8 * n]), _values(raw[8 * n :])
        parts.append((at, some, ids))
    if parts:
        size = np.full(max(int(at.max()) for at, _, _ in parts) + 1, -1, np.int32)
        for at, some, _ in parts:
            size[at] = some
    first, flat, base = np.zeros(len(size), np.int64), np.concatenate([np.zeros(0, np.int32), *(x for _, _, x in parts)]), 0
    for at, some, ids in parts:
        first[at], base = base + np.cumsum(some) - some, base + len(ids)
    row = _unpacked(texts.column("texts")[0].as_py())
    docs, (lengths, places) = row.column(0).flatten(), (_values(row.column(i)[0].as_buffer()) for i in (1, 2))
    del row
    if len(places) and (int(places.max()) >= len(size) or (size < 0).any()):
        raise ValueError("a word of the chunk has no numbers")
    edges, a = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + at_once, "right")) - 1)
        some = places[edges[a] : edges[b]]
        many = size[some]
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        values = flat[np.arange(ends[-1]) + np.repeat(first[some] - ends[:-1], many)]
        offsets = ends[edges[a : b + 1] - edges[a]]
        yield docs.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))
        a = b


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for each row, if asked for with decoded as of `decode`; path: a file of ranks in base64."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    if spark.conf.get("spark.sql.maxPlanStringLength").startswith("214748"):  # the default; the driver keeps a text of every plan
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    scratch = Scratch(spark)
    chunks = scratch.bucketed(chunked(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), pattern), "chunk")
    words = scratch.written(in_rows(distinct_words(chunks), path).select(folded(F.col("words"), F.col("ranks")).alias("ids"), "long", "at"), **GROUPS)
    known, pieces = by_chunk(words, path), _shared_pieces(spark, path) if decoded else None

    def joined(texts: pa.Table, known: pa.Table) -> pa.Table:
        trim()
        table = pa.array(pieces.value, pa.binary()) if decoded else None
        return pa.Table.from_batches(
            [pa.RecordBatch.from_arrays([*x, *([_pieces_of(x[1], table)] if decoded else [])], names=["doc_id", "ids", "decoded"][: 2 + decoded]) for x in _encoded(texts, known, AT_ONCE)]
        )

    return chunks.select("chunk", "texts").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(joined, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def _shared_pieces(spark: SparkSession, path: str):
    """A broadcast list of the piece of each number."""
    ranks = ranks_of(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return spark.sparkContext.broadcast(pieces)


def _pieces_of(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The pieces of each row's numbers, one after another."""
    some = pc.take(table, ids.flatten())
    ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
    offs = np.asarray(ids.offsets)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends[offs - offs[0]])), some.buffers()[2]])


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with decoded (binary), the pieces of ids one after another."""
    shared = _shared_pieces(tokens.sparkSession, path)
    at = tokens.columns.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _pieces_of(batch.column(at), table)], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(work, ", ".join([*(f"`{c}` {k}" for c, k in tokens.dtypes), "decoded binary"]))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
