"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct n-word shingles (all its words as one, if fewer). Two sets link when
100 * intersection >= PERCENT * union, so the smaller has at least PERCENT / 100 of the larger's size and their symmetric
difference is at most d = (100 - PERCENT) / (100 + PERCENT) of the sum of sizes.

Size bands: a scheme serves pairs whose smaller set lies in its band. Each shingle XORs its hash into one of the scheme's sketch
words, so two sets differ in at most as many words as shingles. Words stand in groups of three, more than d / 2 for the band's
largest d: by the pigeonhole principle linked sets have a group with at most one word that differs, and the join keys are the
three pairs of words of each group. Sets enter their own band's scheme, and the band's below if a partner may be there, with as many groups as their own size asks for.
Groups beyond that bound (the slack) let most sets leave out the pairs that no shingle went into, which unlike texts share.
A second sketch of single bits,
each toggled by shingles, gives a Hamming distance that bounds the symmetric difference from below. It has BITS bits, doubled until they are twice the set's
size, so it also tells large sets apart; a longer one folds by XOR onto a shorter one's length.

Keys held by one document only are cut off by an aggregate; of the others every holder meets the least holder (a star, never
all pairs), which is settled on Hamming distance, then on the sets of the whole texts. Components grow by alternating stars.

Keys whose holders are then still in several components: the holders are grouped by the lead that they have met, and the sketches of a group compared across
components, in cells of two blocks of about NEAR_CELL rows, in one vectorised pass each. Pairs within the bound are verified on the whole texts, in two rounds:
first stars that cover them, then whatever is still in different components. No link is lost, and no pair comes out that the sketch rules out.

Connected documents are compared in full: equal sets fold into classes, and as every link lies within a component, all classes of
each component are compared by their differences from a common set C (X ^ Y = (X ^ C) ^ (Y ^ C); with the shingles that most have as C they are
short), in cells of two blocks of about CELL classes, whose intersections are products of incidence matrices. Only counts of links come out, or pairs of classes if asked for. Groups of more than SPREAD rows are dealt
out in parts, each with a copy of what they are held against.

Defined cases: null and empty texts have empty sets and link with nothing; a null doc_id links with nothing and has no component; rows
that repeat a doc_id are one vertex; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, components
from ._text import LOWER, SOLID, U64, blocks, gram_hash, list_array, mix, prefix, read, span_hash, spans, to_long

PERCENT, WORDS, BITS = 85, 4, 2048
#: Rows of a group that are dealt out together, and texts that make a group's reference set.
SPREAD, SAMPLE = 1000, 15
#: Rows of a block of sketches; rows and elements (in all) of a block of differences, and elements compared at once.
NEAR_CELL, CELL, CELL_SIZE, COLUMNS = 1024, 768, 1 << 20, 1 << 13
#: Parts, equal by the keys' remainders, in which holders of keys meet one after the other: a shuffle of keys is as large as its part.
PASSES = 2
#: Sizes in a band grow by about (100 / PERCENT) ** BAND.
BAND = 1.5


@lru_cache(4)
def bands(percent: int) -> list[int]:
    """Least sizes of the bands, up to any length of text."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * (100 / percent) ** BAND)))
    return out


def _most(lo_hi: int, percent: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set has at most lo_hi."""
    return (100 - percent) * (lo_hi + lo_hi * 100 // percent) // (100 + percent)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = LOWER[data]
    s, e, wb = spans(SOLID[low], offs)
    h = span_hash(prefix(low), s, e)
    g = gram_hash(h, words)
    for a, b in zip(wb[:-1].tolist(), wb[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(g[a : b - words + 1])
        else:
            yield gram_hash(h[a:b], b - a, seed=b - a) if b > a else np.zeros(0, U64)


@lru_cache(4096)
def scheme(band: int, percent: int) -> tuple[int, int]:
    """(groups of sketch words, slack) of a band. Keys that no shingle went into tell nothing and would be held by all kinds of
    texts, so a set sends them only if more than `slack` of its groups have one. Linked sets have `slack` + 1 groups at
    least that agree in a key: in one of them the key is no empty one, or both sets have so many that they send them.

    The slack is for sets from the middle of the band, 1.5 deviations above what they have: few sets send empty keys."""
    edges = bands(percent)
    least = _most(edges[band + 1] - 1, percent) // 2 + 1
    groups = least
    while groups <= 1.5 * least + 1:
        bare = groups * min(1.0, 3 * exp(-2 * (edges[band] * edges[band + 1]) ** 0.5 / (3 * groups)))
        slack = ceil(bare + 1.5 * bare**0.5)
        if least + slack <= groups:
            return groups, slack
        groups = least + slack
    return least, 0


def sketch_keys(x: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of each scheme that the set takes part in.

    A set differs from any partner it may have there by at most `most` shingles, so in at most most // 2 groups it has no key in common with it: of the
    scheme's groups, which are enough for all of the band, it sends the first that are enough for itself. Two linked sets have a key in common
    in the groups that both send."""
    edges, n = bands(percent), len(x)
    own = int(np.searchsorted(edges, n, "right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0 or (band < own and n * percent > 100 * (edges[own] - 1)):
            continue
        # The partner has at most n * 100 / percent, in the band below less than the own band's least.
        most = _most(n, percent) if band == own else (100 - percent) * (n + edges[own] - 1) // (100 + percent)
        if most == 0:  # only equal sets link
            if band == own:
                out.append(np.array([set_sums(x)[0]], U64))
            continue
        groups, slack = scheme(band, percent)
        words = np.zeros(3 * groups, U64)
        salted = mix(x + U64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = (salted % U64(3 * groups)).astype(np.int64)
        np.bitwise_xor.at(words, at, mix(salted ^ U64(0x5851F42D4C957F2D)))
        sent = most // 2 + 1 + slack
        words, count = words.reshape(-1, 3)[:sent], np.bincount(at, minlength=3 * groups).reshape(-1, 3)[:sent]
        place = np.arange(sent, dtype=U64) * U64(4) + U64(band << 48)
        keys = np.stack([mix(words[:, i] + mix(words[:, j] + mix(place + U64(i + j)))) for i, j in ((0, 1), (0, 2), (1, 2))], 1)
        bare = np.stack([count[:, i] + count[:, j] == 0 for i, j in ((0, 1), (0, 2), (1, 2))], 1)
        out.append(keys.ravel() if bare.any(1).sum() > slack else keys[~bare])
    return np.concatenate(out)


def set_sums(x: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that equal sets share."""
    return mix(x ^ U64(0x9E6C63D0876A9A35)).sum(dtype=U64), mix(x ^ U64(0xC2B2AE3D27D4EB4F)).sum(dtype=U64)


def bit_sketch(x: np.ndarray) -> np.ndarray:
    """Words of the parity sketch of a set: the first power of two of bits that is BITS and twice the set's size at least."""
    n = max(BITS, 1 << (2 * len(x) - 1).bit_length()) // 64 if len(x) else BITS // 64
    at, words = mix(x ^ U64(0x2545F4914F6CDD1D)), np.zeros(n, U64)
    np.bitwise_xor.at(words, (at >> U64(6) & U64(n - 1)).astype(np.int64), U64(1) << (at & U64(63)))
    return words


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, th, n, s1, s2, bits, keys) for each row; th tells texts apart, s1 and s2 sets; bits are the words of the parity sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(1)):
                n, keys, bits, sums = [], [], [], np.zeros((2, b - a), U64)
                for row, x in enumerate(shingle_sets(data, offs, words)):
                    n.append(len(x))
                    keys.append(sketch_keys(x, percent) if len(x) else x)
                    sums[:, row] = set_sums(x)
                    bits.append(bit_sketch(x))
                flat = pa.array(to_long(np.concatenate(keys) if keys else np.zeros(0, U64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(to_long(x)) for x in sums), list_array(np.array([len(w) for w in bits]), pa.array(to_long(np.concatenate(bits) if bits else np.zeros(0, U64)))), list_array(np.array([len(k) for k in keys]), flat)],
                    names=["doc_id", "th", "n", "s1", "s2", "bits", "keys"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(work, f"doc_id {kind}, th long, n long, s1 long, s2 long, bits array<long>, keys array<long>")


def _folded(p: Column, n: Column) -> Column:
    """The sketch p on n words, of which it has a multiple."""
    parts = F.sequence(F.lit(1), (F.size(p) / n).cast("int") - 1)
    return F.when(F.size(p) > n, F.aggregate(parts, F.slice(p, F.lit(1), n), lambda s, k: F.zip_with(s, F.slice(p, k * n + 1, n), lambda x, y: x.bitwiseXOR(y)))).otherwise(p)


def _near(a: Column, b: Column, p: Column, q: Column, percent: int) -> Column:
    """Sizes and Hamming distance that a linked pair may have."""
    n = F.least(F.size(p), F.size(q))
    apart = F.aggregate(F.zip_with(_folded(p, n), _folded(q, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return F.when(sizes, apart * (100 + percent) <= (100 - percent) * (a + b)).otherwise(False)


def _spread(groups: DataFrame, n: int = SPREAD) -> DataFrame:
    """groups (g, id, ...) with salts, into how many parts the group is dealt, and salt, the row's part."""
    hot = groups.groupBy("g").agg(F.count("*").alias("_m")).filter(F.col("_m") > n).select(F.col("g").alias("_g"), F.ceil(F.col("_m") / n).cast("int").alias("_s"))
    out = groups.join(hot, F.col("g") == F.col("_g"), "left").withColumn("salts", F.coalesce("_s", F.lit(1)))
    return out.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("_g", "_s")


def _leads(rows: DataFrame) -> DataFrame:
    """(g, salt) once for each part of each group of _spread."""
    return rows.groupBy("g").agg(F.max("salts").alias("salts")).select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))


def against(rows: DataFrame, refs: DataFrame, keep: list[str], words: int, percent: int, most: int = 0) -> DataFrame:
    """Rows (g, salt, text, *keep) of _spread groups, each with its set's difference from the group's reference set.

    refs (g, salt, text): the texts that make the reference, for each part of a group. With most = 0 a row is held against each of them and (*keep) comes
    back if it links with one. Else the reference is the set of the shingles that more than half of refs' texts have, or of the
    group's own first `most` texts where refs has none; (*keep, n, elems) comes back: the size and the difference."""
    out = [(c, dict(rows.dtypes)[c]) for c in keep]
    named = [F.col(c) for c in ("g", "salt")]
    flagged = refs.select(*named, F.lit(0).alias("flag"), "text", *[F.lit(None).cast(k).alias(f"k_{c}") for c, k in out])
    both = flagged.unionByName(rows.select(*named, F.lit(1).alias("flag"), "text", *[F.col(c).alias(f"k_{c}") for c in keep]))
    names = [c for c, _ in out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, given, waiting, ref = None, [], [], None

        def told(some: list[tuple[pa.RecordBatch, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal ref
            if not some:
                return
            if most == 0:
                far = lambda x, y: (100 + percent) * (len(x) + len(y) - 2 * (i := len(np.intersect1d(x, y, assume_unique=True)))) > (100 - percent) * (len(x) + len(y)) or i == 0
                some = [w for w in some if not all(far(w[2], y) for y in given)]
                extra = []
            else:
                if ref is None:
                    ref = majority(given or [x for _, _, x in some[:most]])
                elems = [np.setxor1d(x, ref, assume_unique=True) for _, _, x in some]
                extra = [pa.array([len(x) for _, _, x in some], pa.int64()), list_array(np.array([len(x) for x in elems]), pa.array(to_long(np.concatenate(elems))))]
            if some:
                yield pa.RecordBatch.from_arrays([*pa.Table.from_batches([b.slice(i, 1) for b, i, _ in some]).select([f"k_{c}" for c in names]).combine_chunks().to_batches()[0].columns, *extra], names=[*names, *(["n", "elems"] if most else [])])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                keys = zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True)
                for i, ((g, salt, flag), x) in enumerate(zip(keys, _sets(rows.column(3), words), strict=True)):
                    if (g, salt) != group:
                        yield from told(waiting)
                        group, given, waiting, ref = (g, salt), [], [], None
                    if not len(x):
                        continue  # empty sets link with nothing
                    if flag == 0:
                        given.append(x)
                    else:
                        waiting.append((rows, i, x))
                        if len(waiting) >= max(most, 64):
                            yield from told(waiting)
                            waiting = []
        yield from told(waiting)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "g", "salt").sortWithinPartitions("g", "salt", "flag")
    return dealt.mapInArrow(work, ", ".join([*(f"{c} {k}" for c, k in out), *(["n long", "elems array<long>"] if most else [])]))


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """What more than half of the sets have."""
    x, n = np.unique(np.concatenate(sets), return_counts=True)
    return x[2 * n > len(sets)]


def linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int, table: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose sets link: by the sketches of table if given, then by the whole texts. Many a may meet one b, which is then dealt out with copies of b."""
    some = _spread(pairs.select(F.col("a").alias("id"), F.col("b").alias("g")))
    if table is not None:
        brief = lambda side: table.select(F.col("doc_id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))
        leads = _leads(some).join(brief("b"), F.col("g") == F.col("b_id")).select(F.col("g").alias("b_g"), F.col("salt").alias("b_salt"), "b_n", "b_bits")
        some = some.join(brief("a"), F.col("id") == F.col("a_id")).drop("a_id").join(leads, (F.col("g") == F.col("b_g")) & (F.col("salt") == F.col("b_salt")))
        some = some.filter(_near(F.col("a_n"), F.col("b_n"), F.col("a_bits"), F.col("b_bits"), percent)).select("g", "id", "salts", "salt").distinct()
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    whole = some.join(texts, F.col("id") == F.col("_id")).select("g", "salt", "text", F.col("id").alias("a"), F.col("g").alias("b"))
    refs = _leads(some).join(texts, F.col("g") == F.col("_id")).select("g", "salt", "text")
    return against(whole, refs, ["a", "b"], words, percent).distinct()


def differences(groups: DataFrame, texts: DataFrame, on: Column, keep: list[str], words: int, percent: int) -> DataFrame:
    """(*keep, n, elems) for groups (g, id, ...) joined with texts; see `against`. Groups in several parts share a reference of SAMPLE of their texts."""
    whole = _spread(groups).join(texts, on)
    first = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id"), "id"))
    some = _spread(groups).filter("salts > 1").withColumn("_n", first).filter(F.col("_n") <= SAMPLE).join(texts, on)
    refs = some.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "text")
    return against(whole, refs, keep, words, percent, SAMPLE)


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    return [x for _, _, data, offs in blocks(column) for x in shingle_sets(data, offs, words)]


def duplicate_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: connectivity only, without the links."""
    scratch = Scratch(docs.sparkSession)
    table, out = _connected(scratch, docs.select("doc_id", "text"), words, percent)
    scratch.drop(table)
    return out.select("doc_id", "n_shingles", "component_id")


def _connected(scratch: Scratch, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The table of sketches without keys, and (doc_id, n_shingles, component_id, th, s1, s2) for each row of docs."""
    keyed = scratch.written(sketches(docs, words, percent))
    each = keyed.filter("doc_id IS NOT NULL").select("doc_id", F.explode("keys").alias("key"))
    parts = []
    for k in range(PASSES):
        some = each.filter(F.pmod("key", F.lit(PASSES)) == k)
        leads = scratch.written(some.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).filter("lead <> last").select(F.col("key").alias("k"), "lead"))
        parts.append(scratch.written(some.join(leads, F.col("key") == F.col("k")).filter("doc_id <> lead").select("key", "doc_id", "lead")))
        scratch.drop(leads)
    held = reduce(DataFrame.union, parts)
    table = scratch.written(keyed.drop("keys"))
    scratch.drop(keyed)  # keys take as much room as texts
    stars = held.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    links = scratch.written(linked(stars, docs, words, percent, table))
    for cover in (True, False):
        least = components(scratch, links)
        groups = scratch.written(_unsettled(held, least))
        if groups.isEmpty():
            break
        pairs = scratch.written(_near_pairs(groups, table, percent, cover))  # so cells are gone before texts are shuffled
        old, links = links, scratch.written(links.union(linked(pairs, docs, words, percent)))
        scratch.drop(old, groups, pairs)
    else:
        least = components(scratch, links)
    scratch.drop(*parts)
    out = scratch.written(
        table.select("doc_id", F.col("n").alias("n_shingles"), "th", "s1", "s2").join(least, F.col("doc_id") == F.col("v"), "left")
        .select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "th", "s1", "s2")
    )
    scratch.drop(links)
    return table, out


def _unsettled(held: DataFrame, parts: DataFrame) -> DataFrame:
    """(g, id, part): the holders of keys that are in several components, grouped by the least holder, which has met them all already and isn't among them."""
    named = held.join(parts, F.col("doc_id") == F.col("v"), "left").select("key", F.col("lead").alias("g"), F.col("doc_id").alias("id"), F.coalesce("least", "doc_id").alias("part"))
    split = named.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select(F.col("key").alias("k"))
    return named.join(split, F.col("key") == F.col("k"), "left_semi").select("g", "id", "part").distinct()


def _blocks(rows: DataFrame, total: Column, by: Column, cell: int) -> DataFrame:
    """rows (g, ...) once for each cell (i, j) of two blocks of its group; block: the row's own. A block has about `cell` rows and CELL_SIZE in total."""
    sizes = rows.groupBy(F.col("g").alias("p")).agg(F.count("*").alias("m"), F.sum(total).alias("total")).filter("m > 1")
    sizes = sizes.select("p", F.ceil(F.greatest(F.col("m") / cell, F.col("total") / CELL_SIZE)).cast("int").alias("blocks"))
    rows = rows.join(sizes, F.col("g") == F.col("p")).withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("p", "blocks", "with")


def _dealt(cells: DataFrame) -> DataFrame:
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j")


def _near_pairs(groups: DataFrame, table: DataFrame, percent: int, cover: bool) -> DataFrame:
    """The pairs (a, b) of rows (g, id, part) of one group but different parts that may link by size and Hamming distance.

    If cover, those that a star has: the row with most such partners meets them all, pairs among them wait, and so on. So a
    group in which all link gives as many pairs as rows."""
    brief = table.select(F.col("doc_id").alias("_id"), "n", "bits")
    cells = _blocks(groups.join(brief, F.col("id") == F.col("_id")).drop("_id"), F.size("bits"), F.col("id"), NEAR_CELL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) < 2:  # slices of batches, not rows
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block, n = (np.asarray(rows.column(c)) for c in ("block", "n"))
            part = np.asarray(pc.dictionary_encode(rows.column("part")).indices)
            flat, ends = np.asarray(rows.column("bits").flatten()).view(U64), np.asarray(rows.column("bits").offsets)
            ends = ends - ends[0]
            long = np.diff(ends)
            ok = np.zeros((len(n), len(n)), bool)
            for words in np.unique(long).tolist():  # rows of so many words with those of as many or more
                mine, all_ = np.flatnonzero(long == words), np.flatnonzero(long >= words)
                bits = np.stack([np.bitwise_xor.reduce(flat[ends[r] : ends[r + 1]].reshape(-1, words)) for r in all_])
                step = max(1, 32 * BITS // 64 // words)
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    apart = np.bitwise_count(bits[np.searchsorted(all_, some), None] ^ bits[None]).sum(2, dtype=np.int64)
                    m, k = n[some, None], n[None, all_]
                    good = (100 * np.minimum(m, k) >= percent * np.maximum(m, k)) & ((100 + percent) * apart <= (100 - percent) * (m + k)) & (part[some, None] != part[None, all_])
                    # a cell of two blocks has the pairs across them; those within are another cell's
                    ok[np.ix_(some, all_)] = good & ((block[some, None] != block[None, all_]) | (cell[1] == cell[2]))
            ok |= ok.T
            if cover:
                found = []
                while (degree := ok.sum(1)).any():
                    v = int(degree.argmax())
                    u = np.flatnonzero(ok[v])
                    found.append((np.full(len(u), v), u))
                    ok[v] = ok[:, v] = False
                    ok[np.ix_(u, u)] = False
                a, b = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            else:
                a, b = np.nonzero(np.triu(ok, 1))
            if len(a):
                ids = rows.column("id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            edge = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for p, q in zip(edge, edge[1:], strict=False):
                if p < q and keys[p] != cell:
                    yield from done()
                    cell, held = keys[p], []
                held.append(batch.slice(p, q - p))
        yield from done()

    kind = dict(groups.dtypes)["id"]
    found = _dealt(cells.select("g", "i", "j", "block", "n", "part", "id", "bits")).mapInArrow(work, f"a {kind}, b {kind}")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _class_id(s1: str, s2: str) -> Column:
    return F.format_string("%016x%016x", F.col(s1), F.col(s2))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    elem, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = (times > 1)[at]  # what one set alone has is in no intersection but its own
    out[np.arange(len(sets)), np.arange(len(sets))] = [len(x) for x in sets]
    some, at = np.unique(at[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for first in range(0, len(some), COLUMNS):
        a, b = np.searchsorted(at, (first, first + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, len(some) - first)), np.float32)
        has[owner[a:b], at[a:b] - first] = 1
        both = (has @ has.T).astype(np.int64)
        np.fill_diagonal(both, 0)
        out += both
    return out


def _cells(far: DataFrame, percent: int, name: str | None = None) -> DataFrame:
    """The links within the groups of rows (g, s1, w, n, elems), told by their differences, in cells of two blocks of about CELL rows: the pairs (a, b)
    of the column `name`, or if there is none (g, s1, s2, links), the sums of the partners' w in each cell that has some."""
    own = [name] if name else ["s1", "s2"]
    rows = _blocks(far, F.size("elems") + 1, F.col("s1"), CELL).select("g", "i", "j", "block", "n", "w", "elems", *own)
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            block, n, w = (np.array([h[k] for h in held]) for k in range(3))
            sets = [h[3] for h in held]
            d, both = np.array([len(x) for x in sets]), intersections(sets)
            ok = (100 + percent) * (d[:, None] + d - 2 * both) <= (100 - percent) * (n[:, None] + n)
            # a cell of two blocks has the pairs across them; those within are another cell's
            ok &= ~np.eye(len(held), dtype=bool) & ((block[:, None] != block) | (cell[1] == cell[2]))
            tags = pa.Table.from_batches([h[4] for h in held]).combine_chunks().to_batches()[0]
            if name:
                a, b = (pa.array(x) for x in np.nonzero(np.triu(ok, 1)))
                if len(a):
                    yield pa.RecordBatch.from_arrays([tags.column(name).take(a), tags.column(name).take(b)], names=["a", "b"])
            else:
                sums = ok.astype(np.float64) @ w
                some = pa.array(sums > 0)
                yield pa.RecordBatch.from_arrays([*(tags.column(c).filter(some) for c in ("g", *own)), pa.array(sums[sums > 0].astype(np.int64))], names=["g", *own, "links"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)
            flat, ends = np.asarray(batch.column(6).flatten()).view(U64), np.asarray(batch.column(6).offsets)
            ends = ends - ends[0]
            for row, (g, i, j, block, n, w) in enumerate(keys):
                if (g, i, j) != cell:
                    yield from done()
                    cell, held = (g, i, j), []
                held.append((block, n, w, flat[ends[row] : ends[row + 1]].copy(), batch.slice(row, 1)))
        yield from done()

    what = f"a {kinds[name]}, b {kinds[name]}" if name else f"g {kinds['g']}, s1 long, s2 long, links long"
    return _dealt(rows).mapInArrow(work, what)


def _classes(scratch: Scratch, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members; the classes (g, s1, s2, w) of equal sets in their components, w: how many ids they have; and the
    differences (g, s1, s2, w, n, elems) of those in components of several classes."""
    table, members = _connected(scratch, docs, words, percent)
    scratch.drop(table)
    known = members.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy(F.col("component_id").alias("g"), "s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count_distinct("doc_id").alias("w"))
    classes = scratch.written(classes.select("g", "s1", "s2", "w", F.col("rep.doc_id").alias("id"), F.col("rep.th").alias("h")))
    several = classes.groupBy(F.col("g").alias("of")).count().filter("count > 1")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    on = (F.col("id") == F.col("doc_id")) & (F.col("h") == F.col("th"))
    # A row that stands more than once has one set.
    far = differences(classes.join(several, F.col("g") == F.col("of"), "left_semi"), texts, on, ["g", "s1", "s2", "w"], words, percent)
    return members, classes, scratch.written(far.dropDuplicates(["g", "s1", "s2"]))


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The whole join: (doc_id, n_shingles, class_id, component_id, n_links) for each row of docs. Documents of a class have equal sets and link with each other;
    n_links counts all other documents that link with the row's, in its class and in others. A null class_id links with nothing."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    members, classes, far = _classes(scratch, docs, words, percent)
    others = _cells(far, percent).groupBy("g", "s1", "s2").agg(F.sum("links").alias("more")).withColumnsRenamed({"g": "o_g", "s1": "o1", "s2": "o2"})
    counted = classes.join(others, (F.col("g") == F.col("o_g")) & (F.col("s1") == F.col("o1")) & (F.col("s2") == F.col("o2")), "left")
    # Only sets that link with something: the rest counts 0.
    counted = counted.select(F.col("g").alias("c_g"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("links")).filter("links > 0")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = members.join(counted, (F.col("component_id") == F.col("c_g")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    return out.select("doc_id", "n_shingles", F.when(known, _class_id("s1", "s2")).alias("class_id"), "component_id", F.coalesce(F.when(known, F.col("links")), F.lit(0)).cast("long").alias("n_links"))


def jaccard_pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: the pairs of different classes (see jaccard_links) that link."""
    scratch = Scratch(docs.sparkSession)
    _, _, far = _classes(scratch, docs.select("doc_id", "text"), words, percent)
    found = _cells(far.withColumn("class_id", _class_id("s1", "s2")), percent, "class_id")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, coalesce(any_value(k.n), 0) AS n_links FROM documents d
LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = d.doc_id GROUP BY d.doc_id, n.n
"""
