"""N-gram Jaccard join (6) by vertical partitioning.

All distinct word n-grams (of three words, or of `words`) stand in one global order: rare ones by hash, then the frequent ones by frequency.
Pivots on the hash cut both parts of the order into even fragments; a document's set falls into one segment
per fragment.

1. Documents with equal sets form a class; classes are joined from here on.
2. Two classes that link share a gram in both their prefixes (the first n - ceil(t n) + 1 grams of the order),
   and at their first shared gram the grams passed over, the set sizes and the sizes of their 16 segments
   (overlap <= sum of the smaller ones) allow the overlap that is needed. The overlap of the two prefixes
   bounds it again: of the prefix that ends first, every gram that the other lacks is lost.
   Sizes are told first, by bands: a prefix gram travels only if another class of a size that may link has it too.
3. For what is left, each fragment counts its partial overlap separately, by an intersection of two
   segments; the partial counts are summed per pair and decide exactly.

Candidates come in two rounds, so that a crowd of near copies does not give all its pairs: first every class
meets the most central class of each of its prefix grams, then the others. At a gram of more than `CROWD`
classes, only pairs that are not yet connected meet, one side of which is outside the largest component
there. They meet by blocks of classes, small ones first, and what a block connects does not meet the next one; a class
that did not link with a fair draw of the crowd links with few of the rest. Parity maps (one bit per place of a gram's
hash, turned by each gram) tell before that how many grams two sets have apart at least, so a class that links with nothing gives
few pairs. This changes the work, not the result. Nothing is capped: each linked pair is either
verified or already connected, so components are exact. Components are found by alternating star
contraction of the links, each round of which is written to the shared folder.

The list of frequent grams only orders the grams (any order is correct); it holds at most `MOST_FREQUENT`
grams, found by counting within tasks. Grams and sets are compared by 64-bit hashes.

Edge cases: null text and text without words has no set, links with nothing and is its own component; with
fewer words than a gram has the sequence is the only gram; a null id counts after all others as the name of a
component; texts of any length give their whole set, a slice at a time; repeated rows fall into one class; an empty table gives an empty result; other columns pass
through. Working columns start with `__nj_`.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.llm.registry import query, table
from plumbline.llm.shared import small_batches, stored
from plumbline.llm.tokens import NOT_SPACE, hash_spans, mix64, slices, word_spans

PERCENT, WORDS = 90, 3
MOST_FREQUENT = 1 << 20
FRAGMENTS, HALVES = 16, 32
#: Segment sizes are packed into four numbers of 16 bits each; sets of more grams are not bounded by them.
PACKED = ["s0", "s1", "s2", "s3"]
#: The same for the halves of the fragments, compared where a crowd meets.
FINE = [f"f{k}" for k in range(8)]
CROWD = 32
#: A set's parity map of 64 bits a column; the larger a set, the less it tells (nothing beyond about 2,300 grams at 80 percent).
PARITY = [f"q{k}" for k in range(16)]
#: Classes of a crowd in the first block (about), and how many times all blocks before it the next one has.
BLOCK, GROWTH = 256, 8
#: Grams of a task that are counted together, and how often one must come to be reported.
CHUNK, LOCAL = 1 << 19, 2
#: Bits of the map that tells tasks which rows may be candidates' representatives.
MAP_BITS = 26
#: Bands of set sizes, one bit of a long each; a gram's place on a map moves by its band, in the map's highest bits.
BANDS = 64
BAND_SHIFT = MAP_BITS - 6

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def factor(k: int) -> np.uint64:
    """What the hash of a gram's word number k is multiplied by."""
    return _C[k] if k < len(_C) else mix64(np.array([k], np.uint64))[0] | np.uint64(1)


def gram_sets(data: np.ndarray, rows: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of the grams of so many words of each text."""
    starts, stops, first = word_spans(data, rows, NOT_SPACE)
    h = hash_spans(data, starts, stops)
    with np.errstate(over="ignore"):
        grams = mix64(sum(h[k : len(h) - words + 1 + k] * factor(k) for k in range(words))) if len(h) >= words else h[:0]
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                g = np.sort(grams[a : b - words + 1])
                keep = np.ones(len(g), bool)
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                out.append(g[keep])
            elif b > a:
                out.append(mix64(sum(h[a + k : a + k + 1] * factor(k) for k in range(b - a)) + np.uint64(b - a)))
            else:
                out.append(h[:0])
    return out


def class_keys(flat: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number per set, from the sum of its spread hashes and its size."""
    first = np.concatenate([[0], np.cumsum(n)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(flat ^ _C[2]))]) if len(flat) else np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        return mix64((sums[first[1:]] - sums[first[:-1]]) + n.astype(np.uint64) * _C[0]).view(np.int64)


class Order:
    """Ranks of the frequent grams, rarest first."""

    def __init__(self, by_rank: np.ndarray):
        self.sorted = np.sort(by_rank)
        self.rank = np.argsort(by_rank, kind="stable") if len(by_rank) else by_rank
        self.low = np.zeros(1 << 22, bool)
        self.low[(by_rank & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        """Rank of each gram, -1 for a rare one."""
        out = np.full(len(grams), -1)
        at = np.flatnonzero(self.low[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(at) and len(self.sorted):
            k = np.minimum(np.searchsorted(self.sorted, grams[at]), len(self.sorted) - 1)
            out[at] = np.where(self.sorted[k] == grams[at], self.rank[k], -1)
        return out


def fragment(grams: np.ndarray) -> np.ndarray:
    """The fragment of each gram."""
    return (grams >> np.uint64(60)).astype(np.int64)


def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def parity_maps(flat: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
    """One map of bits per set, 64 bits a column: whether an odd number of its grams has the place."""
    bits = 64 * len(PARITY)
    place = own * bits + (flat & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(rows, -1)


def frequent_grams(text: str, words: int):
    """For mapInArrow: grams that come often within a chunk of a task's texts, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0

        def flush():
            grams, n = np.unique(np.concatenate(have), return_counts=True)
            often = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["gram", "n"])

        for batch in batches:
            for _, _, data, rows in slices(batch.column(text)):
                sets = gram_sets(data, rows, words)
                have += sets
                size += sum(map(len, sets))
                if size > CHUNK:
                    yield flush()
                    have, size = [], 0
        if have:
            yield flush()

    return run


def describe(text: str, carried: list[str], order, percent: int, words: int):
    """For mapInArrow: each text's class key, set size, segment sizes, parity map and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Order(order.value)
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(text)):
                sets = gram_sets(data, rows, words)
                n = np.array([len(s) for s in sets], np.int64)
                flat, own = np.concatenate(sets), np.repeat(np.arange(hi - lo), n)
                ranks = ranked.ranks(flat)
                packed = lambda many, of: np.bincount(own * many + of, minlength=(hi - lo) * many).astype(np.uint16).view(np.int64).reshape(-1, many // 4)
                sizes = np.concatenate([packed(FRAGMENTS, fragment(flat)), packed(HALVES, (flat >> np.uint64(59)).astype(np.int64)), parity_maps(flat, own, hi - lo)], 1)
                wanted = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                first = np.concatenate([[0], np.cumsum(n)])
                prefixes = []
                for r, want in enumerate(wanted.tolist()):
                    a, b = first[r], first[r + 1]
                    often = ranks[a:b] >= 0
                    rare = flat[a:b][~often][:want]
                    if len(rare) < want:
                        late = flat[a:b][often]
                        rare = np.concatenate([rare, late[np.argsort(ranks[a:b][often])][: want - len(rare)]])
                    prefixes.append(rare)
                keys = pa.array(class_keys(flat, own, n), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in carried), keys, pa.array(n), *(pa.array(sizes[:, k].copy()) for k in range(sizes.shape[1])), lists(np.concatenate(prefixes).view(np.int64), wanted)],
                    [*carried, "__nj_c", "n_shingles", *PACKED, *FINE, *PARITY, "__nj_prefix"],
                )

    return run


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys are on the map."""
    place = (keys & ((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def on_map(key: str, bits):
    """For mapInArrow: the rows whose key is on the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = bits.value
        for batch in batches:
            yield batch.filter(pa.array(marked(on, batch.column(key).to_numpy())))

    return run


def bands_of(n: str, percent: int) -> Column:
    """The band of a set's size. Sizes that may link are of one band or of two that follow each other; bands BANDS
    apart count as one, which only lets more meet."""
    width = math.log(100 / min(percent, 99)) * (1 + 1e-6)  # a bit more, so that rounding parts no two sizes
    return (F.floor(F.log(F.col(n).cast("double")) / width) % BANDS).cast("int")


def meeting_bands(k: str, seen: str) -> Column:
    """Of the bands (bits) of a gram's k classes, those where a class may meet another one. With as many bands as classes
    each has one to itself, and meets what is in the next ones; else any band may hold two."""
    col, bits = F.col(seen), BANDS - 1
    # the neighbours of the last band are the one before it and the first one
    up = F.shiftleft(col, 1).bitwiseOR(F.shiftrightunsigned(col, bits))
    down = F.shiftrightunsigned(col, 1).bitwiseOR(F.shiftleft(col, bits))
    return F.when(F.col(k) > F.bit_count(seen), col).otherwise(col.bitwiseAND(up.bitwiseOR(down)))


def shared_prefixes(grams_map, rows_map):
    """For mapInArrow over the rows that are on one map: a row per prefix gram that is on the other at the row's band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, chosen = grams_map.value, rows_map.value
        for batch in batches:
            batch = pa.RecordBatch.from_struct_array(batch.filter(pa.array(marked(chosen, batch.column("__nj_u").to_numpy()))).to_struct_array())
            lists_, n = batch.column("__nj_prefix"), batch.column("n_shingles").to_numpy()
            bands = batch.column("__nj_band").to_numpy().astype(np.int64)
            grams, first = lists_.values.to_numpy(), lists_.offsets.to_numpy().astype(np.int64)
            own = np.repeat(np.arange(batch.num_rows), np.diff(first))
            place = np.arange(first[0], first[-1]) - first[:-1][own]
            grams = grams[first[0] : first[-1]]
            at = np.flatnonzero(marked(on, grams ^ (bands[own] << BAND_SHIFT)))
            yield pa.RecordBatch.from_arrays([pa.array(grams[at]), pa.array(place[at].astype(np.int32)), batch.column("__nj_c").take(pa.array(own[at])), pa.array(n[own[at]]), *(batch.column(c).take(pa.array(own[at])) for c in PACKED)], ["g", "p", "c", "n", *PACKED])

    return run


def segments(text: str, bits, words: int):
    """For mapInArrow: the segments of the sets whose row is on the map, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, done = bits.value, set()
        for batch in batches:
            chosen = batch.filter(pa.array(marked(on, batch.column("__nj_r").to_numpy())))
            for lo, hi, data, rows in slices(chosen.column(text)):
                sets = gram_sets(data, rows, words)
                n = np.array([len(s) for s in sets], np.int64)
                keys = class_keys(np.concatenate(sets), np.repeat(np.arange(hi - lo), n), n)
                fresh = [r for r, k in enumerate(keys.tolist()) if n[r] and not (k in done or done.add(k))]
                if not fresh:
                    continue
                flat, own = np.concatenate([sets[r] for r in fresh]), np.repeat(np.arange(len(fresh)), n[fresh])
                cell = own * FRAGMENTS + fragment(flat)  # in order already: a set is sorted by hash
                group, sizes = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[fresh][group // FRAGMENTS]), pa.array((group % FRAGMENTS).astype(np.int32)), lists(flat.view(np.int64), sizes)], ["c", "f", "grams"])

    return run


def map_place(column: str) -> Column:
    """Where a hashed key stands on a map; Spark's buckets count from 1."""
    return F.col(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1


def map_parts(keys: DataFrame, column: str) -> DataFrame:
    """A map of 2^MAP_BITS bits (8 MB) of hashed keys as rows (b, m) of 4,096 bytes, 2,048 at most."""
    place = keys.select(map_place(column).alias("p"))
    return place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """The map put together."""
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for b, m in map_parts(keys, column).collect():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b), root the smallest node connected: alternating stars."""
    tidy = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(tidy(edges)), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(tidy(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stored(tidy(small))
    leaves = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rooted(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """df with its nodes in a column replaced by their roots, where they have one."""
    found = roots.select(F.col("node").alias(column), F.col("root").alias("__nj_to"))
    return df.join(found, column, "left").withColumn(column, F.coalesce("__nj_to", column)).select(df.columns)


def block_of(c: str, k: str) -> Column:
    """The block of a class among the k classes of a crowd: a fair draw of BLOCK of them, then of GROWTH times as many in all, and so on."""
    place = F.pmod(F.xxhash64(c), F.lit(1 << 40)).cast("double") * F.col(k) / (float(1 << 40) * BLOCK)
    return F.when(place < 1, 0).otherwise(F.floor(F.log(place) / math.log(GROWTH)) + 1).cast("int")


class Join:
    """One run of the join over docs; percent is the least Jaccard similarity of their grams of so many words."""

    def __init__(self, docs: DataFrame, key: str, text: str, percent: int, words: int):
        spark, self.percent, self.words = docs.sparkSession, percent, words
        small_batches(spark)
        self.texts = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("__nj_r"), F.col(text).alias("__nj_text"))
        often = self.texts.select("__nj_text").mapInArrow(frequent_grams("__nj_text", words), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        often = stored(often)
        least = F.sum("k").over(Window.orderBy(F.desc("n")))  # one row per count up to 1,000, fewer than a thousand rows
        sizes = often.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count(F.lit(1)).alias("k"))
        enough = sizes.withColumn("upto", least).filter(F.col("upto") <= MOST_FREQUENT).agg(F.min("n")).first()[0]
        top = often.filter(F.col("n") >= (1 << 62 if enough is None else enough)).toArrow()
        grams, n = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
        order = spark.sparkContext.broadcast(grams[np.lexsort((grams, n))])
        slim = docs.select(F.col(key).alias("__nj_id"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("__nj_r"), F.col(text).alias("__nj_text"))
        kinds = {f.name: f.dataType for f in slim.schema}
        schema = T.StructType([T.StructField("__nj_id", kinds["__nj_id"]), T.StructField("__nj_r", T.LongType()), T.StructField("__nj_c", T.LongType()), T.StructField("n_shingles", T.LongType()), *(T.StructField(c, T.LongType()) for c in (*PACKED, *FINE, *PARITY)), T.StructField("__nj_prefix", T.ArrayType(T.LongType()))])
        #: One row per document; all that the join needs but the sets of candidates. `__nj_u` tells repeated rows apart.
        self.rows = stored(slim.mapInArrow(describe("__nj_text", ["__nj_id", "__nj_r"], order, percent, words), schema).withColumn("__nj_u", F.xxhash64(F.monotonically_increasing_id())))
        order.destroy()  # what was cut reads files from here on

    def fits(self, nx, ny, px, py) -> Column:
        """Set sizes and grams passed over allow a link."""
        s, p = F.col(nx) + F.col(ny), self.percent
        return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * p) & ((F.col(px) + F.col(py)) * (100 + p) <= s * (100 - p))

    def segments_fit(self, nx, ny, x: str, y: str, packed: list[str] = PACKED) -> Column:
        """The sizes of the segments, packed columns with a suffix each, allow a link."""
        part = lambda c, k: F.shiftright(F.col(c), 16 * k).bitwiseAND(0xFFFF)
        most = sum((F.least(part(c + x, k), part(c + y, k)) for c in packed for k in range(4)), F.lit(0))
        return (F.greatest(nx, ny) > 0xFFFF) | (most * (100 + self.percent) >= (F.col(nx) + F.col(ny)) * self.percent)

    def parities_fit(self, nx, ny, x: str, y: str) -> Column:
        """Grams that only one of two sets has, as many as their parity maps tell at least, allow a link."""
        apart = sum((F.bit_count(F.col(q + x).bitwiseXOR(F.col(q + y))) for q in PARITY), F.lit(0))
        return apart * (100 + self.percent) <= (F.col(nx) + F.col(ny)) * (100 - self.percent)

    def prefixes_fit(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y, nx, ny) whose prefixes share enough."""
        pairs = stored(pairs)
        ends = pairs.select(F.col("x").alias("__nj_c")).union(pairs.select(F.col("y").alias("__nj_c"))).distinct()
        first = self.rows.select("__nj_c", "__nj_r").join(ends, "__nj_c", "left_semi").groupBy("__nj_c").agg(F.min("__nj_r").alias("__nj_r"))
        bits = pairs.sparkSession.sparkContext.broadcast(bitmap(first, "__nj_r"))
        found = self.rows.select("__nj_r", "__nj_c", "__nj_prefix").mapInArrow(on_map("__nj_r", bits), "__nj_r long, __nj_c long, __nj_prefix array<long>")
        prefix = stored(found.join(ends, "__nj_c", "left_semi").dropDuplicates(["__nj_c"]))
        bits.destroy()
        side = lambda c, g: prefix.select(F.col("__nj_c").alias(c), F.col("__nj_prefix").alias(g))
        both = pairs.join(side("x", "gx"), "x").join(side("y", "gy"), "y")
        kept = F.greatest(F.col("nx") - F.size("gx"), F.col("ny") - F.size("gy")) + F.size(F.array_intersect("gx", "gy"))
        return both.filter(kept * (100 + self.percent) >= (F.col("nx") + F.col("ny")) * self.percent).select("x", "y", "nx", "ny")

    def verified(self, candidates: DataFrame) -> DataFrame:
        """The candidates (x, y, nx, ny) that link, by partial overlaps summed over the fragments."""
        pairs = stored(self.prefixes_fit(candidates))
        ends = pairs.select(F.col("x").alias("__nj_c")).union(pairs.select(F.col("y").alias("__nj_c"))).distinct()
        first = self.rows.select("__nj_c", "__nj_r").join(ends, "__nj_c", "left_semi").groupBy("__nj_c").agg(F.min("__nj_r").alias("__nj_r"))
        bits = pairs.sparkSession.sparkContext.broadcast(bitmap(first, "__nj_r"))
        parts = stored(self.texts.mapInArrow(segments("__nj_text", bits, self.words), "c long, f int, grams array<long>"))
        bits.destroy()
        side = lambda c, g: parts.select(F.col("c").alias(c), "f", F.col("grams").alias(g))
        # pairs are told by fragment before both joins, so that one exchange of the segments serves both sides
        each = pairs.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
        partial = each.join(side("x", "gx"), ["x", "f"]).join(side("y", "gy"), ["y", "f"]).select("x", "y", "nx", "ny", "f", F.size(F.array_intersect("gx", "gy")).alias("o"))
        once = partial.groupBy("x", "y", "nx", "ny", "f").agg(F.max("o").alias("o"))  # a class may come from two tasks
        summed = once.groupBy("x", "y", "nx", "ny").agg(F.sum("o").alias("overlap"))
        return summed.filter(F.col("overlap") * 100 >= (F.col("nx") + F.col("ny") - F.col("overlap")) * self.percent).select("x", "y", "nx", "ny", "overlap")

    def prefixes(self) -> DataFrame:
        """Prefix grams (g, place p) of one row per class (c, n), where another class of a size that may link has the gram too."""
        spark = self.rows.sparkSession
        full = self.rows.filter("n_shingles > 0")
        full = full.withColumn("__nj_band", bands_of("n_shingles", self.percent))
        share = spark.sparkContext.broadcast
        # maps of one row per class, and of grams that two classes of sizes that may link share; they may let a few others pass
        rows_map = share(bitmap(full.groupBy("__nj_c").agg(F.min("__nj_u").alias("u")), "u"))
        single = full.select("__nj_u", "__nj_band", "__nj_prefix").mapInArrow(on_map("__nj_u", rows_map), "__nj_u long, __nj_band int, __nj_prefix array<long>")
        seen = F.bit_or(F.expr("shiftleft(1L, __nj_band)")).alias("seen")
        grams = single.select(F.explode("__nj_prefix").alias("g"), "__nj_band").groupBy("g").agg(F.count(F.lit(1)).alias("k"), seen).filter("k > 1").select("g", meeting_bands("k", "seen").alias("meet"))
        band = F.explode(F.expr(f"filter(sequence(0, {BANDS - 1}), i -> getbit(meet, i) = 1)"))
        places = grams.filter("meet <> 0").select("g", band.alias("i")).select(F.col("g").bitwiseXOR(F.shiftleft(F.col("i").cast("long"), BAND_SHIFT)).alias("g"))
        grams_map = share(bitmap(places, "g"))
        prefix = stored(full.select("__nj_u", "__nj_c", "__nj_band", "n_shingles", *PACKED, "__nj_prefix").mapInArrow(shared_prefixes(grams_map, rows_map), "g long, p int, c long, n long, s0 long, s1 long, s2 long, s3 long"))
        grams_map.destroy()
        rows_map.destroy()
        return prefix

    def components(self) -> DataFrame:
        """(__nj_c, __nj_root) of all classes that link with another one."""
        prefix, fields = self.prefixes(), ["p", "c", "n", *PACKED]
        shared = stored(prefix.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(*fields)).alias("lead")).filter("k > 1").select("g", "k", *(F.col(f"lead.{c}").alias(f"{c}x") for c in fields)))

        member = prefix.select("g", *(F.col(c).alias(f"{c}y") for c in fields))
        pairs = lambda df: df.select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y"), F.when(F.col("cx") < F.col("cy"), F.col("nx")).otherwise(F.col("ny")).alias("nx"), F.when(F.col("cx") < F.col("cy"), F.col("ny")).otherwise(F.col("nx")).alias("ny")).distinct()
        fit = self.fits("nx", "ny", "px", "py") & self.segments_fit("nx", "ny", "x", "y")
        # the members that may link with the lead, and those that may link with one another
        p = self.percent
        near = (F.col("py") + F.col("px")) * ((100 + p) * p) <= F.col("ny") * ((100 - p) * (100 + p))  # no member passes over fewer grams than the lead
        led = member.join(shared, "g").filter("cx <> cy").withColumns({"led": fit, "near": (F.col("k") > 2) & near}).filter("led OR near")
        led = stored(led.select("g", "k", "cx", "nx", *(f"{c}y" for c in fields), "led", "near"))
        links = stored(self.verified(pairs(led.filter("led"))).select(F.col("x").alias("a"), F.col("y").alias("b")))

        # the others of each gram meet one another
        rest = led.filter("near").select("g", "k", *(F.col(f"{c}y").alias(c) for c in fields))
        few = rest.filter(F.col("k") <= CROWD)
        named = lambda df, i, *more: df.select("g", *(F.col(c).alias(c + i) for c in (*fields, *more)))
        met = pairs(named(few, "x").join(named(few, "y"), "g").filter((F.col("cx") < F.col("cy")) & fit))
        # in a crowd, only pairs that are still apart, one side outside the component that was the largest at first
        roots = stored(star_components(links))
        crowd = stored(rooted(rest.filter(F.col("k") > CROWD).withColumn("root", F.col("c")), "root", roots))
        top = crowd.groupBy("g", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max(F.struct("k", "root")).alias("top")).select("g", F.col("top.root").alias("top"))
        fine = self.rows.select(F.col("__nj_c").alias("c"), *FINE, *PARITY).join(crowd.select("c").distinct(), "c", "left_semi").dropDuplicates(["c"])
        crowd = stored(crowd.join(top, "g").join(fine, "c").withColumn("block", block_of("c", "k")))
        open_ = met.union(pairs(self.meet(crowd, 0))).distinct()
        for block in range(1, (crowd.agg(F.max("block")).first()[0] or 0) + 1):
            roots = self.linked(open_, roots)
            crowd = stored(rooted(rooted(crowd, "root", roots), "top", roots))
            open_ = pairs(self.meet(crowd, block))
        return self.linked(open_, roots).select(F.col("node").alias("__nj_c"), F.col("root").alias("__nj_root"))

    def meet(self, crowd: DataFrame, block: int) -> DataFrame:
        """Of the classes that meet at the grams g of crowds, those outside the component `top` with those of a block, where they may link.

        A linked pair is met in one of the blocks or ends up connected: whichever of the two is outside when the block of the other comes meets it
        there, and if neither is, both are of the component `top`. Of two that are outside, the one of the earlier block comes first.
        """
        named = lambda df, i: df.select("g", *(F.col(c).alias(c + i) for c in ("p", "c", "n", *PACKED, "root", "top", "block", *FINE, *PARITY)))
        x, y = named(crowd.filter("root <> top"), "x"), named(crowd.filter(F.col("block") == block), "y")
        once = (F.col("rooty") == F.col("topy")) | (F.col("blockx") > block) | ((F.col("blockx") == block) & (F.col("cx") < F.col("cy")))
        fit = self.fits("nx", "ny", "px", "py") & self.segments_fit("nx", "ny", "x", "y") & self.segments_fit("nx", "ny", "x", "y", FINE)
        return x.join(y, "g").filter((F.col("rootx") != F.col("rooty")) & once & fit & self.parities_fit("nx", "ny", "x", "y"))

    def linked(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """roots (node, root) after the links among those pairs (x, y, nx, ny) that it leaves apart."""
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        known = pairs.join(root("x"), "x", "left").join(root("y"), "y", "left").withColumns({"a": F.coalesce("root_x", "x"), "b": F.coalesce("root_y", "y")})
        links = self.verified(known.filter("a <> b").select("x", "y", "nx", "ny")).select(F.col("x").alias("a"), F.col("y").alias("b"))
        more = stored(star_components(rooted(rooted(links, "a", roots), "b", roots)))
        alone = more.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
        return stored(rooted(roots.union(alone), "root", more))

    def assigned(self) -> DataFrame:
        """__nj_id, __nj_r, n_shingles and __nj_group of every document; the group is null for one without a set."""
        roots = stored(self.components())
        rows = self.rows.select("__nj_id", "__nj_r", "n_shingles", "__nj_c")
        return rows.join(roots, "__nj_c", "left").select("__nj_id", "__nj_r", "n_shingles", F.coalesce("__nj_root", "__nj_c").alias("__nj_group"))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """key, n_shingles and component_id, the smallest key that links reach, of every row of docs."""
    rows = stored(Join(docs, key, text, percent, words).assigned())
    least = rows.filter("__nj_group is not null").groupBy("__nj_group").agg(F.min("__nj_id").alias("__nj_least"))
    return rows.join(least, "__nj_group", "left").select(F.col("__nj_id").alias(key), "n_shingles", F.when(F.col("__nj_group").isNull(), F.col("__nj_id")).otherwise(F.col("__nj_least")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs with one row of each component, that of the smallest key; rows without a set all stay, repeated rows once."""
    rows = stored(Join(docs, key, text, percent, words).assigned())
    first = rows.filter("__nj_group is not null").groupBy("__nj_group").agg(F.min(F.struct(F.col("__nj_id").isNull().alias("no"), F.col("__nj_id"), F.col("__nj_r"))).alias("least")).select("least.__nj_r")
    kept = first.union(rows.filter("__nj_group is null").select("__nj_r").distinct())
    kept, repeated = stored(kept), stored(rows.groupBy("__nj_r").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__nj_r"))
    # rows that go or that come more than once are on a map; whatever is not on it stays, without a shuffle of texts
    doubtful = stored(rows.select("__nj_r").join(kept, "__nj_r", "left_anti").union(repeated))
    parts = map_parts(doubtful, "__nj_r")
    place = map_place("__nj_r")
    bit, byte = F.bitmap_bit_position(place), F.expr("conv(hex(substring(__nj_m, CAST(__nj_bit DIV 8 AS INT) + 1, 1)), 16, 10)").cast("int")
    marked = docs.withColumn("__nj_r", F.xxhash64(F.col(key).cast("string"), F.col(text))).withColumns({"__nj_b": F.bitmap_bucket_number(place), "__nj_bit": bit})
    on = F.coalesce(F.expr("shiftright(__nj_byte, CAST(__nj_bit % 8 AS INT)) & 1") == 1, F.lit(False))
    tested = marked.join(F.broadcast(parts.select(F.col("b").alias("__nj_b"), F.col("m").alias("__nj_m"))), "__nj_b", "left").withColumn("__nj_byte", byte).withColumn("__nj_on", on).drop("__nj_b", "__nj_m", "__nj_byte", "__nj_bit")
    sure, checked = tested.filter("NOT __nj_on").drop("__nj_on"), tested.filter("__nj_on").drop("__nj_on")
    chosen = lambda keys: checked.join(keys.hint("shuffle_hash"), "__nj_r", "left_semi")  # noqa: E731  texts are not sorted
    out = sure.unionByName(chosen(kept.join(repeated, "__nj_r", "left_anti")))
    if not repeated.isEmpty():
        out = out.unionByName(chosen(kept.join(repeated, "__nj_r", "left_semi")).dropDuplicates(["__nj_r"]))
    return out.drop("__nj_r")


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= {PERCENT} * (a.n + b.n - o)),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = to_id)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(to_id) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


@query("op6_vertical_ngram_join", SQL)
def _(spark, sf):
    return join_components(table(spark, sf, "documents").select("doc_id", "text"))
