"""Benchmark decontamination (5): suffix arrays of the training text, searched by every benchmark suffix.

The training text is cut into shards (slices of a task's rows, whole texts). A shard's suffix array is built
by prefix doubling over word ids; only suffixes that start with two consecutive benchmark words enter it, as
no other can hold a match (with one-word items: one word). Every benchmark suffix of a window's length is
looked up by binary search; consecutive hits on one diagonal are one verbatim match, the longest there, with
its places in item and text. Words are compared by 64-bit hashes of their bytes.

The benchmark is given to the tasks in blocks of at most `block_words` words, one broadcast each, chained in
one scan of the documents: no shuffle, no join, and a lost task is redone from its own rows.

Edge cases: null or empty text has no words and is clean; items without words are no items; equal items
count one by one; an item shorter than the window is one window; repeated rows are judged one by one; texts of any length are judged whole; empty
tables work on either side; other columns pass through. Working columns start with `__dc_`.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.registry import query, table
from plumbline.llm.tokens import ALNUM, hash_spans, slices, word_spans

WINDOW = 13
#: Words of the benchmark that one task holds at a time.
BLOCK_WORDS = 1 << 20
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_word", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("words", T.IntegerType())])


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, rows' first words) slice by slice."""
    for lo, hi, data, rows in slices(column):
        starts, stops, first = word_spans(data, rows, ALNUM)
        yield lo, hi, hash_spans(data, starts, stops), first


class Benchmark:
    """The suffixes of a block of items: word ids with a 0 after each item, and the windows that count."""

    def __init__(self, items: list[tuple], window: int):
        hashes, self.item, first = [], [], 0
        lengths = []
        for item, text in items:
            for _, _, h, _ in words_of(pa.array([text], pa.large_string())):
                if len(h):
                    hashes.append(h)
                    self.item.append(item)
                    lengths.append(len(h))
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        ids, self.owner, self.at, self.size = [], [], [], []
        for i, h in enumerate(hashes):
            n = len(h)
            ids += [np.searchsorted(self.vocabulary, h) + 1, np.zeros(1, np.int64)]
            w = min(window, n)
            self.owner.append(np.full(n - w + 1, i))
            self.at.append(first + np.arange(n - w + 1))
            self.size.append(np.full(n - w + 1, w))
            first += n + 1
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.owner, self.at, self.size = join(self.owner), join(self.at), join(self.size)
        self.start = np.concatenate([[0], np.cumsum([n + 1 for n in lengths])]).astype(np.int64)
        self.shortest = min(lengths, default=0)
        m = len(self.vocabulary) + 1
        ok = (self.ids[:-1] > 0) & (self.ids[1:] > 0) if len(self.ids) else np.zeros(0, bool)
        self.pairs = np.unique(self.ids[:-1][ok] * m + self.ids[1:][ok]) if len(self.ids) else np.zeros(0, np.int64)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, 0 for words that the benchmark lacks."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            h = hashes[maybe]
            k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[k] == h, k + 1, 0)
        return out


class Shard:
    """A suffix array of word ids (0 ends a text) over the suffixes that a benchmark suffix can match."""

    def __init__(self, ids: np.ndarray, bench: Benchmark):
        m = len(bench.vocabulary) + 1
        known = ids > 0
        if bench.shortest > 1:
            ok = np.flatnonzero(known[:-1] & known[1:])
            pair = ids[ok] * m + ids[ok + 1]
            k = np.minimum(np.searchsorted(bench.pairs, pair), max(0, len(bench.pairs) - 1))
            self.at = ok[bench.pairs[k] == pair] if len(bench.pairs) else ok[:0]
        else:
            self.at = np.flatnonzero(known)
        self.n, self.bench = len(ids), bench
        #: Rank of the first 1, 2, 4, 8 words at each kept place and at each benchmark place; 0: none.
        self.levels = [(ids[self.at], bench.ids)]
        self.ids = ids

    def _spread(self, rank: np.ndarray, level: int) -> np.ndarray:
        out = np.zeros(self.n + 64, np.int64)
        if level == 0:
            out[: self.n] = self.ids
        else:
            out[self.at] = rank
        return out

    def _combine(self, a: tuple, b: tuple, shift: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of longer prefixes: rank a, then rank b `shift` words on."""
        mine, theirs = self._spread(b[0], level)[self.at + shift], np.concatenate([b[1], np.zeros(64, np.int64)])[np.arange(len(b[1])) + shift]
        top = max(int(mine.max(initial=0)), int(theirs.max(initial=0))) + 1
        x, y = np.where((a[0] > 0) & (mine > 0), a[0] * top + mine, 0), np.where((a[1] > 0) & (theirs > 0), a[1] * top + theirs, 0)
        keys = np.unique(x)
        rank = np.searchsorted(keys, x) + 1
        k = np.minimum(np.searchsorted(keys, y), max(0, len(keys) - 1))
        found = (keys[k] == y) & (y > 0) if len(keys) else np.zeros(len(y), bool)
        return np.where(x > 0, rank, 0), np.where(found, k + 1, 0)

    def ranks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the first `length` words, here and in the benchmark."""
        while 1 << len(self.levels) <= length:
            last = len(self.levels) - 1
            self.levels.append(self._combine(self.levels[last], self.levels[last], 1 << last, last))
        out, done = None, 0
        for level in reversed(range(len(self.levels))):
            if length & (1 << level):
                out = self.levels[level] if out is None else self._combine(out, self.levels[level], done, level)
                done += 1 << level
        return out

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """All (window number, place) pairs: each window's range of the suffix array."""
        windows, places = [], []
        for length in np.unique(self.bench.size):
            mine, theirs = self.ranks(int(length))
            array = np.argsort(mine, kind="stable")
            ordered = mine[array]
            who = np.flatnonzero(self.bench.size == length)
            wanted = theirs[self.bench.at[who]]
            who, wanted = who[wanted > 0], wanted[wanted > 0]
            lo, hi = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
            count = hi - lo
            windows.append(np.repeat(who, count))
            places.append(self.at[array[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]])
        return (np.concatenate(windows), np.concatenate(places)) if windows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def matches_of(hashes: np.ndarray, first: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches of a shard: rows, item numbers, first item word, first word, words."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    ids = np.zeros(len(hashes) + n + 1, np.int64)
    ids[np.arange(len(hashes)) + row] = bench.word_ids(hashes)  # a 0 after each text
    windows, places = Shard(ids, bench).hits()
    begin = first[:-1] + np.arange(n)
    r = np.searchsorted(begin, places, "right") - 1
    item, word = bench.owner[windows], bench.at[windows] - bench.start[bench.owner[windows]]
    place, size = places - begin[r], bench.size[windows]
    order = np.lexsort((place, place - word, item, r))
    r, item, word, place, size = (x[order] for x in (r, item, word, place, size))
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (place[1:] - word[1:] != place[:-1] - word[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(r)]])[: len(at)] - 1
    return r[at], item[at], word[at], place[at], place[last] + size[last] - place[at]


def block_scan(bench_rows, text: str, columns: list[str], window: int):
    """A function for mapInArrow: adds one block's matches to what earlier blocks found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(bench_rows.value, window)
        for batch in batches:
            found = [x or [] for x in batch.column("__dc_matches").to_pylist()]
            counts = np.zeros(batch.num_rows, np.int64)
            for lo, hi, hashes, first in words_of(batch.column(text)):
                counts[lo:hi] = np.diff(first)
                for r, i, w, p, k in zip(*(x.tolist() for x in matches_of(hashes, first, bench))):
                    found[lo + r].append({"item_id": bench.item[i], "item_word": w, "word": p, "words": k})
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("word", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(counts), pa.array(found, kind)], [*columns, "__dc_n_words", "__dc_matches"])

    return scan


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with `__dc_n_words` and `__dc_matches`: every longest verbatim match of `window` words or more (or of a
    whole shorter item): item_id, first word in the item, first word in the text, length in words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    words = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-words // (2 * block_words)))  # a word takes two bytes at least, with what parts it from the next
    out = docs.withColumns({"__dc_n_words": F.lit(0).cast("long"), "__dc_matches": F.lit(None).cast(T.ArrayType(MATCH))})
    schema = T.StructType([*docs.schema.fields, T.StructField("__dc_n_words", T.LongType()), T.StructField("__dc_matches", T.ArrayType(MATCH))])
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()  # about block_words words
        out = out.mapInArrow(block_scan(spark.sparkContext.broadcast([tuple(r) for r in rows]), text, docs.columns, window), schema)
    return out


def judge(matched: DataFrame) -> DataFrame:
    """Add `__dc_n_hit` (words inside any match), `__dc_item_ids` (distinct, sorted as text) and `__dc_contaminated`."""
    spans = F.array_sort(F.transform("__dc_matches", lambda m: F.struct(m["word"].alias("lo"), (m["word"] + m["words"]).alias("hi"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(spans, start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["to"]))).cast("long").alias("n"), F.greatest(s["hi"], a["to"]).alias("to")))["n"]
    ids = F.array_sort(F.array_distinct(F.transform("__dc_matches", lambda m: m["item_id"].cast("string"))))
    found = matched.withColumns({"__dc_n_hit": F.coalesce(covered, F.lit(0)).cast("long"), "__dc_item_ids": F.coalesce(ids, F.array().cast("array<string>"))})
    return found.withColumn("__dc_contaminated", (F.col("__dc_n_hit") > 0) & (20 * F.col("__dc_n_hit") >= F.col("__dc_n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents of which less than a twentieth of the words is benchmark text; docs' columns."""
    return judge(find_matches(docs, benchmark, **options)).filter(~F.col("__dc_contaminated")).select(*docs.columns)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, p, item_id FROM grams JOIN windows USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)"""


@query("op5_suffix_array_decontamination", SQL)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = judge(find_matches(docs, table(spark, sf, "benchmark")))
    return found.select("doc_id", F.col("__dc_n_words").alias("n_words"), F.col("__dc_n_hit").alias("n_hit"), F.size("__dc_item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("__dc_item_ids", ",").cast("binary"), 256).alias("items_sha256"), F.col("__dc_contaminated").alias("contaminated"))
