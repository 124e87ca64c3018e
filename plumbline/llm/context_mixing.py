"""LM scoring (9): logistic context mixing over bits, and a unigram word model beside it.

A text is its UTF-8 bytes and an end symbol. Every bit is predicted by five hashed-context predictors (the
bits of the byte so far with the 0 to 3 bytes before it, or with all of the word before it), each a slot of
counts of zeros and ones over all training texts. Their stretched predictions are combined by weights that a gate picks (bit position and how
much the two longest contexts have seen), learned online; an adaptive probability map, one curve per bits so
far, refines the result. Bits sum to the text's code length.

Bytes with their three predecessors and the word so far are the sufficient statistics: tasks count them over all training texts,
Spark sums them, and slots, weights and the map are learned from that table in Spark jobs. An occurrence
is learned with its own count taken out, so that weights do not trust memories. Weights of
the tasks, each online over its share, are averaged by what they have seen, twice over. Then all is frozen,
so a score depends on the text alone. What reaches the driver is bounded by the slots.

Words are counted by 64-bit hashes. The tasks know the counts of the `COMMON` most frequent words (two
places by hash each, the more frequent first) and sum over them; words that they do not find there leave a
row each, which meets its count in a join and comes back to its text as a sum. Frequent words, which would
crowd one task, are the ones that need no join.

Edge cases: null text is empty and scores its end; without training rows every bit costs one and every token
log10(1) = 0 in the unigram model; a null id counts as the empty text in the split; repeated rows are scored
one by one and alike; texts of any length are scored whole, their score is a sum; an empty table gives an empty result; other
columns pass through, but for those that are added. Working columns start with `__cm_`.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.llm.language import PAD, shifted
from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut, remainder, replaced
from plumbline.llm.tokens import NOT_SPACE, Hasher, hash_spans, mix64, slices, sum_by_row, word_spans

#: Most bits of the slot tables of orders 0 to 3 and of words; orders 0 and 1 have a slot for everything. The hashed
#: tables grow with the number of distinct windows up to these, which bound what is broadcast.
MOST_BITS = (8, 16, 20, 21, 22)
LEAST_BITS = 14
INPUTS = len(MOST_BITS)
#: Distinct words and windows that a task gathers before it reports them.
BLOCK = 1 << 21
#: Windows of a learning task: each task loads the tables, so that small shares of windows would cost more than they are.
WINDOWS_A_TASK = 1 << 20
COMMON, COMMON_BITS = 1 << 19, 20
CONFIDENCE = np.array([0.5, 1.5, 3.5, 15.5])
GATES = 8 * 25
KNOTS = 33
CACHE_BITS = 20
RATE = 0.02


def end_marked(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the end symbol after each."""
    return np.insert(data, rows[1:], PAD), rows + np.arange(len(rows))


def windows(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each symbol (low byte) with its three predecessors and, in the high half, a hash of the word before it."""
    code = data.astype(np.uint64)
    for k in (1, 2, 3):
        code |= shifted(data, rows, k, PAD).astype(np.uint64) << np.uint64(8 * k)
    at = np.arange(len(data))
    begin = np.zeros(len(data), np.int64)
    begin[1:] = np.maximum.accumulate(np.where(NOT_SPACE[data] & (data != PAD), 0, at + 1))[:-1]
    return code | Hasher(data)(begin, at) >> np.uint64(32) << np.uint64(32)


class Tables:
    """Where the slots of each predictor lie: those of the bits so far after a context."""

    def __init__(self, windows: int):
        """Tables for so many distinct windows."""
        grown = max(LEAST_BITS, int(np.ceil(np.log2(max(windows, 1)))) + 1)
        self.bits = [most if k < 2 else min(most, grown) for k, most in enumerate(MOST_BITS)]
        self.begin = np.concatenate([[0], np.cumsum([1 << b for b in self.bits])]).astype(np.int32)
        # the bits so far shuffle a context's slots over its table
        self.step = [(mix64(np.arange(256, dtype=np.uint64) + np.uint64(k << 20)) & np.uint64((1 << b) - 1)).astype(np.int32) for k, b in enumerate(self.bits)]

    def contexts(self, code: np.ndarray) -> tuple[np.ndarray, list]:
        """The byte of each window, and its place in each table before any bit is known."""
        code = code.astype(np.uint64)
        before = code >> np.uint64(8)
        places = [np.int32(0), self.begin[1] + ((before & np.uint64(0xFF)).astype(np.int32) << 8)]
        for k, context in ((2, before & np.uint64(0xFFFF)), (3, before & np.uint64(0xFFFFFF)), (4, code >> np.uint64(32))):
            places.append((mix64(context | np.uint64(k << 40)) >> np.uint64(64 - self.bits[k])).astype(np.int32))
        return (code & np.uint64(0xFF)).astype(np.int32), places

    def slots(self, byte: np.ndarray, places: list, bit: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots of all predictors before bit number `bit` (0 is the highest), the bits so far, and the bit."""
        so_far = (1 << bit) | (byte >> (8 - bit))
        at = [so_far, places[1] | so_far] + [self.begin[k] + (places[k] ^ self.step[k][so_far]) for k in range(2, INPUTS)]
        return at, so_far, (byte >> (7 - bit)) & 1


def count_all(text: str):
    """For mapInArrow: counts of words (kind 0) and of byte windows (kind 1) of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = ([], []), 0

        def flush():
            for kind in (0, 1):
                values, at = np.unique(np.concatenate([x for x, _ in have[kind]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in have[kind]]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, np.int32)), pa.array(values.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for batch in batches:
            for _, _, data, rows in slices(batch.column(text)):
                starts, stops, first = word_spans(data, rows, NOT_SPACE)
                have[0].append(np.unique(hash_spans(data, starts, stops), return_counts=True))
                code, n = np.unique(windows(*end_marked(data, rows)), return_counts=True)
                have[1].append((code, n))
                size += sum(len(have[k][-1][0]) for k in (0, 1))
                if size > BLOCK:
                    yield from flush()
                    have, size = ([], []), 0
        if have[0]:
            yield from flush()

    return run


def count_slots(tables: Tables):
    """For mapInArrow over windows: zeros and ones of every slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * int(tables.begin[-1]), np.uint32)
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.uint32)
            byte, places = tables.contexts(batch.column("key").to_numpy().view(np.uint64))
            for j in range(8):
                at, _, bit = tables.slots(byte, places, j)
                for slot in at:
                    np.add.at(counts, 2 * slot + bit, n)
        counts = counts.reshape(-1, 2)
        used = np.flatnonzero(counts.any(1))
        for lo in range(0, len(used), 1 << 18):
            u = used[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(counts[u, 0].astype(np.int64)), pa.array(counts[u, 1].astype(np.int64))], ["slot", "zeros", "ones"])

    return run


class Model:
    """Tables, mixer weights and map. What it shares goes to the tasks once, the rest with each step."""

    def __init__(self, tables: Tables, zeros: np.ndarray, ones: np.ndarray):
        self.tables, self.zeros, self.ones = tables, zeros.astype(np.float32, copy=False), ones.astype(np.float32, copy=False)
        self.stretched = self.seen = self.shared = None
        self.weights = np.full((GATES, INPUTS + 1), 0.25, np.float32)
        self.weights[:, INPUTS] = 0.0
        self.knots = np.linspace(-8, 8, KNOTS)
        self.map = np.tile(1 / (1 + np.exp(-self.knots)), (256, 1)).astype(np.float32)

    ARRAYS = ("zeros", "ones", "stretched", "seen")

    def share(self, spark) -> None:
        """Broadcast the tables; the model then travels without them."""
        self.release()
        self.shared = spark.sparkContext.broadcast({k: getattr(self, k) for k in self.ARRAYS})

    def release(self) -> None:
        if self.shared is not None:
            self.shared.destroy()
            self.shared = None

    def freeze(self) -> None:
        """From here on the model only scores: a slot's prediction and confidence are looked up, its counts are not."""
        self.release()
        self.seen = np.zeros(len(self.ones), np.uint8)
        for lo in range(0, len(self.ones), 1 << 18):  # in pieces: no further copy of the tables
            part = slice(lo, lo + (1 << 18))
            self.seen[part] = np.searchsorted(CONFIDENCE, self.zeros[part] + self.ones[part])
            self.ones[part] = np.log((self.ones[part] + np.float32(0.4)) / (self.zeros[part] + np.float32(0.4)))
        self.stretched, self.zeros, self.ones = self.ones, None, None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self.ARRAYS or self.shared is None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.shared is not None:
            self.__dict__.update(self.shared.value)

    def inputs(self, at: list[np.ndarray], actual: np.ndarray, bit: int, own: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """Stretched predictions of the slots, and the gate; with `own`, an occurrence's own count is taken out."""
        if self.stretched is not None:
            x, seen = [self.stretched[a] for a in at], [self.seen[a] for a in at[3:]]
        else:
            zeros, ones = [self.zeros[a] for a in at], [self.ones[a] for a in at]
            if own:
                hit = actual.astype(np.float32)
                zeros, ones = [c - (1 - hit) for c in zeros], [c - hit for c in ones]
            x = [np.log((o + np.float32(0.4)) / (z + np.float32(0.4))) for z, o in zip(zeros, ones)]
            seen = [np.searchsorted(CONFIDENCE, z + o) for z, o in zip(zeros[3:], ones[3:])]
        return x, bit * 25 + seen[1].astype(np.int32) * 5 + seen[0]

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        flat, at = self.weights.reshape(-1), gate * (INPUTS + 1)
        z = flat[at + INPUTS]
        for k, one in enumerate(x):
            z += one * flat[at + k]
        return np.clip(z, -8, 8, out=z)

    def refine(self, z: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        """Probability of a one: the mix and its place on the map's curve, averaged."""
        t = (z + np.float32(8)) * np.float32((KNOTS - 1) / 16)
        k = np.minimum(t.astype(np.int32), KNOTS - 2)
        f = t - k
        curve, at = self.map.reshape(-1), so_far * KNOTS + k
        low = curve[at]
        mapped = low + (curve[at + 1] - low) * f
        return np.clip(np.float32(0.5) * mapped + np.float32(0.5) / (1 + np.exp(-z)), np.float32(1e-6), np.float32(1 - 1e-6))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of each window's symbol."""
        chance = np.ones(len(code))  # 1e-48 at least
        byte, places = self.tables.contexts(code)
        for j in range(8):
            at, so_far, actual = self.tables.slots(byte, places, j)
            p = self.refine(self.mixed(*self.inputs(at, actual, j)), so_far).astype(np.float64)
            chance *= np.where(actual == 1, p, 1 - p)
        return -np.log2(chance)


def learn_weights(model: Model):
    """For mapInArrow over windows: one task's weights after an online pass, and what it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            codes, counts = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy().astype(float)
            for lo in range(0, len(codes), 4096):
                code, n = codes[lo : lo + 4096], counts[lo : lo + 4096]
                total += n.sum()
                byte, places = model.tables.contexts(code)
                for j in range(8):
                    at, _, actual = model.tables.slots(byte, places, j)
                    x, gate = model.inputs(at, actual, j, own=True)
                    error = (actual - 1 / (1 + np.exp(-model.mixed(x, gate)))) * n
                    lo_, own = j * 25, gate - j * 25  # a bit has gates of its own
                    mass, step = np.zeros(GATES), np.zeros((GATES, INPUTS + 1))
                    mass[lo_ : lo_ + 25] = np.bincount(own, n, 25)
                    for k in range(INPUTS + 1):
                        step[lo_ : lo_ + 25, k] = np.bincount(own, error * x[k] if k < INPUTS else error, 25)
                    # a gate's mean gradient, slower where it has seen little in this step
                    model.weights += (RATE * step / np.maximum(mass, 50.0)[:, None]).astype(np.float32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([model.weights.astype(float).reshape(-1).tolist()], pa.list_(pa.float64()))], ["seen", "weights"])

    return run


def learn_map(model: Model):
    """For mapInArrow over windows: hits and ones near every knot of every curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, ones = np.zeros(256 * KNOTS), np.zeros(256 * KNOTS)
        for batch in batches:
            code, n = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy().astype(float)
            byte, places = model.tables.contexts(code)
            for j in range(8):
                at, so_far, actual = model.tables.slots(byte, places, j)
                x, gate = model.inputs(at, actual, j, own=True)
                t = (model.mixed(x, gate).astype(np.float64) + 8) * ((KNOTS - 1) / 16)
                k = np.minimum(t.astype(np.int64), KNOTS - 2)
                for knot, share in ((k, 1 - (t - k)), (k + 1, t - k)):
                    hits += np.bincount(so_far * KNOTS + knot, n * share, len(hits))
                    ones += np.bincount(so_far * KNOTS + knot, n * share * actual, len(ones))
        used = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(hits[used]), pa.array(ones[used])], ["place", "hits", "ones"])

    return run


def count(training: DataFrame, text: str = "text") -> DataFrame:
    """kind (0: word, 1: byte window), key and n over all training texts. Windows are dealt by the two bytes before them, so
    that the tasks which go over them have few slots in common."""
    found = training.select(F.col(text).alias("__cm_text")).mapInArrow(count_all("__cm_text"), "kind int, key long, n long")
    near = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    dealt = found.select("kind", near.alias("near"), "key", "n").repartition("kind", "near")
    return cut(dealt.groupBy("kind", "near", "key").agg(F.sum("n").alias("n")).select("kind", "key", "n"))


def learn(counts: DataFrame) -> Model:
    """The mixing model from the counts of byte windows."""
    spark, seen = counts.sparkSession, counts.filter("kind = 1").select("key", "n")
    n = seen.count()
    tables, seen = Tables(n), seen.coalesce(max(1, -(-n // WINDOWS_A_TASK)))
    found = seen.mapInArrow(count_slots(tables), "slot int, zeros long, ones long").groupBy("slot").agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")).toArrow()
    zeros, ones = (np.zeros(int(tables.begin[-1]), np.float32) for _ in range(2))
    at = found.column("slot").to_numpy()
    zeros[at], ones[at] = found.column("zeros").to_numpy(), found.column("ones").to_numpy()
    model = Model(tables, zeros, ones)
    del found, at, zeros, ones  # the driver keeps one copy of the tables
    model.share(spark)
    for _ in range(2):
        rows = seen.mapInArrow(learn_weights(model), "seen double, weights array<double>").groupBy().agg(F.sum("seen"), F.array(*(F.sum(F.col("seen") * F.col("weights")[i]) for i in range(GATES * (INPUTS + 1))))).first()
        if rows[0]:
            model.weights = (np.array(rows[1]) / rows[0]).reshape(GATES, INPUTS + 1).astype(np.float32)
    curve = seen.mapInArrow(learn_map(model), "place int, hits double, ones double").groupBy("place").agg(F.sum("hits").alias("hits"), F.sum("ones").alias("ones")).toArrow()
    start, at = model.map.reshape(-1), curve.column("place").to_numpy()
    hits, ones = np.zeros(256 * KNOTS), np.zeros(256 * KNOTS)
    hits[at], ones[at] = curve.column("hits").to_numpy(), curve.column("ones").to_numpy()
    model.map = ((ones + 20 * start) / (hits + 20)).reshape(256, KNOTS).astype(np.float32)  # a curve moves from the identity as it sees cases
    model.freeze()
    model.share(spark)
    return model


#: No window: a text's first symbol has only padding before it, never this.
NONE = np.uint64(0x00FFFFFF)


class Scorer:
    """Code lengths of texts. Windows already met are looked up in a table of fixed size."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.costs = np.full(1 << CACHE_BITS, NONE, np.uint64), np.zeros(1 << CACHE_BITS, np.float32)

    def __call__(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        data, rows = end_marked(data, rows)
        code = windows(data, rows)
        slot = (mix64(code) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        cost = self.costs[slot]
        missing = np.flatnonzero(self.keys[slot] != code)
        if len(missing):
            new, at = np.unique(code[missing], return_inverse=True)
            price = np.concatenate([self.model.bits(new[i : i + 16384]) for i in range(0, len(new), 16384)]).astype(np.float32)
            cost[missing] = price[at]
            place, kept = np.unique((mix64(new) >> np.uint64(64 - CACHE_BITS)).astype(np.int64), return_index=True)  # of several that share a place, one
            self.keys[place], self.costs[place] = new[kept], price[kept]
        return np.add.reduceat(cost, rows[:-1], dtype=np.float64)


class CommonWords:
    """Counts of frequent words, each at one of two places."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray):
        self.keys, self.n = np.zeros(1 << COMMON_BITS, np.uint64), np.zeros(1 << COMMON_BITS, np.int64)
        order = np.lexsort((hashes, -n))
        left = order
        for place in self.places(hashes):
            at = place[left]
            free = left[self.keys[at] == 0]
            _, first = np.unique(place[free], return_index=True)  # the most frequent of those that want it
            chosen = free[first]
            self.keys[place[chosen]], self.n[place[chosen]] = hashes[chosen], n[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            left = order[np.isin(order, left)]

    @staticmethod
    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - COMMON_BITS)).astype(np.int64), (hashes & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each word, 0 if it is not here."""
        out = np.zeros(len(hashes), np.int64)
        for place in self.places(hashes):
            found = self.keys[place] == hashes
            out[found] = self.n[place[found]]
        return out


def measure(text: str, carried: list[str], model: Model, common):
    """For mapInArrow: a text's carried columns, a row number, the model's score, its words, and of the common
    ones their number and the sum of log10(count + 1); the hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, table_, row = Scorer(model), common.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(text)):
                starts, stops, first = word_spans(data, rows, NOT_SPACE)
                hashes = hash_spans(data, starts, stops)
                n = table_(hashes)
                rare = n == 0
                ends = np.concatenate([[0], np.cumsum(rare)])[first].astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in carried), pa.array(row + np.arange(hi - lo)), pa.array(scorer(data, rows) * -np.log10(2)), pa.array(np.diff(first)), pa.array(sum_by_row(~rare, first)), pa.array(sum_by_row(np.log10(n + 1.0) * ~rare, first)), others],
                    [*carried, "__cm_row", "score", "__cm_words", "__cm_common", "__cm_logs", "__cm_rare"],
                )
                row += hi - lo

    return run


def score(docs: DataFrame, training: DataFrame, text: str = "text") -> DataFrame:
    """docs without their text, with `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`."""
    docs = replaced(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    spark, counts, ends = docs.sparkSession, count(training, text), training.count()
    words = counts.filter("kind = 0").select(F.col("key").alias("__cm_hash"), "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = tokens + ends, kinds + (ends > 0)
    # the least count that at most COMMON words reach; one row per count below 1,000
    upto = F.sum("k").over(Window.orderBy(F.desc("c")))
    least = words.groupBy(F.least("n", F.lit(1000)).alias("c")).agg(F.count(F.lit(1)).alias("k")).withColumn("upto", upto).filter(F.col("upto") <= COMMON).agg(F.min("c")).first()[0]
    top = words.filter(F.col("n") >= (1 << 62 if least is None else least)).toArrow()
    common = spark.sparkContext.broadcast(CommonWords(top.column("__cm_hash").to_numpy().view(np.uint64), top.column("n").to_numpy()))
    carried = [c for c in docs.columns if c != text]
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, *T._parse_datatype_string("__cm_row long, score double, __cm_words long, __cm_common long, __cm_logs double, __cm_rare array<long>").fields])
    model = learn(counts)
    rows = cut(docs.mapInArrow(measure(text, carried, model, common), schema))
    model.release()
    common.destroy()
    rare = rows.select("__cm_row", F.explode("__cm_rare").alias("__cm_hash")).groupBy("__cm_row", "__cm_hash").agg(F.count(F.lit(1)).alias("t"))
    met = rare.join(words, "__cm_hash")  # a word that is not in the training texts adds log10(1)
    sums = met.groupBy("__cm_row").agg(F.sum("t").alias("__cm_more"), F.sum(F.col("t") * F.log10(F.col("n") + 1)).alias("__cm_more_logs"))
    out = rows.drop("__cm_rare").join(sums, "__cm_row", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_tokens = F.col("__cm_words") + 1
    return out.select(*carried, n_tokens.alias("n_tokens"), (F.col("__cm_common") + more("__cm_more") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__cm_logs") + more("__cm_more_logs") + F.log10(F.lit(ends + 1.0)) - n_tokens * F.log10(F.lit(total + kinds + 1.0))).alias("base_score"), "score")


@query("op9_context_mixing")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 7) == 2)
    return score(docs, docs.filter(~F.col("held_out"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
