"""Language ID (2): prediction by partial matching. Every language has a byte context tree of variable order;
a text belongs to the language under whose frozen statistics its exact code length is smallest.

Trees share one set of contexts (up to `order` bytes back, the most frequent `max_contexts`). In a context
seen n times before d different bytes, a byte seen c times costs -log2(c / (n + d)) bits, and any other one
the escape -log2(d / (n + d)) plus its cost in the next shorter context; the empty context escapes to 8 bits.
Costs are worked out once for each (context, byte, language), so a text is scored by walking the tree by
array operations.

The counts come from a bounded sample of the labelled rows: about `sample_bytes` of text per language, whole
texts drawn by hash, at least one of each language. A text with many copies comes as often as its share says. Everything is scored, in whole.

Edge cases: null text, and text without a letter, is `und` with score 0, as is everything if nothing was
learned; rows without language teach nothing; a null id counts as the empty text in the split; ties go to the
language first in code-point order; texts of any length are scored whole; repeated rows are scored one by one and alike; an empty
table gives an empty result; other columns pass through. Added columns: `lang_pred`, `score`, which replace
columns of these names; working
columns start with `__la_`.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut, fraction, remainder, replaced
from plumbline.llm.tokens import slices

ORDER = 4
SAMPLE_BYTES = 2_000_000
MAX_CONTEXTS = 1 << 14
#: Stands before the first byte of a text; UTF-8 never has it.
PAD = 0xFF


def shifted(data: np.ndarray, rows: np.ndarray, back: int, pad: int) -> np.ndarray:
    """The byte `back` places before each byte of the same text, or pad."""
    out = np.full(len(data), pad, data.dtype)
    out[back:] = data[:-back] if back < len(data) else out[back:]
    for k in range(back):
        at = rows[:-1] + k
        out[at[at < rows[1:]]] = pad
    return out


def gram_counts(lang: str, text: str, order: int):
    """For mapInArrow: counts of order + 1 bytes as one number, per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(lang).to_numpy(zero_copy_only=False)
            for lo, hi, data, rows in slices(batch.column(text)):
                code = data.astype(np.int64)
                for k in range(1, order + 1):
                    code |= shifted(data, rows, k, PAD).astype(np.int64) << (8 * k)
                names = langs[lo:hi]
                owner = np.repeat(np.arange(hi - lo), np.diff(rows))
                for name in sorted(set(names)):
                    grams, n = np.unique(code[(names == name)[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return count


class Trees:
    """Costs of every kept context and byte in every language."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, max_contexts: int):
        self.langs, self.order = langs, order
        symbols = np.unique(gram & 0xFF)
        self.alphabet = np.zeros(256, np.int32)  # 0: a byte no text had, or none
        self.alphabet[symbols] = np.arange(1, len(symbols) + 1)
        a, many = len(symbols) + 1, len(langs)
        self.a = a
        sym = self.alphabet[gram & 0xFF]
        node, parents, children, depth_of, self.parts = np.zeros(len(gram), np.int64), [0], [], [0], []
        for k in range(1, order + 1):
            byte = self.alphabet[(gram >> (8 * k)) & 0xFF]
            ok = (node >= 0) & (byte > 0)
            key = np.where(ok, node * a + byte, -1)
            keys, at = np.unique(key, return_inverse=True)
            seen = np.bincount(at, n, len(keys))
            seen[keys < 0] = 0
            room = max(0, (max_contexts - len(parents)) // (order + 1 - k) if k < order else max_contexts - len(parents))
            kept = np.sort(np.argsort(-seen, kind="stable")[:room])
            kept = kept[seen[kept] > 1]
            number = np.full(len(keys), -1)
            number[kept] = len(parents) + np.arange(len(kept))
            children += zip((keys[kept]).tolist(), number[kept].tolist())
            parents += (keys[kept] // a).tolist()
            depth_of += [k] * len(kept)
            self._count(node, sym, lang, n)
            node = number[at]
        self._count(node, sym, lang, n)
        s = self.s = len(parents)
        seen = np.zeros((s * a, many))
        for place, of, times in self.parts:
            seen += np.bincount(place * many + of, times, s * a * many).reshape(seen.shape)
        del self.parts
        seen = seen.reshape(s, a, many)
        total, kinds = seen.sum(1), (seen > 0).sum(1)
        cost = np.empty((s, a, many), np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(seen / (total + kinds)[:, None, :])
        depth_of = np.array(depth_of)
        for k in range(order + 1):  # a context's parent is one byte shorter
            at = np.flatnonzero(depth_of == k)
            shorter = np.full((1, 1, many), 8.0) if k == 0 else cost[np.array(parents)[at]]
            cost[at] = np.where(seen[at] > 0, own[at], escape[at][:, None, :] + shorter)
        self.cost = cost.reshape(s * a, many)
        #: Next context when one more byte back is looked at; contexts s.. have ended their walk.
        self.child = np.repeat(np.arange(2 * s, dtype=np.int32), a)
        self.child[: s * a] += s
        for key, number in children:
            self.child[key] = number

    def _count(self, node: np.ndarray, sym: np.ndarray, lang: np.ndarray, n: np.ndarray) -> None:
        ok = node >= 0
        self.parts.append((node[ok] * self.a + sym[ok], lang[ok], n[ok]))

    def lengths(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        c = self.alphabet[data]
        state = np.zeros(len(data), np.int32)
        for k in range(1, self.order + 1):
            state = self.child[state * np.int32(self.a) + shifted(c, rows, k, 0)]
        state = np.where(state >= self.s, state - self.s, state)
        bits = self.cost[state * np.int32(self.a) + c]
        out = np.zeros((len(rows) - 1, len(self.langs)))
        full = np.flatnonzero(rows[:-1] < rows[1:])
        if len(full):
            out[full] = np.add.reduceat(bits, rows[:-1][full], axis=0, dtype=np.float64)
        return out


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES, max_contexts: int = MAX_CONTEXTS) -> Trees | None:
    """Trees of the languages in `labelled`; None if it has none. What comes to the driver is bounded by the sample."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("__la_lang"), F.col(text).alias("__la_text"))
    rows = rows.withColumn("__la_digest", F.xxhash64("__la_lang", "__la_text"))
    texts = cut(rows.groupBy("__la_lang", "__la_digest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("__la_text")).alias("bytes")))
    sizes = texts.groupBy("__la_lang").agg(F.sum("bytes").alias("all"), F.min(F.struct(fraction("__la_digest") / F.col("n"), "__la_digest")).alias("first"))
    share = F.col("n") * F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.col("all"))
    times = (F.floor(share) + (fraction("__la_digest") < share - F.floor(share)).cast("long")).alias("times")
    draws = texts.join(F.broadcast(sizes), "__la_lang").select("__la_digest", F.greatest(times, (F.col("__la_digest") == F.col("first.__la_digest")).cast("long")).alias("times")).filter("times > 0")
    sample = rows.join(F.broadcast(cut(draws)), "__la_digest").dropDuplicates(["__la_digest"]).withColumn("__la_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("__la_lang", "__la_text")
    counts = sample.mapInArrow(gram_counts("__la_lang", "__la_text", order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    names = counts.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    order_of = np.array([langs.index(x) for x in names.dictionary.to_pylist()])
    return Trees(langs, order_of[names.indices.to_numpy()], counts.column("gram").to_numpy(), counts.column("n").to_numpy(), order, min(max_contexts, (1 << 26) // (256 * len(langs))))


def predict(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`, the share of the best language when code lengths are read as probabilities."""
    docs = replaced(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if trees is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared, columns = docs.sparkSession.sparkContext.broadcast(trees), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        names = np.array([*trees.langs, "und"], object)
        for batch in batches:
            letters = batch.column("__la_letters").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(batch.num_rows, len(trees.langs)), np.zeros(batch.num_rows)
            for lo, hi, data, rows in slices(batch.column(text)):
                bits = trees.lengths(data, rows)
                best[lo:hi] = bits.argmin(1)
                score[lo:hi] = 1 / np.exp2(np.maximum(-1000, bits.min(1, keepdims=True) - bits)).sum(1)
            best[~letters], score[~letters] = len(trees.langs), 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names[best], pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

    return docs.withColumn("__la_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


@query("op2_ppm_language")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 5) == 0)
    trees = learn(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), trees).select("doc_id", "held_out", "lang_pred", "score")
