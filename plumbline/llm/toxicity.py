"""Toxicity (10): non-negative positive-unlabelled learning on hashed words.

Confirmed toxic texts are the positives; a sample of all training texts is the unlabelled set. The risk of
calling unlabelled texts clean, corrected by what the toxic share among them (the class prior) would add,
is kept from going below zero, so that the model cannot win by memorising the positives. The prior is an estimate: the
share of label 1 among all labelled rows that have a word, held to 0.0001 to 0.5. Words are hashed
to 2^20 buckets; those that positives hold far more often than unlabelled texts are the features, as
presence in a text, so that long texts are not judged by their length.

At most `most_positive` and `most_unlabelled` rows (whole texts, drawn fairly by hash; a text with many copies
comes as often as its share of the rows says) are used to fit; every text is scored. Texts without a word have
no features: they take no part in the fit, nor in the prior that it uses.

Edge cases: null or empty text has no features and gets the intercept's score; without any positive that has
a word, every score is the prior's over all rows; a null id counts as the empty text in the split; rows of `labels` that repeat are
counted once per id; texts of any length are read whole, a word counts once; repeated rows are scored one by one and alike; an
empty table gives an empty result; other columns pass through. Added columns: `score`, `predicted`, which replace columns of these names; working columns start
with `__tx_`.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.linear import Rows, fit_nonnegative_pu, sigmoid
from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut, drawn, fair_draw, remainder, replaced
from plumbline.llm.tokens import ALNUM, hash_spans, rows_of, slices, word_spans

BITS = 20
MOST_POSITIVE = 4000
MOST_UNLABELLED = 12000
MOST_FEATURES = 4096
#: A text with a word, as ALNUM has them.
WORDY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def word_buckets(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the word's row."""
    starts, stops, first = word_spans(data, rows, ALNUM)
    return (hash_spans(data, starts, stops) >> np.uint64(64 - BITS)).astype(np.int64), rows_of(first)


@dataclass
class Model:
    """Weight of each bucket's presence, and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        buckets, row = word_buckets(data, rows)
        at = np.flatnonzero(self.weights[buckets])
        once = np.unique(row[at] << BITS | buckets[at])
        return sigmoid(self.intercept + np.bincount(once >> BITS, self.weights[once & ((1 << BITS) - 1)], len(rows) - 1))


def distinct_buckets(text: str):
    """For mapInArrow: each text's distinct buckets, with its `__tx_digest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(text)):
                buckets, row = word_buckets(data, rows)
                once = np.unique(row << BITS | buckets)
                at = np.searchsorted(once >> BITS, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array((once & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("__tx_digest").slice(lo, hi - lo), lists], ["digest", "buckets"])

    return run


def learn(labelled: DataFrame, text: str = "text", toxic: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, digest: str | None = None) -> Model:
    """A model from texts with `toxic` 1, 0 or null: 1 are the positives, and all texts together the unlabelled
    set; 0 and 1 also tell the class prior. `digest` names a column of texts' xxhash64, if there is one: made
    before a join, it saves carrying the texts through."""
    rows = labelled.select(F.col(text).alias("__tx_text"), F.col(toxic).alias("__tx_label"), (F.col(digest) if digest else F.xxhash64(text)).alias("__tx_digest"))
    share = lambda confirmed, known: min(0.5, max(1e-4, confirmed / known)) if known else 1e-4
    votes = F.count("__tx_label").alias("known"), F.count(F.when(F.col("__tx_label") == 1, 1)).alias("confirmed")
    prior = share(*rows.agg(*reversed(votes)).first())
    none = Model(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))))
    rows = rows.filter(F.col("__tx_text").rlike(WORDY))
    counted = cut(rows.groupBy("__tx_digest").agg(F.count(F.lit(1)).alias("n"), *votes))
    known, confirmed = counted.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("confirmed"), F.lit(0))).first()
    if not confirmed:
        return none
    prior = share(confirmed, known)
    positive = fair_draw(counted, "__tx_digest", "confirmed", most_positive)
    unlabelled = fair_draw(counted, "__tx_digest", "n", most_unlabelled)
    found = drawn(rows.select("__tx_text", "__tx_digest"), "__tx_digest", {*positive, *unlabelled}).mapInArrow(distinct_buckets("__tx_text"), "digest long, buckets array<int>").toArrow().combine_chunks()
    lists, digests = found.column("buckets").combine_chunks(), found.column("digest").to_pylist()
    first, index = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)
    turn = np.argsort(digests)  # an order that does not depend on the tasks
    times = lambda draws: [draws.get(digests[i], 0) for i in turn]
    order = np.concatenate([np.repeat(turn, times(unlabelled)), np.repeat(turn, times(positive))])
    n_u, n_p = sum(unlabelled.values()), sum(positive.values())
    is_positive = np.arange(n_u + n_p) >= n_u
    index = np.concatenate([index[first[i] : first[i + 1]] for i in order])
    first = np.concatenate([[0], np.cumsum(np.diff(first)[order])])
    # buckets that positives have more often than chance allows
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    in_p, in_u = np.bincount(index[is_positive[row]], minlength=1 << BITS), np.bincount(index[~is_positive[row]], minlength=1 << BITS)
    p, u = in_p / n_p, in_u / n_u
    both = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (p - u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    lift = (p + 0.5 / n_p) / (u + 0.5 / n_u)
    chosen = np.flatnonzero((z > 4) & (in_p >= 3) & (lift > min(5.0, 0.6 / prior)))
    chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[:MOST_FEATURES]])
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[index] >= 0
    x = Rows(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(first) - 1))]), number[index[keep]], np.ones(int(keep.sum())), len(chosen))
    weights, intercept = fit_nonnegative_pu(x, is_positive, prior)
    out = np.zeros(1 << BITS)
    out[chosen] = weights
    return Model(out, intercept)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` and `predicted`."""
    docs = replaced(docs, "score", "predicted")
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, rows in slices(batch.column(text)):
                out[lo:hi] = model.scores(data, rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])

    return docs.mapInArrow(run, schema)


@query("op10_pu_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumns({"held_out": remainder("doc_id", 5) == 0, "digest": F.xxhash64("text")})
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = learn(docs.filter(~F.col("held_out")).join(labels, "doc_id", "left"), digest="digest")
    return score(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "score", "predicted")
