"""Quality classifier (1): a weak-label model of overlapping heuristics, and a hashed linear scorer taught by it.

Ten heuristic labellers vote on every whole text: eight look for a defect (bad or abstain), two for signs of
prose (good or abstain). Expectation maximisation over the counts of vote patterns (2^10 at most, counted
over all texts) estimates how often each votes on good and on bad texts, and the share of good ones, from a
start that weighs as `PSEUDO_TEXTS` texts however many there are, and under a bound on false reports of defects. The
posterior of a text's pattern is its soft label. A logistic scorer on hashed features (shape trigrams of letters, capitals, digits
and marks; whether words repeat the ones before them) is fitted to the posteriors of a bounded sample: at most `most_sample` rows that have a text, drawn fairly by hash (a text with
many copies comes as often as its share of the rows says); it scores every text. A text is kept if the scorer does not call it bad.

Edge cases: null or empty text has no features and is kept, at a score of 0.5 whatever the other rows are;
repeated rows are labelled and scored one by one and alike; texts of any length are read whole, their features
are shares; an empty table gives an empty result; other columns pass through. Added columns: `votes`,
`posterior`, `score`, `keep`, which replace columns of these names; working columns start with `__ql_`.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.linear import fit_logistic, rows_from, sigmoid
from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut, drawn, fair_draw, replaced, small_batches
from plumbline.llm.tokens import NOT_SPACE, hash_spans, mix64, rows_of, slices, sum_by_row, word_spans

DEFECTS = ["marks", "capitals", "lines", "runs", "word_length", "letters", "cells", "echo"]
LABELLERS = [*DEFECTS, "sentences", "prose"]
BITS = 14
MOST_SAMPLE = 6000
#: Where the estimate of the labellers' rates starts: a labeller votes on 30 % of the class that it looks for and on
#: 0.2 % of the other (signs of prose: 90 % and 10 %). It weighs as so many texts of each class.
EXPECTED = np.array([[0.3] * len(DEFECTS) + [0.1] * 2, [0.002] * len(DEFECTS) + [0.9] * 2])
PSEUDO_TEXTS = 50.0
#: A defect labeller speaks on so much of the good class at most (its thresholds are set for that). Without a bound
#: the two classes could change places, or a labeller that stands alone could be taken for noise.
MOST_FALSE = 0.002
#: Score of a text without any byte: nothing speaks against it, and it is kept.
EMPTY_SCORE = 0.5
REJECT_BELOW = 0.5
ADDED = {"votes": T.StringType(), "posterior": T.DoubleType(), "score": T.DoubleType(), "keep": T.BooleanType()}

#: Byte classes of the shape of a text: fixed values.
LETTER, CAPITAL, DIGIT, SPACE, BREAK = 1, 2, 3, 4, 5
SHAPE = np.zeros(256, np.int64)
for _b in range(256):
    SHAPE[_b] = LETTER if 97 <= _b < 123 or _b >= 128 else CAPITAL if 65 <= _b < 91 else DIGIT if 48 <= _b < 58 else BREAK if _b in (10, 13) else SPACE if _b in (9, 11, 12, 32) else 6 + _b % 58
#: Marks that ordinary prose uses freely.
PROSE = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-()?"])


def votes(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Votes of all labellers (columns) on all texts (rows)."""
    n = len(rows) - 1
    starts, stops, first = word_spans(data, rows, NOT_SPACE)
    words = np.diff(first)
    shape = SHAPE[data]
    count = lambda mask: sum_by_row(mask, rows)
    letters, capitals, digits = count(shape == LETTER), count(shape == CAPITAL), count(shape == DIGIT)
    odd = (shape > BREAK) & ~PROSE[data]
    odd[data == ord("|")] = False  # columns of a table
    marks = count(odd)
    twice = odd.copy()
    twice[1:] &= data[1:] == data[:-1]
    twice[:1] = False
    twice[rows[:-1][rows[:-1] < rows[1:]]] = False
    runs = count(twice)
    solid = letters + capitals + digits + count(shape > BREAK)
    w, s = np.maximum(words, 1), np.maximum(solid, 1)
    # repeated words and repeated lines
    pairs = lambda hashes, first: np.bincount((u := np.unique(mix64(hashes ^ mix64(rows_of(first).astype(np.uint64) + np.uint64(7))), return_index=True)[1], rows_of(first)[u])[1], minlength=n)
    hashes = hash_spans(data, starts, stops)
    echo = sum_by_row(echoes(hashes, first) > 0, first)
    line_kind = np.ones(256, bool)
    line_kind[[10, 13]] = False
    line_starts, line_stops, line_first = word_spans(data, rows, line_kind)
    lines, distinct_lines = np.diff(line_first), pairs(hash_spans(data, line_starts, line_stops), line_first)
    repeated = 1 - distinct_lines / np.maximum(lines, 1)
    mean = s / w
    cells = count(data == ord("|"))
    capital = capitals / np.maximum(letters + capitals, 1)
    enough = words >= 10
    ended = sum_by_row(np.isin(data[stops - 1], [ord("."), ord("?")]) if len(stops) else np.zeros(0, bool), first)
    bad = [marks > 0.3 * w, (capital > 0.5) & (words >= 5), (lines >= 4) & (repeated > 0.5), runs > 0.2 * w, enough & ((mean > 25) | (mean < 2)), enough & (letters + capitals < 0.5 * s), enough & (cells > 0.25 * w), enough & (echo > 0.25 * w)]
    plain = (cells < 0.02 * w) & (echo < 0.1 * w)
    good = [plain & (words >= 20) & (ended > 0.02 * w) & (ended < 0.4 * w), plain & (words >= 5) & (marks < 0.05 * w) & (capital < 0.2) & (mean > 3) & (mean < 12)]
    return np.stack([-x.astype(np.int8) for x in bad] + [x.astype(np.int8) for x in good], 1)


def echoes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 where a word is the one before it in its text, 2 where it is the one before that, else 0."""
    out = np.zeros(len(hashes), np.int64)
    row = rows_of(first)
    for k in (2, 1):
        same = (hashes[k:] == hashes[:-k]) & (row[k:] == row[:-k]) if k < len(hashes) else np.zeros(0, bool)
        out[k:][same] = k
    return out


def em(patterns: np.ndarray, n: np.ndarray, rounds: int = 500, pseudo: float = PSEUDO_TEXTS) -> tuple[np.ndarray, np.ndarray]:
    """Probability that a text with each pattern is good, and the estimated share of each class (rows: bad, good) on which
    each labeller votes: a mixture of two classes in which labellers are independent. No defect is reported for more
    than MOST_FALSE of the good class. The estimate starts from the
    rates of EXPECTED, which weigh as `pseudo` texts of each class however many texts there are; so the counts decide
    as soon as there are many. That no defect is found speaks for a text; that no prose is found does not speak against
    it, as short texts and lists show none."""
    spoke = (patterns != 0).astype(float)  # pattern, labeller
    defect = np.arange(len(LABELLERS)) < len(DEFECTS)
    good = np.where((patterns < 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])  # class, pattern
        share = (weight.sum(1) + 1) / (weight.sum() + 2)
        says = (weight @ spoke + pseudo * EXPECTED) / (weight.sum(1, keepdims=True) + pseudo)
        says[1, defect] = np.minimum(says[1, defect], MOST_FALSE)
        logs = np.log(share)[:, None] + np.log(says) @ spoke.T + (np.log1p(-says) * defect) @ (1 - spoke).T
        now = sigmoid(logs[1] - logs[0])
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return good, says


def buckets_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the shape trigrams (each byte and the two before it in its text; 0 before the start) and of
    the words' echoes, each with the rows' first entries."""
    shape = SHAPE[data]
    code = shape.copy()
    for k in (1, 2):
        back = np.zeros(len(shape), np.int64)
        back[k:] = shape[:-k] if k < len(shape) else back[k:]
        for j in range(k):
            at = rows[:-1] + j
            back[at[at < rows[1:]]] = 0
        code |= back << (6 * k)
    starts, stops, first = word_spans(data, rows, NOT_SPACE)
    echo = echoes(hash_spans(data, starts, stops), first)
    back = np.zeros(len(echo), np.int64)
    back[1:] = echo[:-1]
    bucket = lambda x: (mix64(x.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
    return bucket(code), rows, bucket((1 << 20) + 3 * echo + back), first


@dataclass
class Model:
    """Posterior of each vote pattern, the scorer's weights and intercept, and the estimated rates (class, labeller)."""

    posteriors: dict[str, float]
    weights: np.ndarray
    intercept: float
    rates: np.ndarray | None = None

    def scores(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        shapes, rows, words, first = buckets_of(data, rows)
        mean = lambda x, at: sum_by_row(self.weights[x], at) / np.maximum(np.diff(at), 1)
        out = sigmoid(self.intercept + mean(shapes, rows) + mean(words, first))
        return np.where(np.diff(rows) > 0, out, EMPTY_SCORE)


def names_of(v: np.ndarray) -> np.ndarray:
    """Vote patterns as texts of -, 0 and +."""
    return np.array(["-", "0", "+"], "U1")[v + 1].view(f"U{v.shape[1]}").reshape(-1) if len(v) else np.zeros(0, "U1")


def label(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `votes`."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [names_of(votes(data, rows)) for _, _, data, rows in slices(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.concatenate(names) if names else [], pa.string())], [*columns, "votes"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("votes", T.StringType())]))


def features(text: str):
    """For mapInArrow: shares of a text's buckets among its trigrams and among its words, with its votes. Both in one step:
    each Python step of a task has a process of its own, which stays in memory for the steps to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(text)):
                names = names_of(votes(data, rows))
                shapes, rows, words, first = buckets_of(data, rows)
                key, at = np.unique(np.concatenate([rows_of(rows) << BITS | shapes, rows_of(first) << BITS | words]), return_inverse=True)
                each = np.concatenate([np.repeat(1 / np.maximum(np.diff(x), 1), np.diff(x)) for x in (rows, first)])
                share = np.bincount(at, each, len(key)).astype(np.float32)
                begin = np.searchsorted(key >> BITS, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(x)) for x in ((key & ((1 << BITS) - 1)).astype(np.int32), share)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("__ql_digest").slice(lo, hi - lo), *lists], ["votes", "digest", "buckets", "shares"])

    return run


def described(sample: DataFrame) -> DataFrame:
    """votes, digest, buckets and shares of the texts drawn (`__ql_text`, `__ql_digest`)."""
    return sample.mapInArrow(features("__ql_text"), "votes string, digest long, buckets array<int>, shares array<float>")


def learn(docs: DataFrame, text: str = "text", most_sample: int = MOST_SAMPLE) -> Model:
    """Label model over all texts, scorer from a sample."""
    texts = docs.select(F.col(text).alias("__ql_text"))
    counted = label(texts, "__ql_text").groupBy("votes").count().collect()  # at most 2^10 rows
    counted.sort()
    total = sum(r[1] for r in counted)
    if not total:
        return Model({}, np.zeros(1 << BITS), 0.0)
    patterns = np.array([["-0+".index(c) - 1 for c in r[0]] for r in counted])
    good, rates = em(patterns, np.array([r[1] for r in counted], float))
    posterior = dict(zip((r[0] for r in counted), good.tolist()))
    filled = texts.filter(F.length("__ql_text") > 0).withColumn("__ql_digest", F.xxhash64("__ql_text"))  # an empty text has no features
    draws = fair_draw(cut(filled.groupBy("__ql_digest").agg(F.count(F.lit(1)).alias("n"))), "__ql_digest", "n", most_sample)
    sample = described(drawn(filled, "__ql_digest", draws))
    found = [r for r in sorted(sample.toArrow().to_pylist(), key=lambda r: r["digest"]) for _ in range(draws[r["digest"]])]
    goal = np.array([posterior[r["votes"]] for r in found])
    if not 0.5 < goal.sum() < len(goal) - 0.5:  # one class only: nothing to tell apart
        share = float(np.clip(goal.mean() if len(goal) else 0.5, 1e-3, 1 - 1e-3))
        return Model(posterior, np.zeros(1 << BITS), float(np.log(share / (1 - share))), rates)
    scale = 20.0  # shares are small numbers
    x = rows_from([(r["buckets"], np.array(r["shares"]) * scale) for r in found], 1 << BITS)
    weights, intercept = fit_logistic(x, goal)
    return Model(posterior, weights * scale, intercept, rates)


def classify(docs: DataFrame, model: Model | None = None, text: str = "text", reject_below: float = REJECT_BELOW, prefix: str = "") -> DataFrame:
    """docs with votes, posterior, score and keep (with prefix before the names); such columns of docs are replaced."""
    docs = replaced(docs, *(prefix + c for c in ADDED))
    small_batches(docs.sparkSession)
    shared, columns = docs.sparkSession.sparkContext.broadcast(model or learn(docs, text)), docs.columns
    added = [T.StructField(prefix + c, kind) for c, kind in ADDED.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, score = [], np.zeros(batch.num_rows)
            for lo, hi, data, rows in slices(batch.column(text)):
                names += names_of(votes(data, rows)).tolist()
                score[lo:hi] = model.scores(data, rows)
            posterior = [model.posteriors.get(x) for x in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(posterior, pa.float64()), pa.array(score), pa.array(score >= reject_below)], [*columns, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def reject(docs: DataFrame, **options) -> DataFrame:
    """The documents that the scorer keeps; docs' columns."""
    return classify(docs, prefix="__ql_", **options).filter("__ql_keep").select(*docs.columns)


@query("op1_weak_label_quality")
def _(spark, sf):
    return classify(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "votes", "posterior", "score", "keep")
