"""Text similarity scores and accent stripping: the few things Spark has no built-in for.

These are Arrow-batched pandas UDFs. They are pickled by value, so executors need no copy of this
package.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from plumbline.functions import phonetic, text

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def without_accents(s: pd.Series) -> pd.Series:
    def strip(v):
        if v is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", v) if unicodedata.category(ch) != "Mn")

    return s.map(strip)


def character_name(s: pd.Series) -> pd.Series:
    return s.map(lambda ch: unicodedata.name(ch, "UNKNOWN") if ch is not None and len(ch) == 1 else "UNKNOWN")


def common_subsequence(a: str, b: str, need: float = 0) -> int:
    """Length of the longest common subsequence; -1 as soon as it cannot reach ``need``.

    One step per character of ``b``, on all of ``a`` at once.
    """
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for j, ch in enumerate(b, 1):
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
        if need and j % 64 == 0 and len(a) - row.bit_count() + len(b) - j < need:
            return -1
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0 or a == b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / total


def indel_reaches(a: str, b: str, threshold: float, counts: dict[str, Counter]) -> bool:
    """Whether ``indel`` is at least the threshold; cheap bounds on length and letters go first."""
    if a == b:
        return True
    need = (len(a) + len(b)) * threshold / 200.0 - 1e-9
    if min(len(a), len(b)) < need:
        return False
    for t in (a, b):
        if t not in counts:
            counts[t] = Counter(t)
    if (counts[a] & counts[b]).total() < need:
        return False
    return indel(a, b) >= threshold if len(b) < 128 else 200.0 * common_subsequence(a, b, need) / (len(a) + len(b)) >= threshold


WORD = 64  # characters of a text that one machine word stands for


class Texts:
    """Some texts as arrays, so that one text is compared with all of them at once. Texts of more than WORD characters
    have only their counts of letters here."""

    def __init__(self, texts: list[str]):
        self.texts, self.n = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.repeat(np.arange(len(texts)), self.n)
        self.letters, codes = np.unique(flat, return_inverse=True)
        x = self.letters.astype(np.int64)
        kinds = np.select([(x >= 97) & (x < 123), (x >= 48) & (x < 58), x == 32], [x - 97, x - 22, 36], 37 + x % 27)
        counts = np.bincount(own * 64 + kinds[codes], minlength=64 * len(texts)).reshape(-1, 64)
        # counts of 64 kinds of letters in unary, four bits each, and how many letters are beyond four
        unary = np.array([0, 1, 3, 7, 15], np.uint64)[np.minimum(counts, 4)] << (4 * (np.arange(64, dtype=np.uint64) % np.uint64(16)))
        self.bits = [np.bitwise_or.reduce(unary[:, 16 * w : 16 * w + 16], axis=1) for w in range(4)]
        self.more = np.maximum(counts - 4, 0).sum(axis=1)
        place = np.arange(len(flat)) - (np.cumsum(self.n) - self.n)[own]
        short = self.n[own] <= WORD
        self.codes = np.zeros((min(WORD, int(self.n.max(initial=0))), len(texts)), np.int32)
        self.codes[place[short], own[short]] = codes[short] + 1

    def take(self, rows: np.ndarray) -> Texts:
        """Some of the texts."""
        out = Texts.__new__(Texts)
        out.texts, out.letters, out.n, out.more = [self.texts[i] for i in rows.tolist()], self.letters, self.n[rows], self.more[rows]
        out.bits, out.codes = [b[rows] for b in self.bits], self.codes[:, rows]
        return out

    def reaching(self, other: Texts, k: int, threshold: float) -> np.ndarray:
        """Rows whose ``indel`` with text k of others is at least the threshold, as ``indel_reaches`` says."""
        t, m = other.texts[k], len(other.texts[k])
        both = sum((np.bitwise_count(b & o[k]) for b, o in zip(self.bits, other.bits)), np.minimum(self.more, other.more[k]))
        rows = np.flatnonzero(both >= (self.n + m) * threshold / 200.0 - 1e-6)
        if m > WORD:
            counts: dict[str, Counter] = {}
            return np.array([i for i in rows.tolist() if indel_reaches(t, self.texts[i], threshold, counts)], np.int64)
        long = rows[self.n[rows] > WORD]
        rows = rows[self.n[rows] <= WORD]
        places = np.zeros(len(self.letters) + 1, np.uint64)
        for i, ch in enumerate(t):
            at = int(np.searchsorted(self.letters, ord(ch)))
            if at < len(self.letters) and self.letters[at] == ord(ch):
                places[at + 1] |= np.uint64(1 << i)
        # the steps of common_subsequence on all rows; what runs over the pattern's bits never comes back
        row = np.full(len(rows), (1 << WORD) - 1, np.uint64)
        for codes in self.codes[: int(self.n[rows].max(initial=0)), rows]:
            hit = row & places[codes]
            row = (row + hit) | (row - hit)
        common = m - np.bitwise_count(row & np.uint64((1 << m) - 1)).astype(np.int64)
        total = self.n[rows] + m
        rows = rows[np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0) >= threshold]
        if len(long):
            counts = {}
            rows = np.concatenate([rows, np.array([i for i in long.tolist() if indel_reaches(t, self.texts[i], threshold, counts)], np.int64)])
        return rows


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 100.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    hits_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hits_a.append(ch)
                break
    if not hits_a:
        return 0.0
    hits_b = [ch for ch, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b)) // 2
    m = len(hits_a)
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if score > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        score += prefix * 0.1 * (1 - score)
    return score * 100.0


def sequence_matcher(a: str, b: str) -> float:
    import difflib

    return difflib.SequenceMatcher(None, a, b).ratio() * 100.0


def _pairwise(score):
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return scores


_SCORES = {"ratio": indel, "difflib": sequence_matcher, "jaro_winkler": jaro_winkler}


def score(algorithm: str, a: Column, b: Column) -> Column:
    """Similarity 0-100 of two texts (D05-D09): ratio, difflib, jaro_winkler, phonetic, combined.

    ``difflib`` depends on the order of its arguments: give the earlier row first.
    """
    if algorithm == "phonetic":
        return phonetic.graded(phonetic.keys(a), phonetic.keys(b))
    if algorithm == "combined":
        return score("ratio", a, b) * 0.4 + score("jaro_winkler", a, b) * 0.4 + score("phonetic", a, b) * 0.2
    if algorithm not in _SCORES:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return F.pandas_udf(_pairwise(_SCORES[algorithm]), T.DoubleType())(a, b)


def reaches(algorithm: str, a: Column, b: Column, threshold: float) -> Column:
    """``score(...) >= threshold``, without computing scores that cannot get there."""
    if algorithm != "ratio":
        return score(algorithm, a, b) >= threshold

    def enough(x: pd.Series, y: pd.Series) -> pd.Series:
        counts: dict[str, Counter] = {}
        return pd.Series([indel_reaches(s, t, threshold, counts) for s, t in zip(x, y)], dtype="bool")

    return F.pandas_udf(enough, T.BooleanType())(a, b)


def strip_accents(c: Column) -> Column:
    """é -> e. Only texts outside ASCII are handed to Python; for others the Arrow batches carry NULL."""
    wide = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(F.pandas_udf(without_accents, T.StringType())(wide), c)


def unicode_name(c: Column) -> Column:
    return F.pandas_udf(character_name, T.StringType())(c)


def normalize(c: Column) -> Column:
    """Lower case, no punctuation, single spaces, no accents."""
    plain = F.regexp_replace(text.strip(F.lower(c)), rf"[^\p{{L}}\p{{N}}_{text.SPACE_CLASS}]", "")
    return strip_accents(text.collapse_spaces(plain))
