"""Embedding whitening (13): an incremental eigendecomposition of the covariance, and whitened coordinates.

Entries become whole numbers, x = floor(64 c) + 1000000; the distinct vectors are the fit list.

1. Tasks take the fit list in blocks. A block is turned by an orthogonal map (which leaves its scatter as it is)
   so that all but d of its rows vanish. Each row that is left enters the task's spectrum by a rank-one update, as
   does the shift between the means of the block and of what the task has seen. With `block_rows` = 1 every vector
   enters by itself.
2. A rank-one update D + z z' solves the secular equation between the poles, by bisection of all roots at once
   from the nearer pole. Zero weights and equal poles are deflated before; vectors come from the weights that
   the found roots fit exactly, so they stay orthogonal.
3. Spectra of tasks are combined in groups of `FAN_IN`, again by rank-one updates: the values and vectors of one
   enter the other, then the shift of the means.
4. A pass over the fit list projects the centred vectors on the basis found (Rayleigh-Ritz); the eigenvectors of the
   small matrix of these projections correct the basis to double precision.

Counts, sums and deviations are exact whole numbers. Only matrices of the dimension travel to the driver.

Edge cases: vectors that are null or hold null or non-finite entries are dropped, as are vectors of another
length than the most common one (the longer of two equally common) and empty ones; entries are held to
2^50 in size; repeated rows count once in the fit and each get their results; a null id is kept; a component
without variance has null coordinates; an empty table gives an empty result. A deviation beyond 64 bits is null.
Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut

SCALE, SHIFT, LIMIT = 64.0, 1_000_000, float(1 << 50)
COMPONENTS = 16
BLOCK_ROWS = 4096
FAN_IN = 8
HALVINGS = 70
#: Relative size below which a weight or a gap between poles is deflated.
SMALL = 1e-15
#: Share of the trace below which a component has no variance.
NO_VARIANCE = 1e-13


def secular(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of 1 + sum z^2 / (pole - root) = 0 for ascending, distinct poles and weights that are not 0: the index
    of each root's nearer pole, the distance from it, and the differences root - pole (rows: roots)."""
    k = len(poles)
    square = z * z
    upper = np.append(poles[1:], poles[-1] + square.sum())
    gap = upper - poles
    middle = 1 + (square / (poles[None, :] - (poles + gap / 2)[:, None])).sum(1)
    near = np.arange(k) + ((middle < 0) & (np.arange(k) < k - 1))  # the function grows from one pole to the next
    delta = poles[None, :] - poles[near][:, None]
    right = near == np.arange(k)
    lo, hi = np.where(right, 0.0, -gap / 2), np.where(right, np.where(np.arange(k) < k - 1, gap / 2, gap), 0.0)
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            below = 1 + (square / (delta - mid[:, None])).sum(1) < 0
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    mu = np.where(right, hi, lo)  # never the pole itself
    return near, mu, mu[:, None] - delta


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors (columns) of basis diag(values) basis' + v v'."""
    z = basis.T @ v
    size = max(abs(values[-1]), float(z @ z))
    if size == 0.0 or not z.any():
        return values, basis
    # equal poles: turn their vectors so that one takes the whole weight
    close = np.flatnonzero(np.diff(values) <= SMALL * size * 8)
    if len(close):
        basis = basis.copy()
        for i in close:
            r = np.hypot(z[i], z[i + 1])
            if r:
                c, s = z[i + 1] / r, z[i] / r
                basis[:, [i, i + 1]] = basis[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
                z[i], z[i + 1] = 0.0, r
    live = np.flatnonzero(np.abs(z) > SMALL * np.sqrt(size))
    if not len(live):
        return values, basis
    poles, weights = values[live], z[live]
    rising = np.maximum.accumulate(poles)
    for i in np.flatnonzero(np.diff(rising) <= 0):  # rounding left two alike that both weigh
        rising[i + 1] = np.nextafter(rising[i], np.inf)
    _, _, apart = secular(rising, weights)  # root i - pole j
    # weights that have exactly these roots
    gaps = rising[:, None] - rising[None, :]
    np.fill_diagonal(gaps, 1.0)
    fraction = -apart.T / np.where(np.eye(len(live), dtype=bool), -1.0, gaps)  # row j: (pole j - root i) / (pole j - pole i)
    fitted = np.sqrt(np.abs(np.prod(fraction, 1))) * np.sign(weights)
    vectors = fitted[:, None] / -apart.T
    vectors /= np.sqrt((vectors * vectors).sum(0))
    values, basis = values.copy(), basis.copy()
    values[live] = rising + np.diagonal(apart)
    basis[:, live] = basis[:, live] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Number, mean, and eigenvalues and vectors of the scatter (sum of centred squares) of vectors."""

    def __init__(self, d: int, n: int = 0, mean=None, values=None, basis=None):
        self.n = n
        self.mean = np.zeros(d) if mean is None else np.array(mean, float)
        self.values = np.zeros(d) if values is None else np.array(values, float)
        self.basis = np.eye(d) if basis is None else np.array(basis, float).reshape(d, d)

    def _take(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Add n vectors of a mean, whose centred squares are those of rows."""
        shift = (mean - self.mean) * np.sqrt(self.n * n / (self.n + n))
        for v in (*rows, shift):
            self.values, self.basis = rank_one(self.values, self.basis, v)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n
        self.basis, r = np.linalg.qr(self.basis)  # rounding does not add up
        self.basis *= np.sign(np.diagonal(r))

    def add(self, x: np.ndarray) -> None:
        """Add the rows of x, centred on their mean, after an orthogonal map that leaves d of them."""
        mean = x.mean(0)
        rows = x - mean
        if len(rows) > x.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        self._take(len(x), mean, rows if len(x) > 1 else rows[:0])

    def merge(self, other: Spectrum) -> None:
        if other.n:
            self._take(other.n, other.mean, (other.basis * np.sqrt(np.maximum(other.values, 0.0))).T)


def whole(column: pa.Array) -> tuple[np.ndarray, list[bytes | None]]:
    """Length of each vector (0 if it is to be dropped) and the bytes of its whole numbers."""
    sizes, packed = np.zeros(len(column), np.int64), [None] * len(column)
    entries = column.flatten().cast(pa.float64())
    ok = np.isfinite(entries.to_numpy(zero_copy_only=False)) & np.asarray(entries.is_valid())
    c = np.nan_to_num(entries.fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0)
    x = np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT
    good = np.concatenate([[0], np.cumsum(ok)])
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        if b > a and good[b] - good[a] == b - a:
            sizes[i], packed[i] = b - a, x[a:b].tobytes()
    return sizes, packed


def to_whole(vector: str):
    """For mapInArrow: id and packed vector of the rows that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, packed = whole(batch.column(vector))
            keep = pa.array(sizes > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), pa.array(packed, pa.binary()).filter(keep), pa.array(sizes.astype(np.int32)).filter(keep)], ["id", "x", "d"])

    return run


def vectors_of(column: pa.Array, d: int) -> np.ndarray:
    """The whole numbers of packed vectors, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def sums_of(d: int):
    """For mapInArrow: number of vectors and exact sums, high and low halves apart so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = vectors_of(batch.column("x"), d)
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    return run


SPECTRUM = "part long, n long, mean array<double>, vals array<double>, basis array<double>"


def spectra(d: int, block_rows: int):
    """For mapInArrow: one task's spectrum. Vectors are taken from an origin near them, so that squares stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, rest = Spectrum(d), np.zeros((0, d))
        for batch in batches:
            rest = np.concatenate([rest, (vectors_of(batch.column("x"), d) - SHIFT).astype(float)])
            while len(rest) >= block_rows:
                out.add(rest[:block_rows])
                rest = rest[block_rows:]
        if len(rest):
            out.add(rest)
        if out.n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.n]), *(pa.array([a.reshape(-1).tolist()], pa.list_(pa.float64())) for a in (out.mean, out.values, out.basis))], ["part", "n", "mean", "vals", "basis"])

    return run


def combine(rows: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: one spectrum of a few."""
    rows = rows.sort_values("part")
    d = len(rows["mean"].iloc[0])
    out = Spectrum(d)
    for r in rows.itertuples():
        other = Spectrum(d, r.n, r.mean, r.vals, r.basis)
        if out.n:
            out.merge(other)
        else:
            out = other
    return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN_IN], "n": [out.n], "mean": [out.mean], "vals": [out.values], "basis": [out.basis.reshape(-1)]})


class Fit:
    """What the fit list says. `axes` (rows) and `values` are the leading eigenvectors and values of its covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.axes, self.trace = n, sums, values, axes, trace
        self.whole, self.small = [s // n for s in sums], np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off exactly."""
        return (x - np.array(self.whole)).astype(float) - self.small

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact."""
        far = max((int(np.abs(x - np.array(self.whole)).max()) + 1) * self.n if x.size else 0, 1)
        if far * far * max(1, x.shape[1]) < 1 << 63:
            rest = np.array([s % self.n for s in self.sums])
            return ((self.n * (x - np.array(self.whole)) - rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates on the axes, over the root of their variance; NaN without variance."""
        has = self.values > NO_VARIANCE * max(self.trace, 0.0)
        scale = np.where(has, 1 / np.sqrt(np.where(has, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.axes.T * scale


def matrix(fit: DataFrame, d: int, of) -> np.ndarray:
    """Sum over the fit list of y' y for y = of(x), put together by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = of(vectors_of(batch.column("x"), d))
            total = (0 if total is None else total) + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((i.max() + 1, j.max() + 1))
    out[i, j] = v
    return out


def learn(rows: DataFrame, d: int, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> tuple[Fit | None, float]:
    """The fit of packed vectors x of d entries, and the largest error of the whitened covariance."""
    fit = cut(rows.select("x").distinct())
    told = sorted(fit.mapInArrow(sums_of(d), "i int, n long, high long, low long").groupBy("i").agg(F.sum("n"), F.sum("high"), F.sum("low")).collect())
    if not told:
        return None, 0.0
    n, sums = told[0][1], [(r[2] << 26) + r[3] for r in told]
    found = cut(fit.mapInArrow(spectra(d, block_rows), SPECTRUM))
    while found.count() > 1:
        found = cut(found.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(combine, SPECTRUM))
    basis = np.array(found.first()["basis"]).reshape(d, d)
    start = Fit(n, sums, np.ones(d), basis.T, 0.0)
    values, turn = np.linalg.eigh(matrix(fit, d, lambda x: start.centred(x) @ basis) / n)
    first = np.argsort(-values, kind="stable")[:components]
    axes = (basis @ turn)[:, first].T
    model = Fit(n, sums, values[first], axes / np.linalg.norm(axes, axis=1)[:, None], float(values.sum()))
    errors = np.abs(matrix(fit, d, lambda x: np.nan_to_num(model.whitened(x))) / n - np.diag((model.values > NO_VARIANCE * model.trace).astype(float)))
    return model, float(errors.max())


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per vector that stays and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    slim = embeddings.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    kind = slim.schema["id"].dataType
    rows = slim.filter("v is not null").mapInArrow(to_whole("v"), T.StructType([T.StructField("id", kind), T.StructField("x", T.BinaryType()), T.StructField("d", T.IntegerType())]))
    sizes = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes[0] if sizes else 0
    rows = rows.filter(F.col("d") == d)
    model, error = learn(rows, d, components, block_rows) if d else (None, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values) if model else 0
        share = model.values / model.trace if k and model.trace > 0 else np.zeros(k)
        for batch in batches:
            for lo in range(0, batch.num_rows if k else 0, 4096):
                part = batch.slice(lo, 4096)
                x, own = vectors_of(part.column("x"), d), pa.array(np.repeat(np.arange(part.num_rows), k))
                w = model.whitened(x).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(w), model.n)), pa.array(model.deviations(x), pa.int64()).take(own), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(np.maximum(share, 0.0), len(x))), pa.array(np.full(len(w), error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    fields = [T.StructField(key, kind), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields]
    return rows.mapInArrow(run, T.StructType(fields))


@query("op13_embedding_whitening")
def _(spark, sf):
    return whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
