"""Exact quantiles, average ranks and correlations without a global sort in one task."""

from __future__ import annotations

import math
import sys
from itertools import combinations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import dtypes, numbers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bits of a value that one pass settles, and how many values may be left for a last pass over all of their bits.
_DIGIT_BITS = 16
MAX_LAST_VALUES = 1 << 20
# Rows of a rank table up to which it is broadcast.
MAX_BROADCAST_RANKS = 1 << 17


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN as NULL."""
    return numbers.clean(col(name), df.schema[name].dataType).cast("double")


def ordered_bits(x):
    """Doubles as unsigned 64-bit numbers of the same order (numpy)."""
    import numpy as np

    bits = (x + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def from_ordered_bits(image: int) -> float:
    import struct

    bits = image ^ (1 << 63) if image >> 63 else image ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _digit_counts(slots: list[tuple[int, int]], done: int, width: int):
    """For mapInArrow over double columns: (slot, digit, n). A slot is a column and the first ``done`` bits of its
    values; the digit is the next ``width`` bits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            images, out = {}, []
            for k, (column, prefix) in enumerate(slots):
                if column not in images:
                    values = batch.column(column).drop_null().to_numpy(zero_copy_only=False)
                    images[column] = ordered_bits(values[~np.isnan(values)])
                image = images[column]
                if done:
                    image = image[image >> np.uint64(64 - done) == np.uint64(prefix)]
                rest = image >> np.uint64(64 - done - width)
                digits = (rest & np.uint64((1 << width) - 1)) if done else rest
                if not len(digits):
                    continue
                if width <= _DIGIT_BITS and len(digits) > 1000:
                    n = np.bincount(digits.astype(np.int64), minlength=1)
                    found = np.flatnonzero(n)
                    out.append((k, found, n[found]))
                else:
                    found, n = np.unique(digits, return_counts=True)
                    out.append((k, found.astype(np.int64), n))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([k for k, _, _ in out], [len(d) for _, d, _ in out]).astype(np.int32)), pa.array(np.concatenate([d for _, d, _ in out])), pa.array(np.concatenate([n for _, _, n in out]).astype(np.int64))],
                    ["slot", "digit", "n"],
                )

    return run


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (as pandas computes them), per column.

    Radix selection: values are read as 64-bit numbers of the same order. A pass counts the next 16 bits of
    all values that agree with what is known of a wanted rank so far; the running count picks the digit. All columns
    and ranks share each pass. As soon as at most ``MAX_LAST_VALUES`` values can still be meant, one pass counts all
    of their remaining bits; so there are two passes as a rule and never more than four. Nothing is sampled, no task
    sorts more than 2^16 digits or the last values of a slot, and the driver sees a row per wanted rank.
    """
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not columns or not probs:
        return result
    values = df.select(*[numeric(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    slots, done, left = [(i, 0) for i in range(len(columns))], 0, None
    # of each wanted rank: the column, its number among the column's ranks, the bits known, the rank among values with these bits
    wanted: list[list] = []
    totals: dict[int, int] = {}
    while done < 64:
        width = 64 - done if left is not None and left <= MAX_LAST_VALUES else min(_DIGIT_BITS, 64 - done)
        counted = values.mapInArrow(_digit_counts(slots, done, width), "slot int, digit long, n long").groupBy("slot", "digit").agg(F.sum("n").alias("n"))
        order = F.col("digit") + F.lit(-(1 << 63)) if width == 64 else F.col("digit")
        running = Window.partitionBy("slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        upto = counted.select("slot", "digit", "n", F.sum("n").over(running).alias("upto"), F.sum("n").over(Window.partitionBy("slot")).alias("total"))
        if not done:
            position = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
            ranks = F.array(*[F.struct(F.lit(2 * j + k).alias("id"), f(x).cast("long").alias("rank")) for j, x in enumerate(position) for k, f in enumerate((F.floor, F.ceil))])
        else:
            by_slot: dict[int, list] = {}
            for i, w in enumerate(wanted):
                by_slot.setdefault(slots.index((w[0], w[2])), []).append(F.struct(F.lit(i).alias("id"), F.lit(w[3]).cast("long").alias("rank")))
            ranks = F.element_at(F.create_map(*[x for k, r in by_slot.items() for x in (F.lit(k), F.array(*r))]), F.col("slot"))
        met = F.filter(ranks, lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("n")))
        rows = upto.select("slot", "digit", "n", "total", (F.col("upto") - F.col("n")).alias("before"), F.explode(met).alias("r")).select("*", "r.id", "r.rank").collect()
        if not done:
            wanted = [[r["slot"], r["id"], r["digit"], r["rank"] - r["before"]] for r in rows]
            totals = {r["slot"]: r["total"] for r in rows}
        else:
            for r in rows:
                w = wanted[r["id"]]
                w[2], w[3] = w[2] << width | (r["digit"] & ((1 << width) - 1)), r["rank"] - r["before"]
        done += width
        sizes = {(r["slot"], r["digit"]): r["n"] for r in rows}
        left = sum(sizes.values())
        slots = sorted({(w[0], w[2]) for w in wanted})
        if not slots:
            return result
    at = {(w[0], w[1]): from_ordered_bits(w[2]) for w in wanted}
    for i, name in enumerate(columns):
        for j, p in enumerate(probs):
            if i in totals:
                position = (totals[i] - 1) * float(p)
                lo, hi, part = at[i, 2 * j], at[i, 2 * j + 1], position - math.floor(position)
                result[name][j] = lo if part == 0 else lo + (hi - lo) * part
    return result


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, sample standard deviation, min, max and exact median per numeric column."""
    columns = dtypes.numeric_columns(df) if columns is None else columns
    medians = exact_quantiles(df, columns, [0.5])
    stats = []
    for c in columns:
        v = numeric(df, c)
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"),
                F.lit(medians[c][0]).cast("double").alias("median"), F.count(v).alias("non_null_count"),
            )
        )
    parts = [
        df.agg(F.array(*stats[i : i + 40]).alias("s")).select(F.inline("s")) for i in range(0, len(stats), 40)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def average_ranks(cells: DataFrame, rows: int) -> DataFrame:
    """Average rank (ties share their mean rank) of every distinct value: (column, value, rank, n).

    ``cells`` are (column, value) without NULLs, ``rows`` about the number of one column's cells. Distinct values
    are cut into buckets at sketched boundaries (which only spread the work), numbered inside each bucket,
    and shifted by the counts of the buckets before. No window ever spans a whole column.
    """
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    buckets = int(min(10_000, max(8, rows // 500_000)))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counted.groupBy("column").agg(F.percentile_approx("value", probs, max(1_000, 2 * buckets)).alias("cuts"))
    # at most `buckets` boundaries per column
    placed = counted.join(F.broadcast(cuts), "column").withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("value")))).drop("cuts")
    per_bucket = placed.groupBy("column", "bucket").agg(F.sum("n").alias("bucket_n"))
    before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("column", "bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("upto", F.sum("n").over(within))
        .join(F.broadcast(offsets), ["column", "bucket"])
        .select("column", "value", "n", (F.col("offset") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))
    )


def correlation(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Correlation matrix in long form, one row per ordered pair of columns, pairwise complete."""
    columns = dtypes.numeric_columns(df) if columns is None else columns
    if method == "pearson":
        wide = df.select(*[numeric(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
        names = {(i, j): (f"v{i}", f"v{j}") for i in range(len(columns)) for j in range(i, len(columns))}
    elif method == "spearman":
        wide, names, middle = _rank_table(df, columns)
    else:
        raise ValueError(f"unknown correlation method: {method}")
    # Ranks lie around half the number of rows, so they need no pass for their means.
    shift = None if method == "pearson" else [middle] * len(wide.columns)
    r = pairwise_correlation(wide, shift)
    wanted = df.sparkSession.createDataFrame(
        [(columns[i], columns[j], i, j, a, b) for (i, j), (a, b) in names.items()],
        "column_a string, column_b string, position_a int, position_b int, a string, b string",
    )
    half = wanted.join(F.broadcast(r), ["a", "b"], "left").drop("a", "b")
    mirrored = half.filter("position_a < position_b").select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"),
        F.col("position_b").alias("position_a"), F.col("position_a").alias("position_b"), "correlation",
    )
    return half.unionByName(mirrored)


def pairwise_correlation(wide: DataFrame, shift: list[float] | None = None) -> DataFrame:
    """(a, b, correlation) for all pairs of double columns, over the rows where both have values.

    Every task reduces its rows to one matrix of cross products, around ``shift`` (the means, taken
    beforehand) for accuracy, so a single scan serves all pairs and the shuffle carries a few
    numbers per pair and task.
    """
    names = wide.columns
    if shift is None:
        means = wide.agg(*[F.avg(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in names]).first()
        shift = [means[c] or 0.0 for c in names]

    def products(batches):
        import numpy as np
        import pyarrow as pa

        k = len(names)
        sums = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(k)]) - shift
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m, sq = there.astype("float64"), x * x
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        i, j = np.triu_indices(k)
        flat = [pa.array(np.array(names)[i].tolist()), pa.array(np.array(names)[j].tolist())]
        yield pa.RecordBatch.from_arrays(flat + [pa.array(s[i, j]) for s in sums], ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    parts = wide.mapInArrow(products, "a string, b string, n double, x double, y double, xx double, yy double, xy double")
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    vx, vy = F.expr("xx - x * x / n"), F.expr("yy - y * y / n")
    spread = F.sqrt(vx * vy)
    # A column without spread has no correlation; rounding noise of the sums must not look like some.
    flat = (vx <= F.col("xx") * 1e-14) | (vy <= F.col("yy") * 1e-14)
    r = F.when((F.col("n") > 1) & ~flat, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.expr("xy - x * y / n") / spread)))
    return total.select("a", "b", F.when(~F.isnan(r), r).alias("correlation"))


def _rank_table(df: DataFrame, columns: list[str]):
    """Rows with ranks in place of values, and which rank columns to correlate for each pair.

    Ranks count only rows where both columns of a pair have values. A column's plain ranks serve
    every partner without NULLs; two columns with NULLs get ranks of their own.
    """
    wide = df.select(*[numeric(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    told = wide.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"v{i}").isNull()).alias(f"v{i}") for i in range(len(columns))]).first()
    wanted: dict[str, Column] = {f"v{i}": F.col(f"v{i}") for i in range(len(columns))}
    names: dict[tuple[int, int], tuple[str, str]] = {(i, i): (f"v{i}", f"v{i}") for i in range(len(columns))}
    for i, j in combinations(range(len(columns)), 2):
        a, b = f"v{i}", f"v{j}"
        sides = []
        for own, other in ((a, b), (b, a)):
            if told[other]:
                wanted[f"{own}_{other}"] = F.when(F.col(other).isNotNull(), F.col(own))
            sides.append(f"{own}_{other}" if told[other] else own)
        names[(i, j)] = tuple(sides)
    # one row per cell, of all columns at once; a row's number lets its cells find each other again
    keyed = wide.withColumn("row", F.monotonically_increasing_id())
    cell = F.array(*[F.struct(F.lit(k).alias("column"), e.alias("value")) for k, e in enumerate(wanted.values())])
    cells = keyed.select("row", F.inline(cell)).filter(F.col("value").isNotNull())
    ranks = average_ranks(cells.select("column", "value"), told["rows"])
    # a value that many rows share would crowd a join: there are few of these, and their ranks are broadcast
    often = max(2, told["rows"] * len(wanted) // MAX_BROADCAST_RANKS)
    heavy = ranks.filter(F.col("n") >= often).select("column", "value", F.col("rank").alias("common"))  # MAX_BROADCAST_RANKS rows at most
    light = ranks.filter(F.col("n") < often).select("column", "value", F.col("rank").alias("seldom"))
    marked = cells.join(F.broadcast(heavy), ["column", "value"], "left")
    ranked = marked.filter("common IS NOT NULL").select("row", "column", F.col("common").alias("rank")).unionByName(
        marked.filter("common IS NULL").join(light, ["column", "value"]).select("row", "column", F.col("seldom").alias("rank"))
    )
    out = ranked.groupBy("row").agg(*[F.max(F.when(F.col("column") == k, F.col("rank"))).alias(f"rank_{n}") for k, n in enumerate(wanted)]).drop("row")
    return out, {k: (f"rank_{a}", f"rank_{b}") for k, (a, b) in names.items()}, told["rows"] / 2.0


def high_correlation(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with |r| at or above the threshold, each once, rounded to 3 decimals."""
    return matrix.filter((F.col("position_a") < F.col("position_b")) & (F.abs("correlation") >= threshold)).select(
        "column_a", "column_b", F.round("correlation", 3).alias("correlation")
    )
