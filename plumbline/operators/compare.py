"""Comparing two versions of a table, several tables, and a table with a saved baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import dtypes, numbers
from plumbline.operators.quantiles import col, numeric_summary


def shape_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns of both sides and their differences."""
    a = before.agg(F.count(F.lit(1)).alias("rows_before"))
    b = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return a.crossJoin(b).select(
        "rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("row_delta"),
        F.lit(len(before.columns)).alias("columns_before"), F.lit(len(after.columns)).alias("columns_after"),
        F.lit(len(after.columns) - len(before.columns)).alias("column_delta"),
    )


def _value(df: DataFrame, c: str) -> Column:
    return numbers.clean(col(c), df.schema[c].dataType)


def _common(before: DataFrame, after: DataFrame, key: list[str]) -> list[str]:
    return [c for c in before.columns if c in set(after.columns) and c not in key]


def _aligned(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Both versions side by side: keys, in_a / in_b flags, a0.. and b0.. values."""
    a = before.select(*[col(k).alias(f"k{i}") for i, k in enumerate(key)], F.lit(True).alias("in_a"), *[_value(before, c).alias(f"a{i}") for i, c in enumerate(columns)])
    b = after.select(*[col(k).alias(f"k{i}") for i, k in enumerate(key)], F.lit(True).alias("in_b"), *[_value(after, c).alias(f"b{i}") for i, c in enumerate(columns)])
    return a.join(b, [f"k{i}" for i in range(len(key))], "full_outer")


def _differs(before: DataFrame, after: DataFrame, c: str, i: int) -> Column:
    if before.schema[c].dataType == after.schema[c].dataType:
        return ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
    return ~F.col(f"a{i}").cast("string").eqNullSafe(F.col(f"b{i}").cast("string"))


def modified_cells(before: DataFrame, after: DataFrame, key: list[str], low=None, high=None) -> DataFrame:
    """Changed cells, added and removed rows, matched by key.

    ``low`` / ``high`` restrict the first key column to ``[low, high)``. Two NULLs are equal.
    """
    if low is not None:
        before, after = before.filter(col(key[0]) >= low), after.filter(col(key[0]) >= low)
    if high is not None:
        before, after = before.filter(col(key[0]) < high), after.filter(col(key[0]) < high)
    columns = _common(before, after, key)
    both = F.col("in_a") & F.col("in_b")
    changed = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        changed = changed + F.when(_differs(before, after, c, i), 1).otherwise(0)
    return _aligned(before, after, key, columns).agg(
        F.coalesce(F.sum(F.when(both, changed)), F.lit(0)).cast("bigint").alias("modified_cells"),
        F.count_if(F.col("in_a").isNull()).alias("added_rows"), F.count_if(F.col("in_b").isNull()).alias("removed_rows"),
    )


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row per changed cell, and per cell of added or removed rows: key, column, old, new, status."""
    columns = _common(before, after, key)
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed")
    items = []
    for i, c in enumerate(columns):
        old, new = F.col(f"a{i}").cast("string"), F.col(f"b{i}").cast("string")
        entry = F.struct(F.lit(c).alias("column"), old.alias("old"), new.alias("new"), F.coalesce(status, F.lit("changed")).alias("status"))
        items.append(F.when(status.isNotNull() | _differs(before, after, c, i), entry))
    return _aligned(before, after, key, columns).select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], F.inline(F.array_compact(F.array(*items)))
    )


# --- several tables -------------------------------------------------------------------------


def schema_matrix(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column name, one column per table: its type, or MISSING."""
    spark = next(iter(tables.values())).sparkSession
    names = sorted({c for df in tables.values() for c in df.columns})
    rows = [(c, *[df.schema[c].dataType.simpleString() if c in df.columns else "MISSING" for df in tables.values()]) for c in names]
    return spark.createDataFrame(rows, ", ".join(["column string", *[f"`{t}` string" for t in tables]]))


def _gaps(df: DataFrame, c: str) -> Column:
    return F.count_if(_value(df, c).isNull())


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, missing cells and missing % per table."""
    out = None
    for name, df in tables.items():
        missing = F.lit(0).cast("bigint")
        for c in df.columns:
            missing = missing + _gaps(df, c)
        one = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing_cells")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), "missing_cells",
            F.round(numbers.pct(F.col("missing_cells"), F.col("rows") * len(df.columns)), 2).alias("missing_percentage"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def null_matrix(tables: dict[str, DataFrame]) -> DataFrame:
    """NULL % of every column all tables have, per table."""
    first = next(iter(tables.values()))
    common = sorted(c for c in first.columns if all(c in df.columns for df in tables.values()))
    out = None
    for name, df in tables.items():
        if not common:
            break
        rows = F.count(F.lit(1))
        cells = [
            F.struct(F.lit(c).alias("column"), F.round(_gaps(df, c) * 100.0 / F.greatest(rows, F.lit(1)), 2).alias("null_percentage"))
            for c in common
        ]
        one = df.agg(F.array(*cells).alias("cells")).select(F.lit(name).alias("table"), F.inline("cells"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else first.sparkSession.createDataFrame([], "table string, column string, null_percentage double")


# --- drift ----------------------------------------------------------------------------------


def baseline(df: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per column with what drift detection compares."""
    facts = profile.select(
        "column", "dtype", "null_percentage", "unique_percentage", "unique_count", "risk_score", F.col("total_rows").alias("row_count")
    )
    if not dtypes.numeric_columns(df):
        return facts.withColumns({n: F.lit(None).cast("double") for n in ("mean", "std", "min", "max", "median")})
    return facts.join(F.broadcast(numeric_summary(df).drop("non_null_count")), "column", "left")


def drift(
    current: DataFrame, base: DataFrame, null_threshold: float = 5.0, unique_threshold: float = 10.0, sigmas: float = 2.0
) -> DataFrame:
    """Alerts (column, type, message, baseline, current) between two baselines."""
    keep = ["null_percentage", "unique_percentage", "mean", "std"]
    b = base.select("column", F.lit(True).alias("was"), *[F.col(k).alias("b_" + k) for k in keep])
    c = current.select("column", F.lit(True).alias("now"), *[F.col(k).alias("c_" + k) for k in keep])
    # Both sides have one row per column.
    both = c.join(F.broadcast(b), "column", "left").unionByName(b.join(F.broadcast(c), "column", "left_anti"), allowMissingColumns=True)
    known = F.col("was") & F.col("now")

    def text_of(x: str, pattern: str) -> Column:
        decimals = int(pattern[2])
        return F.format_string(pattern, F.bround(F.col(x), decimals))

    def shifted(kind: str, label: str, name: str, threshold: float) -> Column:
        old, new = F.col("b_" + name), F.col("c_" + name)
        message = F.concat(
            F.lit(f"{label} % shifted from "), text_of("b_" + name, "%.1f"), F.lit("% to "), text_of("c_" + name, "%.1f"), F.lit("%")
        )
        return _alert(known & (F.abs(new - old) > threshold), kind, message, old, new)

    gap = F.abs(F.col("c_mean") - F.col("b_mean"))
    mean_message = F.concat(
        F.lit("Mean shifted from "), text_of("b_mean", "%.2f"), F.lit(" to "), text_of("c_mean", "%.2f"),
        F.lit(" ("), F.format_string("%.1f", F.bround(gap / F.nullif(F.col("b_std"), F.lit(0.0)), 1)), F.lit(" sigma)"),
    )
    none = F.lit(None).cast("double")
    alerts = F.array_compact(F.array(
        _alert(F.col("was").isNull(), "new_column", F.lit("Column not present in baseline"), none, none),
        shifted("null_rate", "Null", "null_percentage", null_threshold),
        shifted("cardinality", "Unique", "unique_percentage", unique_threshold),
        _alert(known & (F.col("b_std") > 0) & (gap > F.col("b_std") * sigmas), "mean_shift", mean_message, F.col("b_mean"), F.col("c_mean")),
        _alert(F.col("now").isNull(), "missing_column", F.lit("Column present in baseline but missing from current data"), none, none),
    ))
    return both.select("column", F.inline(alerts))


def _alert(test: Column, kind: str, message: Column, old: Column, new: Column) -> Column:
    return F.when(test, F.struct(F.lit(kind).alias("type"), message.alias("message"), old.alias("baseline"), new.alias("current")))
