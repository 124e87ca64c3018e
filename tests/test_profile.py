import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile as P, quality as K, quantiles as Q


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(1, 5, 1.0), (2, 5, 2.0), (3, -1, float("nan")), (4, 0, None), (5, 7, 4.0), (6, None, 1000.0), (7, 7, 3.0), (8, 6, 2.5)]
    return spark.createDataFrame(rows, "rid bigint, i int, d double")


def test_counts_and_outliers(numbers):
    rows = {r["column"]: r for r in P.profile(numbers, samples=False).collect()}
    assert (rows["d"]["null_count"], rows["d"]["unique_count"]) == (2, 6)  # NaN counts as missing
    assert rows["d"]["outlier_count"] == 1 and rows["d"]["outlier_samples"] == [1000.0]
    assert (rows["i"]["negative_count"], rows["i"]["zero_count"]) == (1, 1)
    assert rows["rid"]["suggestions"] == ["Primary key candidate"]


def test_fast_profile_agrees_on_small_data(numbers):
    keys = ["column", "total_rows", "null_count", "unique_count", "risk_level"]
    assert P.profile(numbers, fast=True, samples=False).select(keys).orderBy("column").collect() == P.profile(numbers, samples=False).select(keys).orderBy("column").collect()


def test_text_profile(spark):
    long = "x" * 300
    rows = [("a@b.co",), ("A  B",), ("",), ("  ",), (None,), ("it's__ok",), (long,), (long,), ("2024-01-01",)]
    p = P.profile(spark.createDataFrame(rows, "t string"), samples=False).first()
    assert (p["null_count"], p["empty_string_count"], p["whitespace_only_count"], p["total_missing"]) == (1, 1, 1, 3)
    assert p["unique_count"] == 7 and p["max_length"] == 300 and p["out_of_bounds_count"] == 3
    special = {s["key"]: s["count"] for s in p["special_chars"]}
    assert special == {"@": 1, ".": 1, "multiple_spaces": 2, "'": 1, "multiple_underscores": 1}
    assert p["pattern_counts"] == {"Email": 1, "Phone": 1, "Date": 1}
    assert p["pattern_examples"]["Email"] == "a@b.co"


def test_empty_table_keeps_its_columns(spark):
    rows = P.profile(spark.createDataFrame([], "a int, b string")).collect()
    assert sorted(r["column"] for r in rows) == ["a", "b"] and all(r["total_rows"] == 0 for r in rows)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x")], "`a.b` int, `my col` string")
    assert sorted(r["column"] for r in P.profile(df).collect()) == ["a.b", "my col"]


def test_future_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2030, 1, 1),), (dt.datetime(2020, 1, 1),)], "ts timestamp")
    p = P.profile(df, as_of=dt.datetime(2025, 1, 1), samples=False).first()
    assert p["future_count"] == 1 and "Future dates" in p["business_rule_violations"][0]


@pytest.mark.parametrize("rows", [1, 2, 999, 3000])
def test_exact_quantiles(spark, rows, monkeypatch):
    import numpy as np

    monkeypatch.setattr(Q, "MAX_LAST_VALUES", 200)
    df = spark.range(rows).select(F.pow((F.col("id") * 7919) % 1009, 1.5).alias("x"), F.lit(3).alias("same"))
    got = Q.exact_quantiles(df, ["x", "same"], [0.0, 0.25, 0.5, 0.75, 1.0])
    values = [r[0] for r in df.select("x").collect()]
    assert got["x"] == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])))
    assert got["same"] == [3.0] * 5


@pytest.mark.parametrize("last", [0, 5, 1 << 20])
def test_quantiles_of_odd_values(spark, monkeypatch, last):
    monkeypatch.setattr(Q, "MAX_LAST_VALUES", last)
    data = [-0.0, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 3.0, 3.0, 3.0000000000000004, None, float("nan"), -2.5]
    df = spark.createDataFrame([(x, None, None if x != 3.0 else 7) for x in data], "x double, none double, n int")
    got = Q.exact_quantiles(df, ["x", "none", "n"], [0.0, 0.25, 0.5, 1.0])
    real = sorted(x for x in data if x is not None and x == x)
    assert got["x"] == [real[0], (real[2] + real[3]) / 2 if (len(real) - 1) % 4 == 2 else real[(len(real) - 1) // 4] + (real[(len(real) - 1) // 4 + 1] - real[(len(real) - 1) // 4]) * ((len(real) - 1) * 0.25 % 1), (real[5] + real[6]) / 2 if len(real) % 2 == 0 else real[len(real) // 2], real[-1]]
    assert got["none"] == [None] * 4 and got["n"] == [7.0] * 4
    assert Q.exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_spearman_has_a_fixed_number_of_joins(spark):
    def joins(n):
        df = spark.range(60).select(*[F.when((F.col("id") + k) % 7 > 0, (F.col("id") * (k + 3)) % 11).cast("double").alias(f"c{k}") for k in range(n)])
        return Q._rank_table(df, df.columns)[0]._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(2) == joins(5)


def test_correlations_match_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 400).astype(float), "b": rng.normal(size=400), "c": 1.0})
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "a"] = None
    pdf.loc[::5, "b"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double")
    for method, want in (("pearson", pdf.corr()), ("spearman", pdf.rank().corr() * 0 + pdf.corr("pearson"))):
        got = {(r["column_a"], r["column_b"]): r["correlation"] for r in Q.correlation(df, method=method).collect()}
        assert got["c", "a"] is None and got["a", "a"] == pytest.approx(1.0)
        if method == "pearson":
            assert got["a", "b"] == pytest.approx(want.loc["a", "b"])
        else:
            both = pdf.dropna()
            assert got["a", "b"] == pytest.approx(both["a"].rank().corr(both["b"].rank()))


def test_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, None), (None, None)], "k int, v string")
    r = K.report(df).first()
    assert (r["total_cells"], r["missing_cells"], r["exact_duplicate_rows"]) == (10, 5, 1)
    assert r["columns_with_issues"] == ["k", "v"]
    assert r["overall_score"] == pytest.approx(100 - 25 - 10 - 20)
