import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from plumbline.functions import numbers as N
from plumbline.operators import apply as A, clean as C, compare as M, profile as P, quantiles, rules as R, validate as V

AS_OF = dt.datetime(2024, 6, 1)


def test_metadata(spark):
    rows = [("Name* VARCHAR2(30)", None), ("Amount", "NUMBER(10,2), max length 12"), ("Code (19)", "VARCHAR(5) or CHAR(7)"), ("Flag", "Y/N in upper case caps")]
    m = {r["column"]: r for r in R.metadata(spark.createDataFrame(rows, "column string, rule_text string")).collect()}
    assert m["Name* VARCHAR2(30)"]["mandatory"] and m["Name* VARCHAR2(30)"]["max_length"] == 30
    assert (m["Amount"]["precision"], m["Amount"]["scale"], m["Amount"]["max_length"], m["Amount"]["data_type_hint"]) == (10, 2, 12, "NUMBER")
    assert m["Code (19)"]["conflict_flag"] and m["Code (19)"]["max_length"] == 7
    assert m["Flag"]["allowed_values"] == ["Yes", "No"] and m["Flag"]["format_restrictions"] == ["UPPERCASE"]
    assert m["Amount"]["extracted_pattern"] == ["NUMBER(10,2)", "max length 12"]


def test_inferred_patterns_hold_the_length(spark):
    df = spark.createDataFrame([("Character Length", "Name max 5 characters")], "d string, r string")
    assert df.select(R.infer_regex(F.col("d"), F.col("r"))).first()[0] == "^.{0,5}$"


def test_validation_messages(spark):
    df = spark.createDataFrame([("a", 1.25), ("A", 2.0), ("b", 3.5), (None, None), (" ", 40.0)], "s string, x double")
    rules = [
        {"column": "s", "dimension": "Completeness", "data_quality_rule": "S must not be blank"},
        {"column": "s", "dimension": "Consistency", "data_quality_rule": "S needs consistent casing"},
        {"column": "x", "dimension": "Accuracy", "data_quality_rule": "X has maximum of 1 decimal places"},
        {"column": "x", "dimension": "Accuracy", "data_quality_rule": "X in the range of 0 to 10"},
        {"column": "nope", "dimension": "Validity", "data_quality_rule": "must be numeric"},
        {"column": "s", "dimension": "Accuracy", "data_quality_rule": "S should reflect reality"},
    ]
    out = V.validate(df, rules, as_of=AS_OF).orderBy("s_no").collect()
    assert [r["issues_found"] for r in out] == [2, 2, 1, 1, 0, 0]
    assert out[0]["issues_found_example"] == "2 blank/null values found"
    assert out[1]["issues_found_example"] == "Inconsistent casing: A vs a"
    assert out[2]["issues_found_example"] == "1 values exceed 1 decimal places, e.g. 1.25"
    assert [r["status"] for r in out[4:]] == ["column_missing", "manual_review"]


def test_statements_count_nulls_as_repeats(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "s string")
    out = V.validate(df, [{"column": "s", "dimension": "Uniqueness", "data_quality_rule": "s must be unique"}], style="statement").first()
    assert out["issues_found"] == 4 and out["issues_found_example"] == "NULL (2 times); a (2 times)"


def test_good_and_rejected_rows_cover_the_input(spark):
    df = spark.createDataFrame([(1, "ab1"), (2, "zz"), (3, None), (4, "toolong9")], "k bigint, s string")
    rules = {"s": [{"name": "Digits", "mode": "Extract", "pattern": "[0-9]"}, {"name": "One", "mode": "Length", "length_mode": "Exact", "exact_length": 1}]}
    good, rejects = A.apply_rules(df, rules, at=AS_OF)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "1"), (4, "9")]
    assert sorted((r["k"], r["rejection_reason"]) for r in rejects.collect()) == [(2, "Digits - No matches"), (3, "Digits - No matches")]
    assert A.apply_rules(df, rules, null_policy="keep")[0].count() == 3


def test_rule_config_keeps_known_columns():
    text = A.export_config({"a": {"enabled": True}, "gone": {}})
    assert list(A.import_config(text, ["a", "b"])) == ["a"]


def test_rule_names(spark):
    assert R.length_label("Range", 2, 9) == "Length 2-9"
    rules = spark.createDataFrame([("Validate", r"^\d{10}$", "", ""), ("Replace", "abcdefghijkl", "x", ""), ("Case", "", "", ""), ("Sort", "", "", "")], "mode string, pattern string, replace string, case string")
    names = [r[0] for r in rules.select(R.rule_label(F.struct("*"))).collect()]
    assert names == ["Validate Phone", "Replace: abcdefghij → x", "To UPPERCASE", "Sort Rule"]
    df = spark.createDataFrame([(1, None), (2, "a_b"), (3, "c")], "id int, v string")
    assert R.suggest_cleaning(df, "v", "id").first()["mode"] == "Replace"
    assert R.suggest_cleaning(df, "v", "id", "Remove special signs").first()["name"] == "Remove Special Chars"


@pytest.mark.parametrize("style, names", [("snake_case", ["order_id", "my_name"]), ("camelCase", ["orderID", "myName"]), ("kebab-case", ["order-id", "my-name"]), ("upper", ["ORDER_ID", "MY NAME"])])
def test_naming_styles(spark, style, names):
    given = {"snake_case": ["orderId", "my name"], "camelCase": ["Order_ID", "my name"], "kebab-case": ["order_id", "My name"], "upper": ["order_id", "my name"]}[style]
    assert C.rename(spark.createDataFrame([(1, 2)], given), style).columns == names


def test_small_and_large_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(1.5e-11,), (0.00012345678912345,), (-2e-5,), (0.5,), (0.0,), (123456789.25,)], "x double")
    shown = [r[0] for r in df.select(N.plain_text(F.col("x"), df.schema["x"].dataType)).collect()]
    assert shown == ["0.000000000015", "0.00012345678912345", "-0.00002", "0.5", "0.0", "123456789.25"]


def test_quantiles_end_between_heavy_neighbours(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MAX_LAST_VALUES", 50)
    df = spark.range(100_000).selectExpr("id % 2 AS x")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]) == {"x": [0.5]}


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (float("nan"), None), (100.0, "a"), (1.5, "b")], "x double, s string")
    filled = C.impute(df).collect()
    assert [r["s"] for r in filled] == ["b", "a", "a", "a", "b"]  # the smaller of two tied modes
    assert filled[2]["x"] == pytest.approx((1.0 + 2.0 + 100.0 + 1.5) / 4)
    assert C.impute(df, "drop").count() == 4


def test_special_characters_are_cleaned(spark):
    df = spark.createDataFrame([("Café “x”​ \x07 y",), (None,)], "s string")
    assert [r[0] for r in C.clean_special(df).collect()] == ['Cafe "x"  y', None]


def test_names_must_not_collide(spark):
    with pytest.raises(ValueError):
        C.rename(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"), "snake_case")


def test_outlier_removal_treats_nulls_by_method(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    assert C.remove_outliers(df).count() == 21
    assert C.remove_outliers(df, method="zscore").count() == 20


def test_diff_and_counts(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, "z", 2.0)], "k bigint, s string, d double")
    b = spark.createDataFrame([(1, "x", None), (2, "Y", None), (4, "w", 2.0)], "k bigint, s string, d double")
    assert tuple(M.modified_cells(a, b, ["k"]).first()) == (2, 1, 1)
    assert M.diff(a, b, ["k"]).groupBy("status").count().orderBy("status").collect() == [("added", 2), ("changed", 2), ("removed", 2)]


def test_no_drift_against_itself(spark):
    df = spark.createDataFrame([(i, float(i % 7), "s") for i in range(50)], "k bigint, x double, s string")
    base = M.baseline(df, P.profile(df, samples=False))
    assert M.drift(base, base).count() == 0
    moved = df.withColumn("x", F.col("x") + 1000).drop("s")
    kinds = {r["type"] for r in M.drift(M.baseline(moved, P.profile(moved, samples=False)), base).collect()}
    assert kinds == {"mean_shift", "missing_column"}


def test_decimal_rules_need_no_text(spark):
    """The test of a decimal rule counts places as `decimal_places` does, and its plan makes no text of every value."""
    values = [0.0, -0.0, 1.5, -1.25, 0.1 + 0.2, 1e-7, 123456789.123, 1e15, 1e22, 9007199254740993.0, 0.000123456789012345678, 2.675, -99999.99, float("inf"), float("-inf"), float("nan"), None, 1 / 3, 1e-16, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(N.clean(F.col("x"), T.DoubleType()).alias("x"))
    for most in (0, 1, 2, 7, 14, 15):
        rows = df.select((N.decimal_places(F.col("x")) > most).alias("a"), N.more_decimals(F.col("x"), most).alias("b")).collect()
        assert [bool(r["a"]) for r in rows] == [r["b"] for r in rows]
    test = V.read_rule(df, "x", "Accuracy", "X may have a maximum of 1 decimal places").cell
    assert "decimal(38,18)" not in df.select(test)._jdf.queryExecution().optimizedPlan().toString()
