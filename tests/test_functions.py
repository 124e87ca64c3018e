import pytest
from pyspark.sql import functions as F, types as T

from plumbline.functions import dtypes, numbers, similarity, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize("value", ["o'neil mary-jane", "hELLO wORLD", "a1b c", "éa ßx", ""])
def test_title_matches_python(spark, value):
    assert one(spark, value, text.title) == value.title()


@pytest.mark.parametrize("value", ["Hello World", "HELLO", "hello", "A1B", "123", "Mary-Jane", "McDonald", "", "Ab aB"])
def test_case_predicates_match_python(spark, value):
    assert one(spark, value, text.is_title) == value.istitle()
    assert one(spark, value, text.is_upper) == value.isupper()
    assert one(spark, value, text.is_lower) == value.islower()


@pytest.mark.parametrize("value", [" a ", "\ta\xa0", " x y\n", "   ", ""])
def test_strip_matches_python(spark, value):
    assert one(spark, value, text.strip) == value.strip()


@pytest.mark.parametrize(
    ("value", "number"),
    [("1e5", 1e5), (" 12 ", 12.0), ("1_0", None), ("5d", None), ("1,000", None), ("", None), (".5", 0.5), ("5.", 5.0), ("inf", float("inf")), ("-inf", float("-inf")), ("NaN", None)],
)
def test_numeric_text(spark, value, number):
    assert one(spark, value, numbers.to_number) == number


@pytest.mark.parametrize(("value", "places"), [(1.5, 1), (2.0, 0), (0.1 + 0.2, 1), (1e7, 0), (123.456, 3), (1e-4, 4)])
def test_decimal_places(spark, value, places):
    assert one(spark, value, numbers.decimal_places, "double") == places


def test_title_styles(spark):
    value = "the lord of THE rings and-a sql story to"
    assert one(spark, value, lambda c: text.styled_title(c, "apa")) == "The Lord of THE Rings and-a SQL Story To"
    assert one(spark, value, lambda c: text.styled_title(c, "sentence")) == "The lord of THE rings and-a SQL story To"


def test_python_patterns_are_translated(spark):
    made = one(spark, "ab-12", lambda c: F.regexp_replace(c, text.java_regex(r"(?P<w>\w+)-(\d+)"), text.java_replacement(r"$\2:\g<w>")))
    assert made == "$12:ab"


def test_type_labels():
    labels = {T.LongType(): "Whole Number", T.DoubleType(): "Decimal Number", T.DecimalType(10, 2): "Decimal Number", T.StringType(): "Text",
              T.BooleanType(): "True / False", T.TimestampType(): "Date & Time", T.DateType(): "Date & Time", T.DayTimeIntervalType(): "Time Duration",
              T.NullType(): "Empty", T.ArrayType(T.LongType()): "Nested", T.BinaryType(): "Unknown"}
    for dtype, label in labels.items():
        assert dtypes.label(dtype) == label


def test_scores(spark):
    row = spark.createDataFrame([("martha", "marhta")], "a string, b string").select(
        similarity.score("jaro_winkler", F.col("a"), F.col("b")), similarity.score("ratio", F.col("a"), F.col("b")),
        similarity.score("difflib", F.col("a"), F.col("b")), similarity.score("phonetic", F.col("a"), F.col("b")),
    ).first()
    assert row[0] == pytest.approx(96.1111, abs=1e-3)
    assert row[1] == pytest.approx(83.3333, abs=1e-3)
    assert row[2] == pytest.approx(83.3333, abs=1e-3)
    assert row[3] == 85.0  # MR0 or MRT, and MRT


def test_normalize(spark):
    assert one(spark, "  École, n°1:  Ñandú! ", similarity.normalize) == "ecole n1 nandu"
