"""Column profile: one row per column, from one scan per kind of column.

The table is unpivoted to (column, value) cells, equal cells are counted (with map-side combine),
and every metric is a weighted aggregate over the distinct values. The plan has the same size
however many columns there are, an expensive text test runs once per distinct value, and exact
distinct counts come for free. ``fast=True`` skips the counting of numbers and dates and uses
HyperLogLog and sampled quartiles instead; text is counted all the same, because testing a value
once is cheaper than testing every row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline.functions import dtypes, numbers, similarity, text
from plumbline.operators.quantiles import col, exact_quantiles, numeric

# Special characters that are counted one by one, with their names.
SPECIAL_CHARACTERS = {
    "!": "exclamation mark", "@": "at symbol", "#": "hash", "$": "dollar", "%": "percent",
    "^": "caret", "&": "ampersand", "*": "asterisk", "(": "left parenthesis",
    ")": "right parenthesis", "+": "plus", "=": "equals", "[": "left bracket",
    "]": "right bracket", "{": "left brace", "}": "right brace", "|": "pipe", "\\": "backslash",
    ":": "colon", ";": "semicolon", '"': "double quote", "'": "single quote", "<": "less than",
    ">": "greater than", ",": "comma", ".": "period", "?": "question mark", "/": "forward slash",
}

# Shapes of values looked for in text columns.
PHONE = r"^[\d\s\-\+\(\)]{7,20}$"
DATES = r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})$"
URL = r"^https?://[^\s<>\"{}|\\^`\[\]]+$"
LOOSE_EMAIL = r"^[\w\.-]+@[\w\.-]+\.\w+$"

PATTERN_TYPES = ["Email", "Phone", "Date", "URL"]


def literal(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The larger expressions below are SQL texts: parsed in one step, which plans much faster than
# thousands of single Column calls.


def _text_flags(v: str) -> dict[str, str]:
    """Yes/no tests on one text value, the single special characters aside, as SQL."""
    stripped = f"btrim({v}, {literal(text.SPACE_CHARS)})"

    def shape(pattern: str) -> str:
        return f"rlike({v}, {literal(pattern)})"

    not_title = shape(text.NOT_TITLE)
    return {
        "multiple_spaces": shape(f"[{text.SPACE_CLASS}]{{2,}}"),
        "multiple_underscores": f"contains({v}, '__')",
        "double space": f"contains({v}, '  ')",
        # A cheap test in front of each pattern spares most values the regular expression.
        "Email": f"contains({v}, '@') AND " + shape(text.EMAIL),
        "Phone": f"length({v}) BETWEEN 7 AND 20 AND " + shape(PHONE),
        "Date": f"length({v}) BETWEEN 6 AND 10 AND " + shape(DATES),
        "URL": f"startswith({v}, 'http') AND " + shape(URL),
        "loose_email": f"contains({v}, '@') AND " + shape(text.java_regex(LOOSE_EMAIL)),
        "digits": shape(r"^\p{Nd}+$"),
        "empty": f"{v} = ''",
        "whitespace": f"{v} <> '' AND {stripped} = ''",
        "edge_space": f"{v} <> {stripped}",
        "upper": f"{v} = upper({v}) AND {v} <> lower({v})",
        "lower": f"{v} = lower({v}) AND {v} <> upper({v})",
        "title": shape(r"[\p{Lu}\p{Lt}]") + f" AND NOT {not_title}",
        "odd_case": f"{v} <> lower({v}) AND {v} <> upper({v}) AND {not_title}",
    }


_FLAG_NAMES = [
    "multiple_spaces", "multiple_underscores", *["char " + ch for ch in SPECIAL_CHARACTERS], "double space",
    "Email", "Phone", "Date", "URL", "loose_email", "digits", "empty", "whitespace", "edge_space",
    "upper", "lower", "title", "odd_case",
]
_BIT = {name: 1 << i for i, name in enumerate(_FLAG_NAMES)}
_PATTERN_BITS = sum(_BIT[p] for p in PATTERN_TYPES)
_ANY_SPECIAL = sum(_BIT[n] for n in _FLAG_NAMES if n.startswith("char ") or n in ("double space", "multiple_underscores"))


def text_mask(v: str) -> Column:
    """All yes/no tests of the text column ``v`` packed into one bigint."""
    # One fold over a constant table of characters keeps the generated code small; it only runs on
    # values that hold any special character.
    table = ", ".join(f"struct({literal(ch)} AS ch, {_BIT['char ' + ch]}L AS bit)" for ch in SPECIAL_CHARACTERS)
    any_char = literal("[" + "".join("\\" + ch for ch in SPECIAL_CHARACTERS) + "]")
    found = f"aggregate(array({table}), 0L, (acc, s) -> acc + IF(contains({v}, s.ch), s.bit, 0L))"
    tests = [f"IF(rlike({v}, {any_char}), {found}, 0L)"]
    tests += [f"IF({test}, {_BIT[name]}L, 0L)" for name, test in _text_flags(v).items()]
    return F.expr(" + ".join(tests))


def _has(bits: int) -> str:
    return f"(mask & {bits}L) <> 0"


def _kinds(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {}
    for c in columns:
        dtype = df.schema[c].dataType
        k = dtypes.kind(dtype)
        kinds.setdefault(k if k != "decimal" else dtype.simpleString(), []).append(c)
    return kinds


def _cell_value(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    k = dtypes.kind(dtype)
    if k == "integer":
        return col(name).cast("bigint")
    if k == "float":
        return numeric(df, name)
    if k == "nested":
        if isinstance(dtype, T.NullType):
            return F.lit(None).cast("string")
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.to_json(col(name))
        return col(name).cast("string")
    return col(name)


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v): one row per cell of the given columns, which must be of one kind."""
    ids = [f"c{i}" for i in range(len(columns))]
    wide = df.select(*[_cell_value(df, c).alias(i) for c, i in zip(columns, ids)])
    if len(columns) == 1:
        return wide.select(F.lit(columns[0]).alias("column"), F.col(ids[0]).alias("v"))
    names = F.create_map(*[F.lit(x) for pair in zip(ids, columns) for x in pair])
    return wide.unpivot([], ids, "id", "v").select(F.element_at(names, F.col("id")).alias("column"), "v")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value as text, n) for every distinct value, NULL included."""
    columns = df.columns if columns is None else columns
    out = None
    for names in _kinds(df, columns).values():
        part = (
            cells(df, names).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
            .select("column", F.col("v").cast("string").alias("value"), "n")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _counted_text(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, v, mask, len, bytes, n) of text columns.

    Long values (over 256 bytes) are tested before the shuffle and travel as a digest; short ones
    are counted first and tested once per distinct value.
    """
    raw = cells(df, names)
    long = F.octet_length("v") > 256
    early = raw.select(
        "column", "v",
        F.when(long, text_mask("v")).alias("m"),
        F.when(long, F.length("v")).alias("l"),
        F.when(long, F.octet_length("v")).alias("b"),
    ).select(
        "column",
        # Values of a known shape stay readable, because they may serve as the example.
        F.when(F.col("m").bitwiseAND(F.lit(_PATTERN_BITS).cast("bigint")) == 0, text.compact_key(F.col("v")))
        .otherwise(F.col("v")).alias("v"),
        "m", "l", "b",
    )
    counted = early.groupBy("column", "v", "m", "l", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "column", "v",
        F.coalesce("m", text_mask("v")).alias("mask"),
        F.coalesce("l", F.length("v")).alias("len"),
        F.coalesce("b", F.octet_length("v")).cast("bigint").alias("bytes"),
        "n",
    )


def _weighted(test: str) -> Column:
    """How many rows pass a test, summed over counted values."""
    return F.expr(f"CAST(coalesce(sum(IF({test}, n, 0L)), 0L) AS BIGINT)")


def _common(fast: bool) -> list[Column]:
    unique = F.approx_count_distinct("v") if fast else F.count("v")
    return [
        F.sum("n").cast("bigint").alias("total_rows"),
        _weighted("v IS NULL").alias("null_count"),
        unique.cast("bigint").alias("unique_count"),
    ]


def _text_stats(df: DataFrame, names: list[str]) -> DataFrame:
    counted = _counted_text(df, names)
    flags = [_weighted(_has(_BIT[f])).alias("f:" + f) for f in _FLAG_NAMES]
    stats = counted.groupBy("column").agg(
        *_common(False),
        F.sum(F.col("n") * F.col("len")).cast("bigint").alias("length_sum"),
        F.min("len").cast("bigint").alias("min_length"),
        F.max("len").cast("bigint").alias("max_length"),
        _weighted("len > 255 OR len = 0").alias("out_of_bounds_count"),
        F.coalesce(F.sum(F.col("n") * F.col("bytes")), F.lit(0)).cast("bigint").alias("data_bytes"),
        _weighted(_has(_ANY_SPECIAL)).alias("total_special_char_rows"),
        *flags,
    )
    # Smallest value of each known shape; only matching values reach this aggregate. The condition
    # names n so that it stays above the counting: both branches then share one shuffle, and the
    # tests run on counted values instead of rows.
    shapes = F.expr("array_compact(array(" + ", ".join(f"IF({_has(_BIT[p])}, '{p}', NULL)" for p in PATTERN_TYPES) + "))")
    examples = (
        counted.filter(f"IF(n > 0, {_has(_PATTERN_BITS)}, false)").select("column", "v", F.explode(shapes).alias("shape"))
        .groupBy("column", "shape").agg(F.min("v").alias("example"))
        .groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("shape", "example"))).alias("examples"))
    )
    return stats.join(F.broadcast(examples), "column", "left")


def _number_stats(df: DataFrame, names: list[str], fast: bool) -> DataFrame:
    """Statistics of numeric columns, with IQR fences from exact (or sketched) quartiles."""
    fences = iqr_fences(df, names, approximate=fast)
    raw = cells(df, names)
    counted = (
        raw.withColumn("n", F.lit(1).cast("bigint")) if fast
        else raw.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    low, high = _lookup({c: f[0] for c, f in fences.items()}), _lookup({c: f[1] for c, f in fences.items()})
    x = F.col("v").cast("double")
    marked = counted.select("column", "v", "n", x.alias("x"), ((x < low) | (x > high)).alias("out"))
    width = max(_width(df.schema[c].dataType) for c in names)
    stats = marked.groupBy("column").agg(
        *_common(fast),
        F.min("x").alias("range_min"), F.max("x").alias("range_max"),
        # in the column's own type: a double holds whole numbers up to 2^53 only
        F.min("v").cast("string").alias("exact_min"), F.max("v").cast("string").alias("exact_max"),
        _weighted("x < 0").alias("negative_count"),
        _weighted("x = 0").alias("zero_count"),
        _weighted("abs(x) = double('Infinity')").alias("infinite_count"),
        _weighted("out").alias("outlier_count"),
        (_weighted("v IS NOT NULL") * width).alias("data_bytes"),
    )
    first = Window.partitionBy("column").orderBy("x")
    outside = marked.filter("IF(n > 0, out, false)").select("column", "x")
    samples = outside.distinct() if fast else outside
    samples = (
        samples.withColumn("r", F.row_number().over(first)).filter("r <= 3")
        .groupBy("column").agg(F.array_sort(F.collect_list("x")).alias("outlier_samples"))
    )
    return (
        stats.join(F.broadcast(samples), "column", "left")
        .withColumn("outlier_low", _lookup({c: f[0] for c, f in fences.items()}))
        .withColumn("outlier_high", _lookup({c: f[1] for c, f in fences.items()}))
    )


def _lookup(values: dict[str, float | None]) -> Column:
    known = [(k, v) for k, v in values.items() if v is not None]
    if not known:
        return F.lit(None).cast("double")
    pairs = F.create_map(*[F.lit(x) for pair in known for x in pair])
    return F.try_element_at(pairs, F.col("column"))


def _width(dtype: T.DataType) -> int:
    sizes = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.BooleanType: 1}
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return sizes.get(type(dtype), 8)


def iqr_fences(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, tuple]:
    """Lower and upper IQR fence per numeric column (1.5 IQR beyond the quartiles)."""
    if approximate:
        row = df.agg(
            *[F.percentile_approx(numeric(df, c), [0.25, 0.75], 2_000).alias(f"q{i}") for i, c in enumerate(columns)]
        ).first()
        quartiles = {c: row[f"q{i}"] or [None, None] for i, c in enumerate(columns)}
    else:
        quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    fences = {}
    for c, (q1, q3) in quartiles.items():
        fences[c] = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences


def _moment_stats(df: DataFrame, names: list[str], fast: bool, as_of: dt.datetime) -> DataFrame:
    """Statistics of date and timestamp columns."""
    raw = cells(df, names)
    counted = (
        raw.withColumn("n", F.lit(1).cast("bigint")) if fast
        else raw.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    dtype = df.schema[names[0]].dataType
    now = f"CAST('{as_of.isoformat(' ')}' AS {dtype.simpleString()})"
    return counted.groupBy("column").agg(
        *_common(fast),
        F.min("v").alias("first"), F.max("v").alias("last"),
        _weighted(f"v > {now}").alias("future_count"),
        (_weighted("v IS NOT NULL") * _width(dtype)).alias("data_bytes"),
    ).select(
        "column", "total_rows", "null_count", "unique_count", "future_count", "data_bytes",
        F.col("first").cast("string").alias("first_moment"), F.col("last").cast("string").alias("last_moment"),
    )


def _plain_stats(df: DataFrame, names: list[str], fast: bool) -> DataFrame:
    raw = cells(df, names)
    counted = (
        raw.withColumn("n", F.lit(1).cast("bigint")) if fast
        else raw.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("column").agg(
        *_common(fast),
        _weighted("v IS NOT NULL").alias("data_bytes") if names and isinstance(df.schema[names[0]].dataType, T.BooleanType)
        else F.coalesce(F.sum(F.col("n") * F.octet_length(F.col("v").cast("string"))), F.lit(0)).cast("bigint").alias("data_bytes"),
    )


def column_info(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, dtype, label, family), straight from the schema."""
    columns = df.columns if columns is None else columns
    rows = [
        (i, c, df.schema[c].dataType.simpleString(), dtypes.label(df.schema[c].dataType), dtypes.family(df.schema[c].dataType))
        for i, c in enumerate(columns)
    ]
    schema = "position int, column string, dtype string, label string, family string"
    return df.sparkSession.createDataFrame(rows, schema)


def base_statistics(df: DataFrame, columns: list[str] | None = None, fast: bool = False, as_of: dt.datetime | None = None) -> DataFrame:
    """Raw statistics per column; ``profile`` derives its scores and texts from these."""
    columns = df.columns if columns is None else columns
    as_of = as_of or dt.datetime.now()
    parts = []
    for k, names in _kinds(df, columns).items():
        if k == "text":
            parts.append(_text_stats(df, names))
        elif k in ("integer", "float") or k.startswith("decimal"):
            parts.append(_number_stats(df, names, fast))
        elif k in ("date", "timestamp", "timestamp_ntz"):
            parts.append(_moment_stats(df, names, fast, as_of))
        else:
            parts.append(_plain_stats(df, names, fast))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    wanted = {
        "length_sum": "bigint", "min_length": "bigint", "max_length": "bigint", "out_of_bounds_count": "bigint",
        "data_bytes": "bigint", "total_special_char_rows": "bigint", "examples": "map<string,string>",
        "range_min": "double", "range_max": "double", "exact_min": "string", "exact_max": "string", "negative_count": "bigint", "zero_count": "bigint",
        "infinite_count": "bigint", "outlier_count": "bigint", "outlier_samples": "array<double>",
        "outlier_low": "double", "outlier_high": "double", "future_count": "bigint",
        "first_moment": "string", "last_moment": "string", **{"f:" + f: "bigint" for f in _FLAG_NAMES},
    }
    missing = {n: F.lit(None).cast(t) for n, t in wanted.items() if n not in out.columns}
    out = out.withColumns(missing) if missing else out
    # One row per column of the schema: small, whatever the table holds.
    info = column_info(df, columns)
    return info.join(out, "column", "left").fillna(0, ["total_rows", "null_count", "unique_count", "data_bytes"])


def profile(
    df: DataFrame,
    columns: list[str] | None = None,
    fast: bool = False,
    as_of: dt.datetime | None = None,
    order_by: str | None = None,
    samples: bool = True,
) -> DataFrame:
    """One row per column with volume, uniqueness, content, risk and recommendations.

    ``fast`` uses approximate distinct counts and quartiles. ``as_of`` decides what "future" means.
    ``samples`` adds the first three values, in the order of ``order_by`` when that is given.
    """
    columns = df.columns if columns is None else columns
    stats = base_statistics(df, columns, fast, as_of)
    out = describe(stats)
    if samples:
        out = out.join(F.broadcast(sample_values(df, columns, order_by)), "column", "left")
    return out


def _share(part: str, whole: str) -> str:
    return f"IF({whole} > 0, {part} * 100.0D / {whole}, 0.0D)"


def _flag(name: str) -> str:
    return f"coalesce(`f:{name}`, 0L)"


def _fixed(x: str, decimals: int) -> str:
    return f"format_string('%.{decimals}f', bround({x}, {decimals}))"


def _present(*items: str) -> str:
    """An array of the items that are not NULL; empty rather than NULL when none is."""
    return f"array_compact(array({', '.join(items)}))"


def describe(stats: DataFrame) -> DataFrame:
    """Scores, texts and recommendations from the raw statistics. Row-wise, no shuffle."""
    names = {"multiple_spaces": "multiple spaces", "multiple_underscores": "multiple underscores"}
    entries = [f"struct({literal(k)} AS key, {literal(n)} AS name, {_flag(k)} AS count)" for k, n in names.items()]
    entries += [
        f"struct({literal(ch)} AS key, {literal(n)} AS name, " + _flag("char " + ch) + " AS count)"
        for ch, n in SPECIAL_CHARACTERS.items()
    ]
    special = f"""array_sort(filter(array({", ".join(entries)}), s -> s.count > 0),
        (a, b) -> CASE WHEN a.count > b.count THEN -1 WHEN a.count < b.count THEN 1
                       WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)"""
    non_null = "(total_rows - null_count)"
    all_digits = f"({non_null} > 0 AND {_flag('digits')} = {non_null})"
    counts = [
        f"struct('{p}' AS key, " + (f"IF({all_digits}, 0L, {_flag(p)})" if p == "Phone" else _flag(p)) + " AS value)"
        for p in PATTERN_TYPES
    ]
    base = stats.selectExpr(
        "position", "column", "dtype", "label", "family", "total_rows", "null_count",
        f"{_share('null_count', 'total_rows')} AS null_percentage",
        f"{non_null} AS non_null_count",
        f"100.0D - {_share('null_count', 'total_rows')} AS non_null_percentage",
        "unique_count",
        f"{_share('unique_count', 'total_rows')} AS unique_percentage",
        "total_rows - unique_count AS duplicate_count",
        f"{_share('(total_rows - unique_count)', 'total_rows')} AS duplicate_percentage",
        "data_bytes",
        f"IF(data_bytes > 1024, concat({_fixed('data_bytes / 1024.0D', 2)}, ' KB'), concat(data_bytes, ' bytes')) AS memory_usage",
        f"{special} AS special_chars",
        "coalesce(total_special_char_rows, 0L) AS total_special_char_rows",
        f"IF(family = 'Text', map_from_entries(filter(array({', '.join(counts)}), s -> s.value > 0)), NULL) AS pattern_counts",
        f"IF(family = 'Text', map_filter(examples, (k, v) -> k <> 'Phone' OR NOT {all_digits}), NULL) AS pattern_examples",
        "range_min", "range_max", "exact_min", "exact_max", "first_moment AS moment_min", "last_moment AS moment_max",
        "negative_count", "zero_count", "coalesce(infinite_count, 0L) AS infinite_count",
        f"{_flag('multiple_spaces')} AS multi_space_count", f"{_flag('edge_space')} AS edge_space_count",
        f"{_flag('empty')} AS empty_string_count", f"{_flag('whitespace')} AS whitespace_only_count",
        f"null_count + {_flag('empty')} + {_flag('whitespace')} AS total_missing",
        "`f:upper` AS upper_count", "`f:lower` AS lower_count", "`f:title` AS title_count",
        f"{non_null} - `f:upper` - `f:lower` - `f:title` AS mixed_count",
        "coalesce(min_length, 0L) AS min_length", "coalesce(max_length, 0L) AS max_length",
        f"coalesce(length_sum / nullif({non_null}, 0L), 0.0D) AS avg_length",
        "coalesce(out_of_bounds_count, 0L) AS out_of_bounds_count",
        "coalesce(outlier_count, 0L) AS outlier_count", "outlier_low", "outlier_high",
        "coalesce(outlier_samples, CAST(array() AS ARRAY<DOUBLE>)) AS outlier_samples",
        "coalesce(future_count, 0L) AS future_count",
        f"{_flag('loose_email')} AS loose_email_count", f"{_flag('odd_case')} AS odd_case_count",
    )
    return with_assessment(base)


def with_assessment(base: DataFrame) -> DataFrame:
    """Add scores, suggestions, risk and cleansing recommendations to the measured columns."""

    def penalty(count: str, cap: float, of: str) -> str:
        return f"IF({count} > 0, least({cap}D, {count} * 100.0D / {of}), 0.0D)"

    scored = base.selectExpr(
        "*",
        f"100.0D - {penalty('multi_space_count', 10, 'non_null_count')} - {penalty('edge_space_count', 15, 'non_null_count')} AS accuracy_score",
        f"""{_present(
            "IF(multi_space_count > 0, concat(multi_space_count, ' values with multiple spaces'), NULL)",
            "IF(edge_space_count > 0, concat(edge_space_count, ' values with leading/trailing spaces'), NULL)",
        )} AS accuracy_issues""",
        f"100.0D - {penalty('infinite_count', 20, 'total_rows')} - {penalty('empty_string_count', 10, 'total_rows')} AS validity_score",
        "infinite_count + empty_string_count AS invalid_count",
        f"""{_present(
            "IF(infinite_count > 0, concat(infinite_count, ' infinite values'), NULL)",
            "IF(empty_string_count > 0, concat(empty_string_count, ' empty strings'), NULL)",
        )} AS validity_issues""",
        """CASE WHEN family <> 'Text' OR non_null_count = 0 THEN NULL
                WHEN upper_count > 0.8D * non_null_count THEN 'UPPER'
                WHEN lower_count > 0.8D * non_null_count THEN 'lower'
                WHEN title_count > 0.8D * non_null_count THEN 'Title' ELSE 'Mixed' END AS case_type""",
        """CASE family WHEN 'Text' THEN map_keys(pattern_counts) WHEN 'Numeric' THEN array('Numeric')
                WHEN 'DateTime' THEN array('DateTime') END AS pattern_types""",
        f"""{_present(
            "IF(negative_count > 0, concat('Negative values detected (', negative_count, ' rows) - Verify if allowed'), NULL)",
            "IF(future_count > 0, concat('Future dates detected (', future_count, ' rows) - Verify validity'), NULL)",
            "IF(loose_email_count > 0.5D * non_null_count AND loose_email_count < non_null_count, "
            "concat('Invalid email formats detected (', non_null_count - loose_email_count, ' rows)'), NULL)",
        )} AS business_rule_violations""",
        "family = 'Text' AND total_rows > 0 AND coalesce(unique_count / nullif(total_rows, 0L), 1.0D) < 0.9D AS fuzzy_candidate",
    ).selectExpr("*", "coalesce(case_type <> 'Mixed', true) AS consistent_case")

    many_special = "coalesce(total_special_char_rows * 100.0D / nullif(total_rows, 0L), 0.0D) > 10"
    duplicated = "(duplicate_percentage > 50 AND unique_count > 5)"
    null_rows = "concat(null_count, ' rows')"
    few = "(null_percentage > 0 AND null_percentage < 5)"

    def step(test: str, action: str, impact: str, description: str) -> str:
        return f"IF({test}, struct('{action}' AS action, {impact} AS impact, '{description}' AS description), NULL)"

    return scored.selectExpr(
        "*",
        f"""{_present(
            "IF(null_percentage > 0, concat('[', CASE WHEN null_percentage > 50 THEN 'Critical' WHEN null_percentage > 10 THEN 'Warning' ELSE 'OK' END, '] ', "
            + _fixed("null_percentage", 1) + ", '% missing values'), NULL)",
            "IF(empty_string_count > 0, concat(empty_string_count, ' empty strings (not null)'), NULL)",
            "IF(whitespace_only_count > 0, concat(whitespace_only_count, ' whitespace-only values'), NULL)",
            "IF(size(special_chars) > 0, concat(size(special_chars), ' special character types'), NULL)",
            "IF(outlier_count > 0, concat(outlier_count, ' statistical outliers'), NULL)",
            "IF(fuzzy_candidate, 'Candidate for fuzzy matching', NULL)",
            "IF(unique_percentage = 100 AND null_percentage = 0, 'Primary key candidate', NULL)",
            "IF(unique_percentage < 5, 'Low cardinality - consider categorical', NULL)",
            "IF(edge_space_count > 0, 'Leading/trailing whitespace', NULL)",
            "IF(odd_case_count > 0, 'Inconsistent text casing', NULL)",
        )} AS suggestions""",
        f"""least(100, CASE WHEN null_percentage > 50 THEN 40 WHEN null_percentage > 20 THEN 20 ELSE 0 END
            + IF({duplicated}, 30, 0) + IF({many_special}, 15, 0) + IF(outlier_count > 0, 10, 0)) AS risk_score""",
        f"""{_present(
            "CASE WHEN null_percentage > 50 THEN 'Critical: Majority of data is missing' WHEN null_percentage > 20 THEN 'High missing value rate' END",
            f"IF({duplicated}, 'High duplication rate in potential identifier', NULL)",
            f"IF({many_special}, 'Frequent special characters - potential ingestion risk', NULL)",
            "IF(outlier_count > 0, 'Statistical outliers detected', NULL)",
        )} AS key_issues""",
        f"""{_present(
            step(few, "Drop Rows", null_rows, "Remove rows with missing values (low impact)"),
            step(few, "Impute Values", null_rows, 'Fill missing values with mode/mean or "Unknown"'),
            step("null_percentage >= 5", "Impute/Flag", null_rows, "High missing rate - investigate source or flag as missing"),
            step("total_special_char_rows > 0", "Clean Strings", "concat(total_special_char_rows, ' rows')", "Remove or replace detected special characters using regex"),
            step("NOT consistent_case", "Standardize Case", "'All rows'", "Convert text to Title Case or Upper Case for consistency"),
        )} AS cleansing_recommendations""",
    ).selectExpr("*", "CASE WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level")


def sample_values(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None, n: int = 3) -> DataFrame:
    """(column, sample_values): the first ``n`` values per column.

    With ``order_by`` these are the first non-null values in that order (a per-task top-n, no
    sort of the table), in one pass for all columns. Without it they come from the rows that Spark reads first.
    """
    columns = df.columns if columns is None else columns
    if order_by is not None:
        return _first_values(df, columns, col(order_by), n)
    texts = df.select(*[_cell_value(df, c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    head = texts.limit(50).collect()
    found = {c: [r[i] for r in head if r[i] is not None][:n] for i, c in enumerate(columns)}
    sparse = [c for c in columns if len(found[c]) < n and len(head) == 50]
    if sparse:  # one pass for all of them, in the order of reading
        found |= {r["column"]: r["sample_values"] for r in _first_values(df, sparse, F.monotonically_increasing_id(), n).collect()}
    return df.sparkSession.createDataFrame(list(found.items()), "column string, sample_values array<string>")


def _first_values(df: DataFrame, columns: list[str], order: Column, n: int) -> DataFrame:
    """(column, sample_values) of all columns at once: a top-n per column and task, then per column."""
    cell = F.array(*[F.struct(F.lit(c).alias("column"), _cell_value(df, c).cast("string").alias("v")) for c in columns])
    present = df.select(order.alias("o"), cell.alias("x")).select("o", F.inline("x")).filter("v IS NOT NULL")
    top = present.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("o"))).filter(F.col("r") <= n)
    taken = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("sample_values"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(taken, "column", "left").select("column", F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"))


# --- further operators over one table -------------------------------------------------------


def char_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Occurrences of every character that is neither a letter, a digit nor a blank, or not ASCII."""
    columns = dtypes.text_columns(df) if columns is None else columns
    # Only the wanted characters survive the replacement, so the explode stays small.
    kept = F.regexp_replace(F.col("v"), rf"[a-zA-Z0-9\t-\r\x1c-\x20]", "")
    counted = (
        cells(df, columns).filter(F.col("v").isNotNull())
        .select("column", F.explode(F.split(kept, "")).alias("character"))
        .filter(F.col("character") != "")
        .groupBy("column", "character").agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.withColumn("unicode_name", similarity.unicode_name(F.col("character")))


def column_summary(df: DataFrame) -> DataFrame:
    """Type, non-null count, null % and distinct count per column."""
    stats = None
    for names in _kinds(df, df.columns).values():
        part = _plain_stats(df, names, fast=False).select("column", "total_rows", "null_count", "unique_count")
        stats = part if stats is None else stats.unionByName(part)
    return (
        column_info(df).join(stats, "column", "left").fillna(0, ["total_rows", "null_count", "unique_count"])
        .select(
            "column", F.col("dtype").alias("type"), (F.col("total_rows") - F.col("null_count")).alias("non_null"),
            numbers.pct(F.col("null_count"), F.col("total_rows")).alias("null_percentage"), F.col("unique_count").alias("unique"),
        )
    )


def dtype_coverage(df: DataFrame) -> DataFrame:
    """Distinct column types and whether they have a label."""
    return column_info(df).select(F.col("dtype"), (F.col("label") != "Unknown").alias("mapped")).distinct()


def family_distribution(df: DataFrame) -> DataFrame:
    """How many columns are Numeric, DateTime, Text or Other."""
    return column_info(df).groupBy("family").agg(F.count(F.lit(1)).alias("columns"))


def dtype_distribution(df: DataFrame) -> DataFrame:
    return column_info(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"))


def duplicate_values(df: DataFrame, column: str, max_items: int | None = 5) -> DataFrame:
    """Repeated values with their counts as one text, most frequent first.

    NULL and blank values read ``Missing Values(n)``. With ``max_items=None`` every repeated value
    is listed, in one row: use that only where their number is known to be small.
    """
    value = F.col("v").cast("string")
    repeated = cells(df, [column]).groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(value.alias("v"), "n")
    if max_items is not None:
        repeated = repeated.orderBy(F.desc("n"), F.asc_nulls_first("v")).limit(max_items)
    shown = F.when(F.col("v").isNull() | text.is_blank(F.col("v")), F.lit("Missing Values")).otherwise(text.strip(F.col("v")))
    item = F.concat(shown, F.lit("("), F.col("n").cast("string"), F.lit(")"))
    entry = F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"), item.alias("item"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["item"]), ", ")
    return repeated.agg(F.when(F.count(F.lit(1)) == 0, "No duplicates").otherwise(listed).alias("duplicate_values")).select(
        F.lit(column).alias("column"), "duplicate_values"
    )


def top_duplicates(df: DataFrame, column: str, rid: str, limit: int = 10, ids: int = 5) -> DataFrame:
    """The most repeated values: 50 characters of the value, count, share, first row ids."""
    keyed = df.select(_cell_value(df, column).alias("v"), col(rid).alias("rid"))
    top = (
        keyed.filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
        .orderBy(F.desc("count"), "v").limit(limit)
    )
    # `top` has at most `limit` rows, so the broadcast is bounded; the window keeps `ids` rows per value.
    first = Window.partitionBy("v").orderBy("rid")
    rows = (
        keyed.join(F.broadcast(top), "v").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= ids)
        .groupBy("v", "count").agg(F.array_sort(F.collect_list("rid")).alias("row_ids"))
    )
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(
        F.substring(F.col("v").cast("string"), 1, 50).alias("value"), "count",
        F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("percentage"), "row_ids",
    )


def narrow_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cast numbers to the smallest type that holds them; report what was done.

    Returns the narrowed table and a report with one row per column. Text columns with fewer than
    half distinct values are reported as ``category`` candidates and left unchanged.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        if numbers.is_integer(f.dataType) or numbers.is_float(f.dataType):
            v = numbers.clean(col(f.name), f.dataType)
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    text_names = dtypes.text_columns(df)
    distinct = {}
    if text_names:
        distinct = {
            r["column"]: r["n"]
            for r in _plain_stats(df, text_names, fast=False)
            .select("column", (F.col("unique_count") + (F.col("null_count") > 0).cast("int")).alias("n")).collect()
        }
    chosen, report = [], []
    for i, f in enumerate(fields):
        target = f.dataType.simpleString()
        lo, hi = (row[f"lo{i}"], row[f"hi{i}"]) if f"lo{i}" in row.asDict() else (None, None)
        if numbers.is_integer(f.dataType) and lo is not None:
            for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
                if lo > -(1 << bits) and hi < (1 << bits) - 1:
                    target = name
                    break
        elif isinstance(f.dataType, T.DoubleType) and lo is not None and lo > -3.4028234663852886e38 and hi < 3.4028234663852886e38:
            target = "float"
        elif f.name in distinct and row["rows"] and distinct[f.name] / row["rows"] < 0.5:
            target = "category"
        chosen.append(col(f.name) if target == "category" else col(f.name).cast(target).alias(f.name))
        report.append((f.name, f.dataType.simpleString(), target))
    spark: SparkSession = df.sparkSession
    return df.select(*chosen), spark.createDataFrame(report, "column string, from_type string, to_type string")
