"""Running rule tables against data: every rule in one scan.

Each rule turns a row into at most one cell (rule, value): the offending value for row checks, or
the value to be grouped for uniqueness, casing and format checks. Cells of all rules are counted
together, so the data is read once and repeated values shrink before the shuffle. Examples are the
smallest offending values; a bounded window keeps five per rule, however many there are.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions import dtypes, numbers, text
from plumbline.operators.quantiles import col
from plumbline.operators.rules import ALLOWED_VALUES, MAX_CHARS, VALID

# Date formats accepted for text columns.
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd",
]


@dataclass
class Check:
    """What one rule looks for, and how its finding is worded."""

    kind: str  # rows, unique, casing, mask, or none (nothing to scan)
    cell: Column | None = None  # struct(v) for rows that count, NULL for the others
    says: str = ""  # text after the count
    examples: bool = False
    quoted: bool = True
    status: str = "checked"
    fixed: str = VALID


def allowed_values(rule: str) -> list[str] | None:
    """The list in "must be one of: a, b, c"."""
    m = re.search(ALLOWED_VALUES, rule)
    if not m:
        return None
    items = re.split(r"[,;]", m.group(1).strip().rstrip("."))
    return [v.strip().strip("'\"") for v in items if v.strip()] or None


def max_chars(rule: str) -> int | None:
    m = re.search(MAX_CHARS, rule)
    return int(m.group(1)) if m else None


def value_range(rule: str) -> tuple[float, float] | None:
    m = re.search(r"(?i)(?:range\s+(?:of\s+)?|between\s+)([\d.]+)\s+(?:to|and)\s+([\d.]+)", rule)
    return (float(m.group(1)), float(m.group(2))) if m else None


def max_decimals(rule: str) -> int | None:
    m = re.search(r"(?i)(?:maximum\s+(?:of\s+)?)?(\d+)\s+decimal\s+place", rule)
    return int(m.group(1)) if m else None


def parse_date(c: Column, dtype: T.DataType) -> Column:
    """A timestamp, or NULL where a text is not a date in one of the known formats."""
    if not dtypes.is_text(dtype):
        return c.cast("timestamp") if dtypes.family(dtype) == "DateTime" else F.lit(None).cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(text.strip(c), F.lit(f)) for f in DATE_FORMATS])


def read_rule(df: DataFrame, column: str, dimension: str, rule: str) -> Check:
    """The check a (dimension, rule text) pair asks for; the first phrase that fits decides."""
    if column not in df.columns:
        return Check("none", status="column_missing", fixed="Column not found in dataset")
    dtype = df.schema[column].dataType
    is_text = dtypes.is_text(dtype)
    raw = numbers.clean(col(column), dtype)
    shown = raw if is_text else numbers.plain_text(raw, dtype)
    low, trimmed, number = rule.lower(), text.strip(shown), numbers.to_number(raw, dtype)

    def says(*phrases: str) -> bool:
        return any(p in low for p in phrases)

    def bad(test: Column, words: str, value: Column = shown, quoted: bool = is_text) -> Check:
        return Check("rows", F.when(test, F.struct(value.alias("v"))), words, True, quoted)

    def blank(words: str = " blank/null values found") -> Check:
        return Check("rows", F.when(shown.isNull() | (trimmed == ""), F.struct(F.lit(None).cast("string").alias("v"))), words)

    full = trimmed != ""
    if dimension == "Completeness" or says("must not be blank", "not be null"):
        return blank()
    if dimension == "Uniqueness" or says("must be unique", "not have duplicates"):
        return Check("unique", F.when(shown.isNotNull(), F.struct(shown.alias("v"))), " duplicate values, e.g. ", True, is_text)
    allowed = allowed_values(rule)
    if allowed:
        return bad(~F.lower(trimmed).isin([v.lower() for v in allowed]), " values not in allowed list, e.g. ", trimmed, True)
    decimals = max_decimals(rule)
    if decimals is not None:
        return bad(numbers.more_decimals(number, decimals), f" values exceed {decimals} decimal places, e.g. ", quoted=False)
    if says("must be a numeric", "must be numeric"):
        return bad(shown.isNotNull() & number.isNull(), " non-numeric values, e.g. ")
    if says("must be a valid string"):
        return blank()
    size = max_chars(rule)
    if size or dimension == "Character Length":
        return bad(F.length(shown) > size, f" values exceed {size} chars, e.g. ", quoted=True) if size else Check("none")
    if says("uppercase", "upper case"):
        return bad(full & (trimmed != F.upper(trimmed)), " values not uppercase, e.g. ", trimmed, True)
    if says("lowercase", "lower case"):
        return bad(full & (trimmed != F.lower(trimmed)), " values not lowercase, e.g. ", trimmed, True)
    if says("alphanumeric") and not says("no special"):
        ok = trimmed.rlike(f"^[A-Za-z0-9{text.SPACE_CLASS}]+$")
        return bad(full & ~ok, " values contain non-alphanumeric chars, e.g. ", trimmed, True)
    if says("no special character"):
        ok = trimmed.rlike(f"^[A-Za-z0-9{text.SPACE_CLASS}\\-_.]+$")
        return bad(full & ~ok, " values contain special chars, e.g. ", trimmed, True)
    if says("reasonable length"):
        check = bad(F.length(shown) > 255, " values exceed 255 chars", quoted=True)
        check.examples = False
        return check
    if says("consistent casing", "consistent naming"):
        return Check("casing", F.when(shown.isNotNull(), F.struct(trimmed.alias("v"))), "Inconsistent casing: ")
    bounds = value_range(rule)
    if bounds:
        lo, hi = bounds
        return bad((number < lo) | (number > hi), f" values outside range [{lo}, {hi}], e.g. ", quoted=False)
    if says("valid string"):
        return blank()
    if says("should follow") and says("format"):
        mask = F.regexp_replace(F.regexp_replace(trimmed, r"\p{Nd}", "N"), "[A-Za-z]", "A")
        return Check("mask", F.when(shown.isNotNull(), F.struct(mask.alias("v"))), "Multiple formats detected: ")
    if says("conform to expected") and says("text format", "string format"):
        return blank(" blank/empty values")
    if says("consistently reflect", "should maintain consistent"):
        return Check("casing", F.when(shown.isNotNull(), F.struct(trimmed.alias("v"))), "Inconsistent values: ")
    if dimension in ("Relevance", "Accuracy") and says("should reflect"):
        return Check("none", status="manual_review", fixed="Manual review recommended — cannot auto-validate semantic accuracy")
    return Check("none", status="unrecognised")


def read_statement(df: DataFrame, column: str, statement: str, as_of: dt.datetime) -> Check:
    """The check a plain statement asks for (V16-V19): only NULL is blank, and NULLs can repeat."""
    if column not in df.columns:
        return Check("none", status="column_missing", fixed="Column not found in dataset")
    dtype = df.schema[column].dataType
    raw = numbers.clean(col(column), dtype)
    shown = raw if dtypes.is_text(dtype) else numbers.plain_text(raw, dtype)
    number = numbers.to_number(raw, dtype)
    low = statement.lower()

    def says(*phrases: str) -> bool:
        return any(p in low for p in phrases)

    def bad(test: Column) -> Check:
        return Check("rows", F.when(test, F.struct(shown.alias("v"))), examples=True, quoted=False)

    if says("not be blank", "not be null"):
        return bad(raw.isNull())
    if says("unique"):
        return Check("unique", F.struct(shown.alias("v")), examples=True, quoted=False)
    if says("valid calendar date", "valid date"):
        return bad(raw.isNotNull() & parse_date(raw, dtype).isNull())
    if says("not be future dated", "not be in the future"):
        return bad(parse_date(raw, dtype) > F.lit(as_of))
    if re.search(r"\bnumeric\b", low):  # as a word, so that "alphanumeric" reaches its own check
        return bad(raw.isNotNull() & number.isNull())
    if says("not be negative"):
        return bad(number < 0)
    if says("only digits"):
        return bad(~shown.rlike(r"^\p{Nd}+$"))
    if says("email"):
        return bad(~shown.rlike(text.EMAIL))
    if says("alphanumeric"):
        return bad(~shown.rlike("^[a-zA-Z0-9]+$"))
    size = re.search(r"maximum (\d+) character", low)
    if size:
        return bad(F.length(shown) > int(size.group(1)))
    return Check("none", status="unrecognised")


def _rule_rows(rules) -> list[dict]:
    rows = [r.asDict() for r in rules.collect()] if isinstance(rules, DataFrame) else [dict(r) for r in rules]
    return [{"s_no": i + 1, **r} if r.get("s_no") is None else r for i, r in enumerate(rows)]


def validate(df: DataFrame, rules, style: str = "dimension", as_of: dt.datetime | None = None) -> DataFrame:
    """The rule table with ``issues_found``, ``issues_found_example`` and ``status``.

    ``rules`` is a DataFrame or a list of dicts with column, dimension, data_quality_rule. Style
    ``dimension`` reads rules as V01-V15 do, ``statement`` as V16-V19 do.
    """
    as_of = as_of or dt.datetime.now()
    rows = _rule_rows(rules)
    checks = [
        read_rule(df, r["column"], r.get("dimension") or "", r["data_quality_rule"]) if style == "dimension"
        else read_statement(df, r["column"], r["data_quality_rule"], as_of)
        for r in rows
    ]
    extra = [k for k in ("business_field", "source", "regex_pattern") if rows and k in rows[0]]
    table = df.sparkSession.createDataFrame(
        [
            (i, r["s_no"], r["column"], r.get("dimension") or "", r["data_quality_rule"], *[r.get(k) for k in extra],
             c.kind, c.says, c.examples, c.quoted, c.status, c.fixed)
            for i, (r, c) in enumerate(zip(rows, checks))
        ],
        "rule int, s_no int, column string, dimension string, data_quality_rule string, "
        + "".join(f"{k} string, " for k in extra)
        + "kind string, says string, examples boolean, quoted boolean, status string, fixed string",
    )
    scanned = [(i, c) for i, c in enumerate(checks) if c.kind != "none"]
    if not scanned:
        found = df.sparkSession.createDataFrame([], "rule int, issues bigint, distinct_values bigint, sample array<string>")
    else:
        found = _findings(df, scanned, style)
    # Both sides have one row per rule.
    out = table.join(F.broadcast(found), "rule", "left")
    issues = F.coalesce("issues", F.lit(0))
    quote = lambda v: F.when(F.col("quoted"), F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v)
    if style == "dimension":
        listed = F.array_join(F.transform("sample", quote), ", ")
        more = F.when((F.col("kind") == "rows") & (F.col("distinct_values") > 5), F.concat(F.lit(" ... and "), (F.col("distinct_values") - 5).cast("string"), F.lit(" more"))).otherwise("")
        message = (
            F.when(F.col("kind") == "none", F.col("fixed")).when(issues == 0, F.lit(VALID))
            .when(F.col("kind") == "casing", F.concat("says", F.array_join("sample", "; ")))
            .when(F.col("kind") == "mask", F.concat("says", F.array_join(F.transform("sample", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")))
            .when(F.col("examples"), F.concat(issues.cast("string"), F.col("says"), listed, more))
            .otherwise(F.concat(issues.cast("string"), F.col("says")))
        )
    else:
        cut = lambda v: F.when(F.length(text.strip(v)) > 50, F.concat(F.substring(text.strip(v), 1, 47), F.lit("..."))).otherwise(text.strip(v))
        listed = F.array_join(F.transform("sample", lambda v: cut(F.coalesce(v, F.lit("NULL")))), "; ")
        message = F.when(issues == 0, F.when(F.col("kind") == "none", F.col("fixed")).otherwise(VALID)).otherwise(listed)
    return out.select(
        "s_no", "column", *extra, "dimension", "data_quality_rule", issues.cast("bigint").alias("issues_found"),
        message.alias("issues_found_example"), "status",
    )


def _findings(df: DataFrame, scanned: list[tuple[int, Check]], style: str) -> DataFrame:
    made = df.select(*[c.cell.alias(f"cell{i}") for i, c in scanned])  # each cell is computed once
    cells = made.select(
        F.explode(
            F.array_compact(
                F.array(*[F.when(F.col(f"cell{i}").isNotNull(), F.struct(F.lit(i).alias("rule"), F.col(f"cell{i}.v").cast("string").alias("v"))) for i, _ in scanned])
            )
        ).alias("x")
    ).select("x.*")
    counted = cells.groupBy("rule", "v").agg(F.count(F.lit(1)).alias("n"))
    of = {k: [i for i, c in scanned if c.kind == k] for k in ("rows", "unique", "casing", "mask")}
    parts = []
    listed = of["rows"] + of["unique"]
    if listed:
        hits = counted.filter(F.col("rule").isin(listed) & (~F.col("rule").isin(of["unique"]) | (F.col("n") > 1)) if of["unique"] else F.col("rule").isin(listed))
        totals = hits.groupBy("rule").agg(F.sum("n").cast("bigint").alias("issues"), F.count(F.lit(1)).alias("distinct_values"))
        by_value = Window.partitionBy("rule").orderBy("v")
        keep = 5
        if style == "statement" and of["unique"]:
            times = F.concat(F.coalesce("v", F.lit("NULL")), F.lit(" ("), F.col("n").cast("string"), F.lit(" times)"))
            repeated = Window.partitionBy("rule").orderBy(F.desc("n"), "v")
            top = hits.filter(F.col("rule").isin(of["unique"])).withColumn("r", F.row_number().over(repeated)).filter("r <= 3").select("rule", "r", times.alias("v"))
            rest = hits.filter(~F.col("rule").isin(of["unique"])).withColumn("r", F.row_number().over(by_value)).filter(f"r <= {keep}").select("rule", "r", "v")
            samples = top.unionByName(rest)
        else:
            samples = hits.withColumn("r", F.row_number().over(by_value)).filter(f"r <= {keep}").select("rule", "r", "v")
        parts.append(totals.join(_listed(samples), "rule", "left"))
    if of["casing"]:
        spelled = (
            counted.filter(F.col("rule").isin(of["casing"])).groupBy("rule", F.lower("v").alias("k"))
            .agg(F.count(F.lit(1)).alias("spellings"), F.min("v").alias("a"), F.max("v").alias("b")).filter("spellings > 1")
        )
        totals = spelled.groupBy("rule").agg(F.sum("spellings").cast("bigint").alias("issues"), F.count(F.lit(1)).alias("distinct_values"))
        first = Window.partitionBy("rule").orderBy("k")
        samples = spelled.withColumn("r", F.row_number().over(first)).filter("r <= 3").select("rule", "r", F.concat("a", F.lit(" vs "), "b").alias("v"))
        parts.append(totals.join(_listed(samples), "rule", "left"))
    if of["mask"]:
        masks = counted.filter(F.col("rule").isin(of["mask"]))
        totals = masks.groupBy("rule").agg(F.sum("n").cast("bigint").alias("issues"), F.count(F.lit(1)).alias("distinct_values")).filter("distinct_values > 1")
        first = Window.partitionBy("rule").orderBy("v")
        samples = masks.withColumn("r", F.row_number().over(first)).filter("r <= 4").select("rule", "r", "v")
        parts.append(totals.join(_listed(samples), "rule", "left"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _listed(samples: DataFrame) -> DataFrame:
    """At most five sample rows per rule, gathered into one array."""
    return samples.groupBy("rule").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("sample")
    )
