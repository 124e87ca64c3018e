"""Table-level quality: scores, key figures, top issues and report rows.

Most of these read a column profile (one row per column), so they are small by nature; only the
duplicate count looks at the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import dtypes, text
from plumbline.operators.profile import profile as make_profile
from plumbline.operators.quantiles import col


def duplicate_row_count(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of every group of equal rows; all-NULL rows do not count (Q02)."""
    keys = row_keys(df, subset)
    groups = df.filter(any_value(df, subset)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("exact_duplicate_rows"))


def row_keys(df: DataFrame, subset: list[str] | None = None) -> list[Column]:
    """Grouping expressions for whole rows: long texts as digests, nested values as JSON."""
    fields = [df.schema[c] for c in (subset or df.columns)]
    keys = []
    for i, f in enumerate(fields):
        c = col(f.name)
        if dtypes.is_text(f.dataType):
            c = text.compact_key(c)
        elif dtypes.label(f.dataType) == "Nested":
            c = text.compact_key(F.to_json(c))
        elif dtypes.kind(f.dataType) == "float":
            c = F.when(~F.isnan(c), c)
        keys.append(c.alias(f"k{i}"))
    return keys


def any_value(df: DataFrame, subset: list[str] | None = None) -> Column:
    """True for rows with at least one value (NaN counts as none)."""
    return F.coalesce(*[k.cast("string") for k in row_keys(df, subset)]).isNotNull()


def report(df: DataFrame, profile: DataFrame | None = None, fast: bool = False) -> DataFrame:
    """One row: sizes, missing cells, duplicate rows, columns with issues, overall score (Q01-Q04)."""
    profile = make_profile(df, fast=fast, samples=False) if profile is None else profile
    issue = (F.col("null_count") > 0) | (F.size("special_chars") > 0) | (F.col("outlier_count") > 0)
    summary = profile.agg(
        F.max("total_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("null_count").cast("bigint").alias("missing_cells"),
        F.array_sort(F.collect_list(F.when(issue, F.col("column")))).alias("columns_with_issues"),
    )
    duplicates = duplicate_row_count(df)
    cells = F.col("total_rows") * F.col("total_columns")
    rows = F.greatest("total_rows", F.lit(1))
    both = summary.crossJoin(F.broadcast(duplicates)).withColumns(
        {
            "total_cells": cells,
            "missing_percentage": F.when(cells > 0, F.col("missing_cells") * 100.0 / cells).otherwise(F.lit(0.0)),
            "exact_duplicate_percentage": F.col("exact_duplicate_rows") * 100.0 / rows,
        }
    )
    score = (
        100.0
        - F.least(F.col("missing_percentage") * 1.5, F.lit(25.0))
        - F.least(F.col("exact_duplicate_percentage") * 0.5, F.lit(20.0))
        - F.least(F.size("columns_with_issues") * 20.0 / F.greatest("total_columns", F.lit(1)), F.lit(20.0))
    )
    return both.withColumn("overall_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def api_summary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nine fields per column, and the table row, from the fast profile (Q05)."""
    prof = make_profile(df, fast=True, samples=False)
    columns = prof.select(
        F.col("column").alias("column_name"), "dtype", "total_rows", "null_count",
        F.round("null_percentage", 2).alias("null_percentage"), "unique_count",
        F.round("unique_percentage", 2).alias("unique_percentage"), "risk_level", "risk_score",
    )
    table = report(df, prof, fast=True).select(
        "total_rows", "total_columns", F.round("overall_score", 2).alias("overall_score"),
        F.round("missing_percentage", 2).alias("missing_percentage"),
    )
    return columns, table


def _scaled_uniqueness() -> Column:
    return F.when(F.col("unique_percentage") < 100, F.least(F.lit(100.0), F.col("unique_percentage") * 1.2)).otherwise(F.lit(90.0))


def executive_score(profile: DataFrame) -> DataFrame:
    """Both executive scores: by case and special characters (Q06), and by risk (Q07)."""
    consistency = F.when(F.col("consistent_case"), 100.0).otherwise(80.0)
    validity = 100.0 - F.least(F.lit(20.0), F.size("special_chars") * 2.0)
    v1 = F.col("non_null_percentage") * 0.4 + _scaled_uniqueness() * 0.3 + consistency * 0.2 + validity * 0.1
    v2 = F.col("non_null_percentage") * 0.5 + _scaled_uniqueness() * 0.3 + (100.0 - F.col("risk_score")) * 0.2
    return profile.agg(F.round(F.avg(v1), 1).alias("quality_v1"), F.avg(v2).alias("quality_v2"))


def key_figures(profile: DataFrame) -> DataFrame:
    """Completeness, fill rate, average NULL %, high-risk columns, share of columns with repeats (Q08)."""
    rows, columns = F.max("total_rows"), F.count(F.lit(1))
    cells = rows * columns
    filled = F.when(cells > 0, (cells - F.sum("null_count")) * 100.0 / cells).otherwise(F.lit(0.0))
    return profile.agg(
        filled.alias("completeness"), filled.alias("fill_rate"), F.avg("null_percentage").alias("avg_null_percentage"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_columns"),
        (F.count_if(F.col("duplicate_count") > 0) * 100.0 / columns).alias("duplicate_column_share"),
    )


def executive_summary(profile: DataFrame) -> DataFrame:
    """(metric, value) rows; the score is the mean share of values present (Q09)."""
    figures = profile.agg(
        F.max("total_rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
        F.sum("null_count").cast("bigint").alias("missing"), F.avg("non_null_percentage").alias("score"),
    )
    cells = F.col("rows") * F.col("columns")
    complete = F.format_string("%.2f%%", F.bround((cells - F.col("missing")) * 100.0 / F.nullif(cells, F.lit(0)), 2))
    values = {
        "Total Rows": F.col("rows").cast("string"), "Total Columns": F.col("columns").cast("string"),
        "Total Cells": cells.cast("string"), "Missing Cells": F.col("missing").cast("string"),
        "Completeness %": F.when(cells > 0, complete).otherwise(F.lit("N/A")),
        "Quality Score": F.format_string("%.1f%%", F.bround("score", 1)),
    }
    return figures.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()]))
    )


def score_band(score: Column) -> Column:
    """Excellent / Good / Fair / Critical (Q10)."""
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Fair").otherwise("Critical")


def health_status(report_row: DataFrame) -> DataFrame:
    """Short statements on missing data and duplicates (Q11)."""
    missing, dups = F.col("missing_percentage"), F.col("exact_duplicate_rows")
    lines = F.array(
        F.when(missing < 5, "Low missing data (< 5%)").when(missing < 20, "Moderate missing data (5-20%)")
        .otherwise("High missing data (> 20%)"),
        F.when(dups == 0, "No exact duplicates found").otherwise(F.concat(F.format_number(dups, 0), F.lit(" duplicate rows detected"))),
    )
    return report_row.select(F.explode(lines).alias("status"))


def top_issues(profile: DataFrame, report_row: DataFrame) -> DataFrame:
    """(severity, message), critical first (Q12)."""
    missing = F.round("missing_percentage", 2)
    missing_text = F.concat(missing.cast("string"), F.lit("% of cells are empty"))
    share = F.round(F.col("exact_duplicate_rows") * 100.0 / F.greatest("total_rows", F.lit(1)), 1)
    dup_text = F.concat(
        F.format_number("exact_duplicate_rows", 0), F.lit(" duplicate rows ("), share.cast("string"), F.lit("%)")
    )

    def issue(test: Column, severity, message: Column) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(test, F.struct(level.alias("severity"), message.alias("message")))

    def explode(frame: DataFrame, *items: Column) -> DataFrame:
        return frame.select(F.inline(F.array_compact(F.array(*items))))

    whole = explode(
        report_row,
        issue(missing > 20, "critical", F.concat(F.lit("High missing data rate: "), missing_text)),
        issue((missing > 5) & (missing <= 20), "warning", F.concat(F.lit("Missing data: "), missing_text)),
        issue(F.col("exact_duplicate_rows") > 0, F.when(share > 10, "critical").otherwise("warning"), dup_text),
    )
    quoted = F.concat(F.lit("'"), F.col("column"), F.lit("'"))
    per_column = explode(
        profile,
        issue(F.col("risk_level") == "High", "critical", F.concat(F.lit("Column "), quoted, F.lit(" has HIGH risk (score "), F.col("risk_score").cast("string"), F.lit(")"))),
        issue(F.col("null_percentage") > 50, "warning", F.concat(F.lit("Column "), quoted, F.lit(" is more than 50% null"))),
    )
    violations = profile.select(quoted.alias("q"), F.explode("business_rule_violations").alias("v")).select(
        F.lit("info").alias("severity"), F.concat("q", F.lit(": "), "v").alias("message")
    )
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return whole.unionByName(per_column).unionByName(violations).orderBy(rank, "message")


def risk_distribution(profile: DataFrame) -> DataFrame:
    """Columns per risk level (Q13)."""
    return profile.groupBy("risk_level").agg(F.count(F.lit(1)).alias("columns"))


def top_columns(profile: DataFrame, by: str, limit: int) -> DataFrame:
    """Columns with the highest value of a profile metric (Q14)."""
    chosen = profile.filter("null_percentage > 0") if by == "null_percentage" else profile
    return chosen.orderBy(F.desc(by), "position").limit(limit).select("column", by)


def length_averages(profile: DataFrame) -> DataFrame:
    """Mean of the minimum, average and maximum length over all columns (Q15)."""
    return profile.agg(
        F.avg("min_length").alias("min_length"), F.avg("avg_length").alias("avg_length"), F.avg("max_length").alias("max_length")
    )


def rule_totals(results: DataFrame) -> DataFrame:
    """Rules, columns covered, dimensions, issues over a validated rule table (Q16)."""
    return results.agg(
        F.count(F.lit(1)).alias("rules"), F.count_distinct("column").alias("columns_covered"),
        F.count_distinct("dimension").alias("dimensions"), F.sum("issues_found").cast("bigint").alias("issues"),
    )


def dimension_summary(results: DataFrame) -> DataFrame:
    """Rules and issues per dimension, most rules first (Q17)."""
    return (
        results.groupBy("dimension").agg(F.count(F.lit(1)).alias("rule_count"), F.sum("issues_found").cast("bigint").alias("total_issues"))
        .orderBy(F.desc("rule_count"), "dimension")
    )


def report_tables(profile: DataFrame, report_row: DataFrame, max_issue_columns: int | None = None) -> dict[str, DataFrame]:
    """Row sets of the profiling report: columns, key issues, recommendations (Q18)."""
    flagged = report_row.select(F.explode("columns_with_issues" if max_issue_columns is None else F.slice("columns_with_issues", 1, max_issue_columns)).alias("column"))

    def counted(n: str, p: str) -> Column:
        return F.concat(F.col(n).cast("string"), F.lit(" ("), F.format_string("%.1f", F.bround(p, 1)), F.lit("%)"))

    return {
        "columns": profile.select(
            "column", F.col("label").alias("type"), counted("null_count", "null_percentage").alias("nulls"),
            counted("unique_count", "unique_percentage").alias("unique"), "duplicate_count", "memory_usage",
            "risk_level", "risk_score",
        ),
        "issues": profile.join(F.broadcast(flagged), "column", "left_semi").select("column", F.explode("key_issues").alias("issue")),
        "recommendations": profile.select("column", F.inline("cleansing_recommendations")),
    }


def json_report(profile: DataFrame, rules: DataFrame, generated_at: str) -> DataFrame:
    """The profiling report as one JSON text: metadata, summary, columns, match rules."""
    columns = F.map_from_entries(
        F.collect_list(
            F.struct("column", F.struct(F.col("dtype").alias("type"), "null_percentage", "unique_percentage", "duplicate_count"))
        )
    )
    head = profile.agg(
        F.max("total_rows").alias("total_rows"), F.count(F.lit(1)).alias("total_columns"),
        F.sum("null_count").cast("bigint").alias("missing_cells"),
        F.format_string("%.2f%%", F.bround(F.avg("non_null_percentage"), 2)).alias("completeness"),
        columns.alias("column_profiles"),
    )
    matched = rules.agg(F.sort_array(F.collect_list(F.struct(*rules.columns))).alias("match_rules"))
    return head.crossJoin(F.broadcast(matched)).select(
        F.to_json(
            F.struct(
                F.struct(F.lit(generated_at).alias("generated_at"), "total_rows", "total_columns").alias("metadata"),
                F.struct("missing_cells", "completeness").alias("executive_summary"),
                "column_profiles", "match_rules",
            )
        ).alias("report")
    )
