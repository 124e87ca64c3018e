"""Applying rule lists to rows: cleaned rows on one side, rejected rows with a reason on the other.

All rules of all columns fold into one projection that carries the current values and the first
rejection, so the table is read once, without a shuffle, and good and rejected rows are two filters
over the same plan. The fold is row by row, which also makes it usable on streaming input.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import dtypes, numbers, text
from plumbline.operators.quantiles import col

# A column's rule settings and their defaults.
DEFAULTS = {
    "enabled": False, "mode": "Clean", "pattern": "", "replace": "", "case": "UPPERCASE", "length_mode": "Exact",
    "min_length": 0, "max_length": 50, "exact_length": 10, "applied_rules": [],
}


def apply_one(value: Column, rule: dict, null_policy: str = "reject") -> tuple[Column, Column]:
    """New value and rejection reason (NULL when kept) of one rule."""
    mode, kept = rule["mode"], F.lit(None).cast("string")
    pattern = text.java_regex(rule.get("pattern") or "")
    name = rule.get("name") or f"{mode} Rule"

    def reject(test: Column, why: str) -> Column:
        missing = value.isNull() if null_policy == "reject" else F.lit(False)
        return F.when(missing | F.coalesce(test, F.lit(False)), F.lit(f"{name} - {why}"))

    if mode == "Clean":
        return F.regexp_replace(value, pattern, ""), kept
    if mode == "Replace":
        return F.regexp_replace(value, pattern, text.java_replacement(rule.get("replace", ""))), kept
    if mode == "Extract":
        out = F.array_join(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), "")
        return out, reject(out == "", "No matches")
    if mode == "Validate":
        return value, reject(~text.matches(value, rule["pattern"]), "Does not match")
    if mode == "Case":
        change = {"UPPERCASE": F.upper, "lowercase": F.lower, "Title Case": text.title}
        return change[rule.get("case", "UPPERCASE")](value), kept
    if mode == "Length":
        n = F.length(value)
        low, high = rule.get("min_length", 0), rule.get("max_length", 50)
        tests = {
            "Exact": n != rule.get("exact_length", 10), "Minimum": n < low, "Maximum": n > high, "Range": (n < low) | (n > high),
        }
        return value, reject(tests[rule.get("length_mode", "Exact")], "Length check failed")
    raise ValueError(f"unknown rule mode: {mode}")


def _folded(df: DataFrame, rules: dict[str, list[dict]], null_policy: str) -> tuple[DataFrame, list[str]]:
    names = [f"__{c}" for c in ("reason", "column")]
    out = df.withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("string")})
    for column, steps in rules.items():
        if column not in df.columns:
            continue
        dtype = df.schema[column].dataType
        if not dtypes.is_text(dtype):
            out = out.withColumn(column, numbers.plain_text(col(column), dtype))
        for rule in steps:
            value, reason = apply_one(col(column), rule, null_policy)
            # A rejected row leaves the flow: later rules neither change it nor find another reason.
            open_ = col(names[0]).isNull()
            out = out.withColumns(
                {
                    column: F.when(open_, value).otherwise(col(column)),
                    names[0]: F.when(open_, reason).otherwise(col(names[0])),
                    names[1]: F.when(open_ & reason.isNotNull(), F.lit(column)).otherwise(col(names[1])),
                }
            )
    return out, names


def apply_rules(
    df: DataFrame, rules: dict[str, list[dict]], null_policy: str = "reject", at: dt.datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) after all rules in order.

    Rejected rows keep the values they had when they failed, plus rejection_reason,
    rejected_column and rejected_at. ``null_policy='keep'`` lets NULLs pass the checks.
    """
    at = at or dt.datetime.now()
    out, (reason, column) = _folded(df, rules, null_policy)
    good = out.filter(col(reason).isNull()).drop(reason, column)
    rejects = out.filter(col(reason).isNotNull()).select(
        *[col(c) for c in df.columns], col(reason).alias("rejection_reason"), col(column).alias("rejected_column"),
        F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).alias("rejected_at"),
    )
    return good, rejects


def enabled_rules(config: dict[str, dict]) -> dict[str, list[dict]]:
    """The rule lists of the enabled columns of a rule configuration."""
    return {c: s["applied_rules"] for c, s in config.items() if s.get("enabled") and s.get("applied_rules")}


def preview(df: DataFrame, column: str, rule: dict, order_by: str | None = None, n: int = 10) -> DataFrame:
    """before, after, status of one rule on ``n`` values."""
    dtype = df.schema[column].dataType
    head = df.filter(col(column).isNotNull())
    head = (head.orderBy(col(order_by)) if order_by else head).limit(n)
    before = col(column) if dtypes.is_text(dtype) else numbers.plain_text(col(column), dtype)
    value, reason = apply_one(F.col("before"), rule)
    return head.select(before.alias("before")).select(
        "before", F.when(reason.isNotNull(), "[REJECT]").otherwise(value).alias("after"),
        F.when(reason.isNotNull(), "Rejected").otherwise("Valid").alias("status"),
    )


# --- rule configurations as JSON (S21) ------------------------------------------------------


def export_config(config: dict[str, dict]) -> str:
    return json.dumps({"version": 1, "rules": {c: {k: s.get(k, d) for k, d in DEFAULTS.items()} for c, s in config.items()}}, indent=2)


def import_config(content: str, columns: list[str]) -> dict[str, dict]:
    """Settings of the columns that exist; unknown columns are dropped."""
    data = json.loads(content)
    rules = data.get("rules", data)
    return {c: {k: s.get(k, d) for k, d in DEFAULTS.items()} for c, s in rules.items() if c in columns}
