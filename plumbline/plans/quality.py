"""Table-level quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import duplicates as D, quality as K, select as S
from plumbline.plans import query
from plumbline.plans.inputs import table
from plumbline.plans.profiles import ASSESSED, both_profiles, prof

# One row per column of the customer table with gaps: what the SQL below needs of a profile.
_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "segment", "balance"]
_FACTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {i} AS position, count(*) AS n, count(*) - count({c}) AS nulls, (count(*) - count({c})) * 100.0 / count(*) AS np,
    100.0 - (count(*) - count({c})) * 100.0 / count(*) AS nn, count(DISTINCT {c}) * 100.0 / count(*) AS up, count(DISTINCT {c}) AS u, count(*) - count(DISTINCT {c}) AS dups,
    {'count(*)' if c == 'c_name' else '0'} AS sp, {"(SELECT count_if(z.balance < lo OR z.balance > hi) FROM gappy_customer z, (SELECT quantile_cont(balance, 0.25) - 1.5 * (quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25)) AS lo, quantile_cont(balance, 0.75) + 1.5 * (quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25)) AS hi FROM gappy_customer))" if c == 'balance' else '0'} AS ol,
    {f"coalesce(min(length({c})), 0)" if c in ('c_name', 'segment') else '0'} AS minl, {f"coalesce(max(length({c})), 0)" if c in ('c_name', 'segment') else '0'} AS maxl,
    {f"coalesce(avg(length({c})), 0)" if c in ('c_name', 'segment') else '0.0'} AS avgl FROM gappy_customer"""
    for i, c in enumerate(_COLUMNS)
)
_RISKY = f"""(SELECT *, CASE WHEN np > 50 THEN 40 WHEN np > 20 THEN 20 ELSE 0 END + CASE WHEN 100 - up > 50 AND u > 5 THEN 30 ELSE 0 END
  + CASE WHEN sp * 100.0 / n > 10 THEN 15 ELSE 0 END + CASE WHEN ol > 0 THEN 10 ELSE 0 END AS risk FROM ({_FACTS}))"""
_SURPLUS = "(SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM {t} GROUP BY ALL))"


def customer(spark, sf):
    return prof(spark, sf, "gappy_customer")


@query("quality_report", "Q01 Q02 Q03 Q04", f"""SELECT total_rows, total_columns, total_cells, missing_cells, round(missing_cells * 100.0 / total_cells, 6) AS missing_percentage, exact_duplicate_rows,
  issue_columns, round(100.0 - least(missing_cells * 150.0 / total_cells, 25.0) - least(exact_duplicate_rows * 50.0 / total_rows, 20.0) - least(k * 20.0 / total_columns, 20.0), 6) AS overall_score
  FROM (SELECT max(n) AS total_rows, count(*) AS total_columns, max(n) * count(*) AS total_cells, CAST(sum(nulls) AS BIGINT) AS missing_cells,
  (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM gappy_customer GROUP BY c_custkey, c_name, c_nationkey, segment, balance)) AS exact_duplicate_rows,
  string_agg(CASE WHEN nulls > 0 OR sp > 0 OR ol > 0 THEN "column" END, ',' ORDER BY "column") AS issue_columns, count_if(nulls > 0 OR sp > 0 OR ol > 0) AS k FROM ({_FACTS}))""")
def _(spark, sf):
    df = table(spark, sf, "gappy_customer")
    return K.report(df, customer(spark, sf)).select(
        "total_rows", "total_columns", "total_cells", "missing_cells", F.round("missing_percentage", 6).alias("missing_percentage"), "exact_duplicate_rows",
        F.array_join("columns_with_issues", ",").alias("issue_columns"), F.round("overall_score", 6).alias("overall_score"),
    )


@query("duplicate_row_count", "Q02", """SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS exact_duplicate_rows FROM (SELECT count(*) AS k FROM messy WHERE label IS NOT NULL OR body IS NOT NULL GROUP BY label, body)
  UNION ALL SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)""")
def _(spark, sf):
    a = K.duplicate_row_count(table(spark, sf, "messy"), ["label", "body"])
    return a.unionByName(K.duplicate_row_count(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"]))


@query("fast_summary_columns", "Q05")
def _(spark, sf):
    return K.api_summary(table(spark, sf, "lineitem"))[0]


@query("fast_summary_table", "Q05", """SELECT count(*) AS total_rows, CAST(5 AS BIGINT) AS total_columns, round((count(*) - count(segment) + count(*) - count(balance)) * 100.0 / (5 * count(*)), 2) AS missing_percentage FROM gappy_customer""")
def _(spark, sf):
    return K.api_summary(table(spark, sf, "gappy_customer"))[1].drop("overall_score")


_UNIQ = "CASE WHEN up < 100 THEN least(100.0, up * 1.2) ELSE 90.0 END"


@query("executive_scores", "Q06 Q07", f"""SELECT round(avg(nn * 0.4 + ({_UNIQ}) * 0.3 + 20.0 + (100.0 - least(20.0, CASE WHEN sp > 0 THEN 2.0 ELSE 0.0 END)) * 0.1), 1) AS quality_v1,
  round(avg(nn * 0.5 + ({_UNIQ}) * 0.3 + (100.0 - risk) * 0.2), 6) AS quality_v2 FROM {_RISKY}""")
def _(spark, sf):
    return K.executive_score(customer(spark, sf)).withColumn("quality_v2", F.round("quality_v2", 6))


@query("key_figures", "Q08", f"""SELECT round((max(n) * count(*) - sum(nulls)) * 100.0 / (max(n) * count(*)), 6) AS completeness, round((max(n) * count(*) - sum(nulls)) * 100.0 / (max(n) * count(*)), 6) AS fill_rate,
  round(avg(np), 6) AS avg_null_percentage, CAST(count_if(risk >= 60) AS BIGINT) AS high_risk_columns, round(count_if(dups > 0) * 100.0 / count(*), 6) AS duplicate_column_share FROM {_RISKY}""")
def _(spark, sf):
    k = K.key_figures(customer(spark, sf))
    return k.select(*[F.round(c, 6).alias(c) for c in ("completeness", "fill_rate", "avg_null_percentage", "duplicate_column_share")], "high_risk_columns")


@query("executive_summary", "Q09", f"""WITH f AS (SELECT max(n) AS r, count(*) AS c, CAST(sum(nulls) AS BIGINT) AS m, avg(nn) AS s FROM ({_FACTS}))
  SELECT 'Total Rows' AS metric, '' || r AS "value" FROM f UNION ALL SELECT 'Total Columns', '' || c FROM f UNION ALL SELECT 'Total Cells', '' || (r * c) FROM f UNION ALL SELECT 'Missing Cells', '' || m FROM f
  UNION ALL SELECT 'Completeness %', printf('%.2f', (r * c - m) * 100.0 / (r * c)) || '%' FROM f UNION ALL SELECT 'Quality Score', printf('%.1f', s) || '%' FROM f""")
def _(spark, sf):
    return K.executive_summary(customer(spark, sf))


@query("score_bands", "Q10", """SELECT band, count(*) AS orders FROM (SELECT CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 75 THEN 'Good' WHEN s >= 60 THEN 'Fair' ELSE 'Critical' END AS band
  FROM (SELECT o_orderkey % 101 AS s FROM orders)) GROUP BY band""")
def _(spark, sf):
    return table(spark, sf, "orders").select(K.score_band(F.col("o_orderkey") % 101).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("orders"))


@query("health_status", "Q11", f"""WITH f AS (SELECT sum(nulls) * 100.0 / sum(n) AS p FROM ({_FACTS}))
  SELECT CASE WHEN p < 5 THEN 'Low missing data (< 5%)' WHEN p < 20 THEN 'Moderate missing data (5-20%)' ELSE 'High missing data (> 20%)' END AS status FROM f
  UNION ALL SELECT 'No exact duplicates found' FROM (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM gappy_customer)) WHERE k = (SELECT count(*) FROM gappy_customer)""")
def _(spark, sf):
    return K.health_status(K.report(table(spark, sf, "gappy_customer"), customer(spark, sf)))


@query("top_issues", "Q12", f"""WITH f AS (SELECT round(sum(nulls) * 100.0 / sum(n), 2) AS p FROM ({_FACTS}))
  SELECT 'critical' AS severity, 'High missing data rate: ' || p || '% of cells are empty' AS message FROM f WHERE p > 20
  UNION ALL SELECT 'warning', 'Missing data: ' || p || '% of cells are empty' FROM f WHERE p > 5 AND p <= 20
  UNION ALL SELECT 'critical', 'Column ''' || "column" || ''' has HIGH risk (score ' || risk || ')' FROM {_RISKY} WHERE risk >= 60
  UNION ALL SELECT 'warning', 'Column ''' || "column" || ''' is more than 50% null' FROM {_RISKY} WHERE np > 50
  UNION ALL SELECT 'info', '''balance'': Negative values detected (' || count_if(balance < 0) || ' rows) - Verify if allowed' FROM gappy_customer HAVING count_if(balance < 0) > 0""")
def _(spark, sf):
    p = customer(spark, sf)
    return K.top_issues(p, K.report(table(spark, sf, "gappy_customer"), p))


@query("risk_distribution", "Q13", f"""SELECT CASE WHEN p >= 60 THEN 'High' WHEN p >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level, count(*) AS columns FROM (SELECT CASE WHEN np > 50 THEN 40 WHEN np > 20 THEN 20 ELSE 0 END
  + CASE WHEN 100 - up > 50 AND u > 5 THEN 30 ELSE 0 END + CASE WHEN sp * 100.0 / n > 10 THEN 15 ELSE 0 END + CASE WHEN ol > 0 THEN 10 ELSE 0 END AS p FROM ({ASSESSED})) GROUP BY 1""")
def _(spark, sf):
    return K.risk_distribution(both_profiles(spark, sf))


@query("top_columns", "Q14", f"""SELECT * FROM (SELECT 'null' AS metric, "column", round(np, 6) AS "value" FROM ({_FACTS}) WHERE np > 0 ORDER BY np DESC, position LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'non_null', "column", CAST(n - nulls AS DOUBLE) FROM ({_FACTS}) ORDER BY n - nulls DESC, position LIMIT 15)
  UNION ALL SELECT * FROM (SELECT 'unique', "column", CAST(u AS DOUBLE) FROM ({_FACTS}) ORDER BY u DESC, position LIMIT 15)""")
def _(spark, sf):
    p = customer(spark, sf)
    out = None
    for name, by, limit in (("null", "null_percentage", 10), ("non_null", "non_null_count", 15), ("unique", "unique_count", 15)):
        one = K.top_columns(p, by, limit).select(F.lit(name).alias("metric"), "column", F.round(F.col(by).cast("double"), 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("length_averages", "Q15", f"SELECT round(avg(minl), 6) AS min_length, round(avg(avgl), 6) AS avg_length, round(avg(maxl), 6) AS max_length FROM ({_FACTS})")
def _(spark, sf):
    return K.length_averages(customer(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("min_length", "avg_length", "max_length")])


def counted_rules(spark, sf):
    rows = table(spark, sf, "rule_rows")
    return rows.select(F.col("column_name").alias("column"), "dimension", (F.col("s_no") % 13).alias("issues_found"))


@query("rule_totals", "Q16", "SELECT count(*) AS rules, count(DISTINCT column_name) AS columns_covered, count(DISTINCT dimension) AS dimensions, CAST(sum(s_no % 13) AS BIGINT) AS issues FROM rule_rows")
def _(spark, sf):
    return K.rule_totals(counted_rules(spark, sf))


@query("dimension_summary", "Q16 Q17", "SELECT dimension, count(*) AS rule_count, CAST(sum(s_no % 13) AS BIGINT) AS total_issues FROM rule_rows GROUP BY dimension")
def _(spark, sf):
    return K.dimension_summary(counted_rules(spark, sf))


@query("report_columns", "Q18", f"""SELECT "column", nulls || ' (' || printf('%.1f', np) || '%)' AS nulls, u || ' (' || printf('%.1f', up) || '%)' AS "unique", dups AS duplicate_count,
  CASE WHEN risk >= 60 THEN 'High' WHEN risk >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level, risk AS risk_score FROM {_RISKY}""")
def _(spark, sf):
    p = customer(spark, sf)
    return K.report_tables(p, K.report(table(spark, sf, "gappy_customer"), p, fast=True))["columns"].drop("type", "memory_usage")


@query("report_issues", "Q18", f"""SELECT "column", 'High missing value rate' AS issue FROM {_RISKY} WHERE np > 20 AND np <= 50 UNION ALL SELECT "column", 'High duplication rate in potential identifier' FROM {_RISKY} WHERE 100 - up > 50 AND u > 5 AND (nulls > 0 OR sp > 0 OR ol > 0)
  UNION ALL SELECT "column", 'Frequent special characters - potential ingestion risk' FROM {_RISKY} WHERE sp * 100.0 / n > 10 UNION ALL SELECT "column", 'Statistical outliers detected' FROM {_RISKY} WHERE ol > 0""")
def _(spark, sf):
    p = customer(spark, sf)
    return K.report_tables(p, K.report(table(spark, sf, "gappy_customer"), p, fast=True))["issues"]


@query("report_recommendations", "Q18", f"""SELECT "column", 'Impute/Flag' AS action, nulls || ' rows' AS impact FROM {_RISKY} WHERE np >= 5 UNION ALL SELECT "column", 'Clean Strings', sp || ' rows' FROM {_RISKY} WHERE sp > 0""")
def _(spark, sf):
    p = customer(spark, sf)
    return K.report_tables(p, K.report(table(spark, sf, "gappy_customer"), p, fast=True))["recommendations"].drop("description")


@query("profile_listing", "P11", f"""SELECT 'with_issues' AS listing, "column" FROM {_RISKY} WHERE nulls > 0 OR sp > 0 OR ol > 0 UNION ALL SELECT 'high_missing', "column" FROM {_RISKY} WHERE np > 10
  UNION ALL SELECT 'low_cardinality', "column" FROM {_RISKY} WHERE up < 5 UNION ALL SELECT 'numeric', "column" FROM {_RISKY} WHERE "column" IN ('c_custkey', 'c_nationkey', 'balance')
  UNION ALL SELECT 'named', "column" FROM {_RISKY} WHERE contains("column", 'name') UNION ALL SELECT 'high_risk', "column" FROM {_RISKY} WHERE risk >= 60""")
def _(spark, sf):
    p = customer(spark, sf)
    out = S.list_profiles(p, search="NAME", sort_by="risk").select(F.lit("named").alias("listing"), "column")
    for only in ("with_issues", "high_missing", "low_cardinality", "numeric", "high_risk"):
        out = out.unionByName(S.list_profiles(p, only, sort_by="null").select(F.lit(only).alias("listing"), "column"))
    return out


@query("json_report", "S23", f"""SELECT max(n) AS total_rows, count(*) AS total_columns, CAST(sum(nulls) AS BIGINT) AS missing_cells, printf('%.2f', avg(nn)) || '%' AS completeness FROM ({_FACTS})""")
def _(spark, sf):
    p = customer(spark, sf)
    report = K.json_report(p, D.suggest_match_rules(p), "2024-01-15")
    schema = "metadata struct<total_rows: bigint, total_columns: bigint>, executive_summary struct<missing_cells: bigint, completeness: string>"
    return report.select(F.from_json("report", schema).alias("r")).select("r.metadata.*", "r.executive_summary.*")
