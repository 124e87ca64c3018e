"""Comparison and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import compare as M
from plumbline.operators.profile import profile
from plumbline.plans import query
from plumbline.plans.inputs import table
from plumbline.plans.profiles import prof

_JOIN = "customer a FULL JOIN changed_customer b ON a.c_custkey = b.c_custkey"
_COLUMNS = ["c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
_BOTH = "a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL"
_CHANGED = " + ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN 1 ELSE 0 END" for c in _COLUMNS)
_COUNTS = f"""SELECT CAST(coalesce(sum(CASE WHEN {_BOTH} THEN {_CHANGED} END), 0) AS BIGINT) AS modified_cells, CAST(count_if(a.c_custkey IS NULL) AS BIGINT) AS added_rows, CAST(count_if(b.c_custkey IS NULL) AS BIGINT) AS removed_rows"""


def versions(spark, sf):
    return table(spark, sf, "customer"), table(spark, sf, "changed_customer")


@query("shape_change", "C01", """SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM lineitem) AS rows_after, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM orders) AS row_delta, 6 AS columns_before, 11 AS columns_after, 5 AS column_delta""")
def _(spark, sf):
    return M.shape_change(table(spark, sf, "orders"), table(spark, sf, "lineitem"))


@query("modified_cells", "C02", f"{_COUNTS} FROM {_JOIN}")
def _(spark, sf):
    return M.modified_cells(*versions(spark, sf), ["c_custkey"])


@query("modified_cells_window", "C03", f"{_COUNTS} FROM (SELECT * FROM customer WHERE c_custkey >= 100 AND c_custkey < 900) a FULL JOIN (SELECT * FROM changed_customer WHERE c_custkey >= 100 AND c_custkey < 900) b ON a.c_custkey = b.c_custkey")
def _(spark, sf):
    return M.modified_cells(*versions(spark, sf), ["c_custkey"], low=100, high=900)


@query("cell_diff", "C04", " UNION ALL ".join(
    f"""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, '{c}' AS "column", {f"'' || a.{c}" if c != 'c_acctbal' else "NULL"} AS old, {f"'' || b.{c}" if c != 'c_acctbal' else "NULL"} AS "new",
    CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS status FROM {_JOIN} WHERE NOT ({_BOTH}) OR a.{c} IS DISTINCT FROM b.{c}""" for c in _COLUMNS))
def _(spark, sf):
    # The engines print doubles differently, so their texts are left out.
    number = F.col("column") == "c_acctbal"
    return M.diff(*versions(spark, sf), ["c_custkey"]).withColumns({c: F.when(~number, F.col(c)) for c in ("old", "new")})


@query("schema_matrix", "C05",
       """WITH s AS (SELECT table_name AS t, column_name AS c, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS ty FROM duckdb_columns() WHERE table_name IN ('customer', 'supplier'))
       SELECT c AS "column", coalesce(max(CASE WHEN t = 'customer' THEN ty END), 'MISSING') AS customer, coalesce(max(CASE WHEN t = 'supplier' THEN ty END), 'MISSING') AS supplier FROM s GROUP BY c""")
def _(spark, sf):
    return M.schema_matrix({t: table(spark, sf, t) for t in ("customer", "supplier")})


@query("table_stats", "C06", """SELECT 'gappy_customer' AS "table", count(*) AS rows, 5 AS columns, 2 * count(*) - count(segment) - count(balance) AS missing_cells, round((2 * count(*) - count(segment) - count(balance)) * 100.0 / (5 * count(*)), 2) AS missing_percentage FROM gappy_customer
  UNION ALL SELECT 'messy', count(*), 5, count(*) - count(label), round((count(*) - count(label)) * 100.0 / (5 * count(*)), 2) FROM messy""")
def _(spark, sf):
    return M.table_stats({t: table(spark, sf, t) for t in ("gappy_customer", "messy")})


@query("null_matrix", "C07", """SELECT 'customer' AS "table", c AS "column", CAST(0.0 AS DOUBLE) AS null_percentage FROM (SELECT unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']) AS c)
  UNION ALL SELECT 'changed', c, CASE WHEN c = 'c_mktsegment' THEN (SELECT round((count(*) - count(c_mktsegment)) * 100.0 / count(*), 2) FROM changed_customer) ELSE 0.0 END FROM (SELECT unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']) AS c)""")
def _(spark, sf):
    a, b = versions(spark, sf)
    return M.null_matrix({"customer": a, "changed": b})


def shifted(spark, sf):
    """Orders with the kinds of change drift detection looks for."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus", "o_totalprice * 9 AS o_totalprice", "o_orderkey % 7 AS o_custkey", "o_orderdate", "1 AS o_extra"
    )


@query("baseline", "C08 A36", """SELECT 'o_totalprice' AS "column", 'double' AS dtype, count(*) AS row_count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.5), 4) AS median, count(DISTINCT o_totalprice) AS unique_count FROM orders
  UNION ALL SELECT 'o_custkey', 'bigint', count(*), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4), quantile_cont(o_custkey, 0.5), count(DISTINCT o_custkey) FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_totalprice", "o_custkey")
    b = M.baseline(df, profile(df, samples=False))
    return b.select("column", "dtype", "row_count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median")], "unique_count")


@query("drift", "C09 C10 C11 C12 C13", """SELECT 'o_extra' AS "column", 'new_column' AS type, CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS DOUBLE) AS current UNION ALL SELECT 'o_orderpriority', 'missing_column', NULL, NULL
  UNION ALL SELECT 'o_orderstatus', 'null_rate', 0.0, round(count_if(o_orderkey % 3 = 0) * 100.0 / count(*), 6) FROM orders HAVING count_if(o_orderkey % 3 = 0) * 100.0 / count(*) > 5
  UNION ALL SELECT 'o_custkey', 'cardinality', round(count(DISTINCT o_custkey) * 100.0 / count(*), 6), round(count(DISTINCT o_orderkey % 7) * 100.0 / count(*), 6) FROM orders HAVING abs(count(DISTINCT o_custkey) - count(DISTINCT o_orderkey % 7)) * 100.0 / count(*) > 10
  UNION ALL SELECT 'o_totalprice', 'mean_shift', round(avg(o_totalprice), 6), round(avg(o_totalprice * 9), 6) FROM orders HAVING abs(avg(o_totalprice * 9) - avg(o_totalprice)) > 2 * stddev_samp(o_totalprice)
  UNION ALL SELECT 'o_custkey', 'mean_shift', round(avg(o_custkey), 6), round(avg(o_orderkey % 7), 6) FROM orders HAVING abs(avg(o_orderkey % 7) - avg(o_custkey)) > 2 * stddev_samp(o_custkey)
  UNION ALL SELECT 'o_totalprice', 'cardinality', round(count(DISTINCT o_totalprice) * 100.0 / count(*), 6), round(count(DISTINCT o_totalprice * 9) * 100.0 / count(*), 6) FROM orders HAVING abs(count(DISTINCT o_totalprice) - count(DISTINCT o_totalprice * 9)) * 100.0 / count(*) > 10""")
def _(spark, sf):
    before, after = table(spark, sf, "orders"), shifted(spark, sf)
    alerts = M.drift(M.baseline(after, profile(after, samples=False)), M.baseline(before, profile(before, samples=False)))
    return alerts.select("column", "type", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"))


@query("drift_none", "C13", "SELECT '' AS \"column\", '' AS type FROM orders WHERE o_orderkey IS NULL")
def _(spark, sf):
    p = prof(spark, sf, "orders")
    base = M.baseline(table(spark, sf, "orders"), p)
    return M.drift(base, base).select("column", "type")
