"""Column-profile queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import profile as P, quantiles as Q
from plumbline.plans import query
from plumbline.plans.inputs import table

AS_OF = dt.datetime(2024, 1, 15)
TEXTS = ["label", "body"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "segment", "balance"]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(columns: list[str], template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# RE2 spells code points above 0xff as \x{...}.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_TEXT = " || ".join(f"chr({ord(ch)})" for ch in text.SPACE_CHARS)
TRIM = "trim({c}, " + SPACE_TEXT + ")"


def matches(pattern: str) -> str:
    return "regexp_matches({c}, " + quoted(pattern) + ")"


NOT_TITLE = r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]|(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}"
IS_UPPER = "{c} = upper({c}) AND {c} <> lower({c})"
IS_LOWER = "{c} = lower({c}) AND {c} <> upper({c})"
IS_TITLE = matches(r"[\p{Lu}\p{Lt}]") + " AND NOT " + matches(NOT_TITLE)
LOOSE_EMAIL = r"^[\pL\pM\p{Nd}\p{Pc}\.-]+@[\pL\pM\p{Nd}\p{Pc}\.-]+\.[\pL\pM\p{Nd}\p{Pc}]+$"

VOLUME = """SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count, count({c}) AS non_null_count,
  round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage, count(DISTINCT {c}) AS unique_count,
  round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS unique_percentage, count(*) - count(DISTINCT {c}) AS duplicate_count"""


def volume(prof):
    return prof.select(
        "column", "total_rows", "null_count", "non_null_count", F.round("null_percentage", 6).alias("null_percentage"), "unique_count",
        F.round("unique_percentage", 6).alias("unique_percentage"), "duplicate_count",
    )


def prof(spark, sf, name, columns=None, **options):
    return P.profile(table(spark, sf, name), columns, as_of=AS_OF, samples=False, **options)


@query("profile_volume", "A01 A02 A03", union(CUSTOMER, VOLUME + " FROM gappy_customer"))
def _(spark, sf):
    return volume(prof(spark, sf, "gappy_customer"))


@query("profile_volume_lineitem", "A01 A02 A03", union(LINE_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"], VOLUME + " FROM lineitem"))
def _(spark, sf):
    return volume(prof(spark, sf, "lineitem"))


@query("profile_volume_long_text", "A01 A02 A03", union(["page_id", "url", "html"], VOLUME + " FROM pages"))
def _(spark, sf):
    return volume(prof(spark, sf, "pages"))


@query("profile_data_size", "A04", union(["c_name", "segment"], """SELECT '{c}' AS "column", CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS data_bytes FROM gappy_customer""")
       + """ UNION ALL SELECT 'balance', 8 * count(balance) FROM gappy_customer""")
def _(spark, sf):
    return prof(spark, sf, "gappy_customer", ["c_name", "segment", "balance"]).select("column", "data_bytes")


_CHARS = {"multiple_spaces": ("multiple spaces", matches(rf"[{SPACES}]{{2,}}")), "multiple_underscores": ("multiple underscores", "contains({c}, '__')")}
_CHARS.update({ch: (name, "contains({c}, " + quoted(ch) + ")") for ch, name in P.SPECIAL_CHARACTERS.items()})
_CHAR_SQL = " UNION ALL ".join(
    "SELECT '{c}' AS \"column\", " + quoted(k) + " AS key, " + quoted(n) + " AS name, count_if(" + t + ") AS \"count\" FROM messy"
    for k, (n, t) in _CHARS.items()
)


@query("profile_special_characters", "A05", f'SELECT "column", key, name, CAST("count" AS BIGINT) AS "count" FROM ({union(TEXTS, _CHAR_SQL)}) WHERE "count" > 0')
def _(spark, sf):
    return prof(spark, sf, "messy", TEXTS).select("column", F.inline("special_chars"))


_ANY_SPECIAL = " OR ".join(["contains({c}, " + quoted(ch) + ")" for ch in P.SPECIAL_CHARACTERS] + ["contains({c}, '  ')", "contains({c}, '__')"])


@query("profile_special_rows", "A06", union(TEXTS, f"""SELECT '{{c}}' AS "column", CAST(count_if({_ANY_SPECIAL}) AS BIGINT) AS total_special_char_rows FROM messy"""))
def _(spark, sf):
    return prof(spark, sf, "messy", TEXTS).select("column", "total_special_char_rows")


@query("character_census", "A07", union(TEXTS, """SELECT '{c}' AS "column", character, count(*) AS "count" FROM
  (SELECT unnest(string_split({c}, '')) AS character FROM messy) WHERE NOT regexp_matches(character, '[a-zA-Z0-9\\t-\\r\\x1c-\\x20]') AND character <> '' GROUP BY character"""))
def _(spark, sf):
    return P.char_census(table(spark, sf, "messy"), TEXTS).drop("unicode_name")


@query("character_census_named", "A07")
def _(spark, sf):
    return P.char_census(table(spark, sf, "pages"), ["html"])


_SHAPES = {
    "Email": matches(text.EMAIL),
    "Phone": matches(rf"^[\p{{Nd}}{SPACES}\-\+\(\)]{{7,20}}$".replace(r"\p{Nd}", "0-9")),
    "Date": matches(r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})$"),
    "URL": matches(r"^https?://[^\s<>\"{}|\\^`\[\]]+$"),
}
_ALL_DIGITS = "(SELECT count({c}) > 0 AND count_if(" + matches(r"^\p{Nd}+$") + ") = count({c}) FROM messy)"
_SHAPE_SQL = " UNION ALL ".join(
    "SELECT '{c}' AS \"column\", '" + k + "' AS shape, CAST(count_if(" + t + ") AS BIGINT) AS matching, min(CASE WHEN " + t + " THEN {c} END) AS example FROM messy"
    + (" WHERE NOT " + _ALL_DIGITS if k == "Phone" else "")
    for k, t in _SHAPES.items()
)


@query("profile_patterns", "A08 A09 A12", f"SELECT * FROM ({union(['label', 'body', 'lang'], _SHAPE_SQL)}) WHERE matching > 0")
def _(spark, sf):
    p = prof(spark, sf, "messy", ["label", "body", "lang"])
    return p.select("column", F.explode("pattern_counts").alias("shape", "matching"), "pattern_examples").select(
        "column", "shape", "matching", F.element_at("pattern_examples", F.col("shape")).alias("example")
    )


@query("profile_ranges", "A10", union(["c_custkey", "c_nationkey", "balance"], """SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS range_min, CAST(max({c}) AS DOUBLE) AS range_max,
  CAST(count_if({c} < 0) AS BIGINT) AS negative_count, CAST(count_if({c} = 0) AS BIGINT) AS zero_count FROM gappy_customer"""))
def _(spark, sf):
    return prof(spark, sf, "gappy_customer", ["c_custkey", "c_nationkey", "balance"]).select("column", "range_min", "range_max", "negative_count", "zero_count")


@query("profile_ranges_exact", "A10", union(["wide_key", "amount"], """SELECT '{c}' AS "column", CAST(min({c}) AS VARCHAR) AS exact_min, CAST(max({c}) AS VARCHAR) AS exact_max FROM wide_keys"""))
def _(spark, sf):
    return prof(spark, sf, "wide_keys", ["wide_key", "amount"]).select("column", "exact_min", "exact_max")


@query("profile_moments", "A11 A19", """SELECT 'ts' AS "column", CAST(min(ts) AS TIMESTAMP) AS moment_min, CAST(max(ts) AS TIMESTAMP) AS moment_max,
  CAST(count_if(ts > TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) AS future_count FROM events""")
def _(spark, sf):
    return prof(spark, sf, "events", ["ts"]).select(
        "column", F.col("moment_min").cast("timestamp_ntz").alias("moment_min"), F.col("moment_max").cast("timestamp_ntz").alias("moment_max"), "future_count"
    )


_MULTI, _EDGE = _CHARS["multiple_spaces"][1], "{c} <> " + TRIM
_BLANKS = f"""SELECT '{{c}}' AS "column",
  CAST(count_if({_MULTI}) AS BIGINT) AS multi_space_count, CAST(count_if({_EDGE}) AS BIGINT) AS edge_space_count,
  round(100.0 - least(10.0, count_if({_MULTI}) * 100.0 / count({{c}})) - least(15.0, count_if({_EDGE}) * 100.0 / count({{c}})), 6) AS accuracy_score,
  CAST(count(*) - count({{c}}) AS BIGINT) AS null_count, CAST(count_if({{c}} = '') AS BIGINT) AS empty_string_count,
  CAST(count_if({{c}} <> '' AND {TRIM} = '') AS BIGINT) AS whitespace_only_count,
  CAST(count(*) - count({{c}}) + count_if({{c}} = '') + count_if({{c}} <> '' AND {TRIM} = '') AS BIGINT) AS total_missing,
  round(100.0 - least(10.0, count_if({{c}} = '') * 100.0 / count(*)), 6) AS validity_score FROM messy"""


@query("profile_accuracy_validity_blanks", "A13 A14 A15", union(TEXTS, _BLANKS))
def _(spark, sf):
    return prof(spark, sf, "messy", TEXTS).select(
        "column", "multi_space_count", "edge_space_count", F.round("accuracy_score", 6).alias("accuracy_score"), "null_count", "empty_string_count",
        "whitespace_only_count", "total_missing", F.round("validity_score", 6).alias("validity_score"),
    )


_CASES = f"""SELECT '{{c}}' AS "column", CAST(count_if({IS_UPPER}) AS BIGINT) AS upper_count, CAST(count_if({IS_LOWER}) AS BIGINT) AS lower_count,
  CAST(count_if({IS_TITLE}) AS BIGINT) AS title_count, CAST(count({{c}}) - count_if({IS_UPPER}) - count_if({IS_LOWER}) - count_if({IS_TITLE}) AS BIGINT) AS mixed_count,
  CASE WHEN count_if({IS_UPPER}) > 0.8 * count({{c}}) THEN 'UPPER' WHEN count_if({IS_LOWER}) > 0.8 * count({{c}}) THEN 'lower'
       WHEN count_if({IS_TITLE}) > 0.8 * count({{c}}) THEN 'Title' ELSE 'Mixed' END AS case_type"""


@query("profile_casing", "A16", union(["label", "body", "lang"], _CASES + " FROM messy") + " UNION ALL " + union(["c_name", "segment"], _CASES + " FROM gappy_customer"))
def _(spark, sf):
    keep = ["column", "upper_count", "lower_count", "title_count", "mixed_count", "case_type"]
    return prof(spark, sf, "messy", ["label", "body", "lang"]).select(keep).unionByName(prof(spark, sf, "gappy_customer", ["c_name", "segment"]).select(keep))


@query("profile_lengths", "A17 A18", union(TEXTS, """SELECT '{c}' AS "column", min(length({c})) AS min_length, max(length({c})) AS max_length,
  round(avg(length({c})), 2) AS avg_length, CAST(count_if(length({c}) > 255 OR length({c}) = 0) AS BIGINT) AS out_of_bounds_count FROM messy"""))
def _(spark, sf):
    return prof(spark, sf, "messy", TEXTS).select("column", "min_length", "max_length", F.round("avg_length", 2).alias("avg_length"), "out_of_bounds_count")


@query("profile_business_violations", "A19", f"""
  SELECT 'email' AS "column", 'Invalid email formats detected (' || (count(email) - count_if({matches(LOOSE_EMAIL).replace('{c}', 'email')})) || ' rows)' AS violation FROM mostly_emails
  UNION ALL SELECT 'balance', 'Negative values detected (' || count_if(balance < 0) || ' rows) - Verify if allowed' FROM gappy_customer HAVING count_if(balance < 0) > 0
  UNION ALL SELECT 'ts', 'Future dates detected (' || count_if(ts > TIMESTAMP '2024-01-15 00:00:00') || ' rows) - Verify validity' FROM events""")
def _(spark, sf):
    parts = [prof(spark, sf, t, [c]) for t, c in (("mostly_emails", "email"), ("gappy_customer", "balance"), ("events", "ts"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("column", F.explode("business_rule_violations").alias("violation"))


_FENCES = """(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})"""
_OUTLIERS = f"""SELECT '{{c}}' AS "column", CAST(count_if({{c}} < lo OR {{c}} > hi) AS BIGINT) AS outlier_count, round(any_value(lo), 6) AS outlier_low, round(any_value(hi), 6) AS outlier_high
  FROM {{t}}, {_FENCES}"""


@query("profile_outliers", "A20", union(["c_custkey", "c_nationkey", "balance"], _OUTLIERS.replace("{t}", "gappy_customer")))
def _(spark, sf):
    return prof(spark, sf, "gappy_customer", ["c_custkey", "c_nationkey", "balance"]).select(
        "column", "outlier_count", F.round("outlier_low", 6).alias("outlier_low"), F.round("outlier_high", 6).alias("outlier_high")
    )


@query("profile_outliers_lineitem", "A20", union(["l_quantity", "l_extendedprice", "l_discount"], _OUTLIERS.replace("{t}", "lineitem")))
def _(spark, sf):
    return prof(spark, sf, "lineitem", ["l_quantity", "l_extendedprice", "l_discount"]).select(
        "column", "outlier_count", F.round("outlier_low", 6).alias("outlier_low"), F.round("outlier_high", 6).alias("outlier_high")
    )


@query("profile_outlier_samples", "A20", f"""SELECT x AS outlier FROM (SELECT DISTINCT balance AS x FROM gappy_customer,
  {_FENCES.replace('{c}', 'balance').replace('{t}', 'gappy_customer')} WHERE balance < lo OR balance > hi) ORDER BY x LIMIT 3""")
def _(spark, sf):
    return prof(spark, sf, "gappy_customer", ["balance"]).select(F.explode("outlier_samples").alias("outlier"))


@query("profile_samples", "A21", union(["segment", "balance", "c_name"], """SELECT * FROM (SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY c_custkey) AS samples
  FROM (SELECT c_custkey, CAST({c} AS VARCHAR) AS v FROM gappy_customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 3))"""))
def _(spark, sf):
    s = P.sample_values(table(spark, sf, "gappy_customer"), ["segment", "balance", "c_name"], order_by="c_custkey")
    return s.select("column", F.array_join("sample_values", "|").alias("samples"))


_ASSESSED = """(SELECT '{c}' AS "column", {text} AS is_text, count(*) AS n, count({c}) AS nn, (count(*) - count({c})) * 100.0 / count(*) AS np, count(DISTINCT {c}) AS u,
  count(DISTINCT {c}) * 100.0 / count(*) AS up, {special} AS sp, {kinds} AS kinds, {outliers} AS ol, {mixed} AS mixed, {blank} AS empties, {white} AS white, {edge} AS edge, {odd} AS odd FROM {t})"""


def assessed(t: str, texts: list[str], numbers: list[str]) -> str:
    parts = []
    for c in texts + numbers:
        is_text = c in texts
        fields = {
            "text": str(is_text).lower(),
            "special": f"count_if({_ANY_SPECIAL})" if is_text else "0",
            "kinds": " + ".join(f"CASE WHEN count_if({test}) > 0 THEN 1 ELSE 0 END" for _, test in _CHARS.values()) if is_text else "0",
            "outliers": f"(SELECT count_if(z.{{c}} < lo OR z.{{c}} > hi) FROM {t} z, {_FENCES})" if not is_text else "0",
            "mixed": f"(NOT (count_if({IS_UPPER}) > 0.8 * count({{c}}) OR count_if({IS_LOWER}) > 0.8 * count({{c}}) OR count_if({IS_TITLE}) > 0.8 * count({{c}})))" if is_text else "false",
            "blank": "count_if({c} = '')" if is_text else "0",
            "white": "count_if({c} <> '' AND " + TRIM + " = '')" if is_text else "0",
            "edge": f"count_if({_EDGE})" if is_text else "0",
            "odd": "count_if({c} <> lower({c}) AND {c} <> upper({c}) AND " + matches(NOT_TITLE) + ")" if is_text else "0",
        }
        sql = _ASSESSED
        for k, v in fields.items():
            sql = sql.replace("{" + k + "}", v)
        parts.append("SELECT * FROM " + sql.replace("{t}", t).replace("{c}", c))
    return " UNION ALL ".join(parts)


_POINTS = """CASE WHEN np > 50 THEN 40 WHEN np > 20 THEN 20 ELSE 0 END + CASE WHEN 100 - up > 50 AND u > 5 THEN 30 ELSE 0 END
  + CASE WHEN sp * 100.0 / n > 10 THEN 15 ELSE 0 END + CASE WHEN ol > 0 THEN 10 ELSE 0 END"""
ASSESSED = assessed("messy", ["label", "body", "lang"], ["doc_id", "n_chars"]) + " UNION ALL " + assessed("gappy_customer", ["c_name", "segment"], ["balance", "c_nationkey"])


def both_profiles(spark, sf):
    return prof(spark, sf, "messy", ["label", "body", "lang", "doc_id", "n_chars"]).unionByName(
        prof(spark, sf, "gappy_customer", ["c_name", "segment", "balance", "c_nationkey"])
    )


@query("profile_risk", "A22 A24", f"""SELECT "column", least(100, p) AS risk_score, CASE WHEN p >= 60 THEN 'High' WHEN p >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level,
  is_text AND u / n < 0.9 AS fuzzy_candidate, concat_ws('; ', CASE WHEN np > 50 THEN 'Critical: Majority of data is missing' WHEN np > 20 THEN 'High missing value rate' END,
  CASE WHEN 100 - up > 50 AND u > 5 THEN 'High duplication rate in potential identifier' END, CASE WHEN sp * 100.0 / n > 10 THEN 'Frequent special characters - potential ingestion risk' END,
  CASE WHEN ol > 0 THEN 'Statistical outliers detected' END) AS issues FROM (SELECT *, {_POINTS} AS p FROM ({ASSESSED}))""")
def _(spark, sf):
    return both_profiles(spark, sf).select("column", "risk_score", "risk_level", "fuzzy_candidate", F.array_join("key_issues", "; ").alias("issues"))


@query("profile_suggestions", "A23", f"""SELECT "column", concat_ws('; ', CASE WHEN np > 0 THEN '[' || CASE WHEN np > 50 THEN 'Critical' WHEN np > 10 THEN 'Warning' ELSE 'OK' END || '] ' || printf('%.1f', np) || '% missing values' END,
  CASE WHEN empties > 0 THEN empties || ' empty strings (not null)' END, CASE WHEN white > 0 THEN white || ' whitespace-only values' END,
  CASE WHEN kinds > 0 THEN kinds || ' special character types' END, CASE WHEN ol > 0 THEN ol || ' statistical outliers' END,
  CASE WHEN is_text AND u / n < 0.9 THEN 'Candidate for fuzzy matching' END, CASE WHEN up = 100 AND np = 0 THEN 'Primary key candidate' END,
  CASE WHEN up < 5 THEN 'Low cardinality - consider categorical' END, CASE WHEN edge > 0 THEN 'Leading/trailing whitespace' END,
  CASE WHEN odd > 0 THEN 'Inconsistent text casing' END) AS suggestions FROM ({ASSESSED})""")
def _(spark, sf):
    return both_profiles(spark, sf).select("column", F.array_join("suggestions", "; ").alias("suggestions"))


@query("profile_recommendations", "A25", f"""SELECT "column", action, impact FROM (
  SELECT "column", 'Drop Rows' AS action, (n - nn) || ' rows' AS impact, np > 0 AND np < 5 AS ok FROM ({ASSESSED})
  UNION ALL SELECT "column", 'Impute Values', (n - nn) || ' rows', np > 0 AND np < 5 FROM ({ASSESSED})
  UNION ALL SELECT "column", 'Impute/Flag', (n - nn) || ' rows', np >= 5 FROM ({ASSESSED})
  UNION ALL SELECT "column", 'Clean Strings', sp || ' rows', sp > 0 FROM ({ASSESSED})
  UNION ALL SELECT "column", 'Standardize Case', 'All rows', mixed FROM ({ASSESSED})) WHERE ok""")
def _(spark, sf):
    return both_profiles(spark, sf).select("column", F.inline("cleansing_recommendations")).drop("description")


@query("column_summary", "A26 A28", union(["c_custkey", "c_name", "c_nationkey", "segment", "balance"], """SELECT '{c}' AS "column",
  CASE '{c}' WHEN 'c_custkey' THEN 'bigint' WHEN 'c_nationkey' THEN 'int' WHEN 'balance' THEN 'double' ELSE 'string' END AS type, count({c}) AS non_null,
  round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage, count(DISTINCT {c}) AS "unique" FROM gappy_customer"""))
def _(spark, sf):
    return P.column_summary(table(spark, sf, "gappy_customer")).withColumn("null_percentage", F.round("null_percentage", 6))


@query("type_families", "A26 A27 A29", """SELECT family, count(*) AS columns FROM (SELECT CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'Numeric' WHEN data_type = 'VARCHAR' THEN 'Text'
  WHEN data_type LIKE 'TIMESTAMP%' THEN 'DateTime' ELSE 'Other' END AS family FROM duckdb_columns() WHERE table_name IN ('events', 'lineitem', 'embeddings')) GROUP BY family""")
def _(spark, sf):
    parts = [P.column_info(table(spark, sf, t)) for t in ("events", "lineitem", "embeddings")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("family").agg(F.count(F.lit(1)).alias("columns"))


_DUPLICATE_VALUES = """SELECT 'label' AS "column", string_agg(CASE WHEN v IS NULL OR trim(v) = '' THEN 'Missing Values' ELSE trim(v) END || '(' || n || ')', ', ' ORDER BY n DESC, v NULLS FIRST) AS duplicate_values
  FROM (SELECT label AS v, count(*) AS n FROM messy GROUP BY label HAVING count(*) > 1 ORDER BY n DESC, v NULLS FIRST LIMIT 5)"""


@query("duplicate_value_list", "A30", _DUPLICATE_VALUES)
def _(spark, sf):
    return P.duplicate_values(table(spark, sf, "messy"), "label")


@query("top_duplicates", "A31", """SELECT substr(v, 1, 50) AS "value", n AS "count", round(n * 100.0 / (SELECT count(*) FROM lineitem), 2) AS percentage, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS row_ids
  FROM (SELECT l_shipdate AS d, CAST(l_shipdate AS VARCHAR) AS v, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS rid, count(*) OVER (PARTITION BY l_shipdate) AS n,
  row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber) AS r FROM lineitem)
  WHERE r <= 5 AND d IN (SELECT l_shipdate FROM lineitem GROUP BY l_shipdate ORDER BY count(*) DESC, l_shipdate LIMIT 10) GROUP BY v, n""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("rid", F.expr("l_orderkey * 100000000L + l_partkey * 10000L + l_suppkey * 10L + l_linenumber"))
    return P.top_duplicates(df, "l_shipdate", "rid").withColumn("row_ids", F.array_join(F.transform("row_ids", lambda x: x.cast("string")), ","))


def corr_sql(pairs_from: str, columns: list[str], template: str) -> str:
    return " UNION ALL ".join(
        template.replace("{a}", a).replace("{b}", b).replace("{t}", pairs_from) for a in columns for b in columns
    )


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR_SQL = corr_sql("lineitem", _CORR, "SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM {t}")


@query("correlation_pearson", "A32", _CORR_SQL + " UNION ALL " + corr_sql("gappy_customer", ["c_nationkey", "balance"], "SELECT '{a}', '{b}', round(corr({a}, {b}), 6) FROM {t}"))
def _(spark, sf):
    parts = [Q.correlation(table(spark, sf, "lineitem"), _CORR), Q.correlation(table(spark, sf, "gappy_customer"), ["c_nationkey", "balance"])]
    return parts[0].unionByName(parts[1]).select("column_a", "column_b", F.round("correlation", 6).alias("correlation"))


_RANKS = """(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y
  FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
_SPEARMAN = "SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(x, y), 6) AS correlation FROM " + _RANKS
GAPS = ["p_size", "p_partkey"]


@query("correlation_spearman", "A33", corr_sql("lineitem", _CORR, _SPEARMAN) + " UNION ALL " + corr_sql("tied_parts", GAPS, _SPEARMAN))
def _(spark, sf):
    parts = [Q.correlation(table(spark, sf, "lineitem"), _CORR, "spearman"), Q.correlation(table(spark, sf, "tied_parts"), GAPS, "spearman")]
    return parts[0].unionByName(parts[1]).select("column_a", "column_b", F.round("correlation", 6).alias("correlation"))


@query("correlation_high", "A34", """SELECT * FROM (SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(l_quantity, l_extendedprice), 3) AS correlation FROM lineitem) WHERE abs(correlation) >= 0.5""")
def _(spark, sf):
    return Q.high_correlation(Q.correlation(table(spark, sf, "lineitem"), _CORR), 0.5)


_NARROW = """SELECT '{c}' AS "column", CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'
  WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS to_type FROM lineitem"""


@query("narrow_types", "A35", union(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], _NARROW) + " UNION ALL " + union(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "SELECT '{c}', 'float'")
       + " UNION ALL " + union(["l_returnflag", "l_linestatus"], "SELECT '{c}', CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.5 THEN 'category' ELSE 'string' END FROM lineitem")
       + " UNION ALL SELECT 'l_shipdate', 'timestamp_ntz'")
def _(spark, sf):
    return P.narrow_types(table(spark, sf, "lineitem"))[1].select("column", "to_type")


@query("narrowed_totals", "A35", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS rows FROM lineitem")
def _(spark, sf):
    narrowed = P.narrow_types(table(spark, sf, "lineitem"))[0]
    return narrowed.agg(F.sum("l_orderkey").cast("bigint").alias("keys"), F.sum("l_linenumber").cast("bigint").alias("lines"), F.count(F.lit(1)).alias("rows"))


@query("numeric_summary", "A36", union(LINE_NUMBERS, """SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
  round(quantile_cont({c}, 0.5), 4) AS median, count({c}) AS non_null_count FROM lineitem"""))
def _(spark, sf):
    s = Q.numeric_summary(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return s.select("column", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", "max", F.round("median", 4).alias("median"), "non_null_count")


@query("profile_full_documents", "A01-A26")
def _(spark, sf):
    return P.profile(table(spark, sf, "documents"), as_of=AS_OF, order_by="doc_id")


@query("profile_fast_lineitem", "A01-A26")
def _(spark, sf):
    return P.profile(table(spark, sf, "lineitem"), fast=True, as_of=AS_OF, samples=False)


@query("profile_nested", "A26 P12", """SELECT 'embedding' AS "column", count(*) AS total_rows, CAST(0 AS BIGINT) AS null_count, count(DISTINCT embedding) AS unique_count, 'Nested' AS label FROM embeddings""")
def _(spark, sf):
    return prof(spark, sf, "embeddings", ["embedding"]).select("column", "total_rows", "null_count", "unique_count", "label")
