"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import clean as C
from plumbline.plans import query
from plumbline.plans.inputs import table
from plumbline.plans.profiles import TRIM, quoted

MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def mode_of(c, t):
    return MODE.replace("{c}", c).replace("{t}", t)


@query("rename_columns", "T01", "SELECT s_suppkey AS \"sSuppkey\", s_name AS \"sName\", s_nationkey AS \"sNationkey\", s_acctbal AS \"sAcctbal\" FROM supplier")
def _(spark, sf):
    return C.rename(table(spark, sf, "supplier"), "camelCase")


@query("rename_columns_snake", "T01", "SELECT n_nationkey AS nation_key, n_name AS \"nation_full_name\", n_regionkey AS region_key FROM nation")
def _(spark, sf):
    return C.rename(table(spark, sf, "nation").toDF("NationKey", "Nation Full-Name", "region.Key"), "snake_case")


@query("impute_auto", "T02", f"""SELECT c_custkey, c_name, c_nationkey, coalesce(segment, {mode_of('segment', 'gappy_customer')}) AS segment,
  round(coalesce(balance, (SELECT CASE WHEN abs(skewness(balance)) > 2 THEN quantile_cont(balance, 0.5) ELSE avg(balance) END FROM gappy_customer)), 6) AS balance FROM gappy_customer""")
def _(spark, sf):
    return C.impute(table(spark, sf, "gappy_customer"), "auto").withColumn("balance", F.round("balance", 6))


@query("impute_mean", "T03", """SELECT c_custkey, round(coalesce(balance, (SELECT avg(balance) FROM gappy_customer)), 6) AS balance FROM gappy_customer""")
def _(spark, sf):
    return C.impute(table(spark, sf, "gappy_customer"), "mean", ["balance"]).select("c_custkey", F.round("balance", 6).alias("balance"))


@query("impute_median", "T03", """SELECT p_partkey, coalesce(CAST(p_size AS DOUBLE), (SELECT quantile_cont(p_size, 0.5) FROM tied_parts)) AS p_size FROM tied_parts""")
def _(spark, sf):
    return C.impute(table(spark, sf, "tied_parts"), "median", ["p_size"]).select("p_partkey", "p_size")


@query("impute_mode", "T03", f"SELECT p_partkey, coalesce(p_size, {mode_of('p_size', 'tied_parts')}) AS p_size FROM tied_parts")
def _(spark, sf):
    return C.impute(table(spark, sf, "tied_parts"), "mode", ["p_size"]).select("p_partkey", "p_size")


@query("impute_constant", "T03", "SELECT c_custkey, coalesce(segment, 'MISSING') AS segment, coalesce(balance, 0.0) AS balance FROM gappy_customer")
def _(spark, sf):
    return C.impute(table(spark, sf, "gappy_customer"), "constant").select("c_custkey", "segment", "balance")


@query("drop_missing", "T03", "SELECT * FROM gappy_customer WHERE segment IS NOT NULL AND balance IS NOT NULL")
def _(spark, sf):
    return C.impute(table(spark, sf, "gappy_customer"), "drop")


@query("clean_special_characters", "T04", r"""SELECT doc_id, trim(regexp_replace(replace(strip_accents(replace(replace(body, 'ß', 'ss'), chr(8203), '')), chr(160), ' '), '\s+', ' ', 'g')) AS body FROM messy""")
def _(spark, sf):
    df = table(spark, sf, "messy").select("doc_id", F.replace("body", F.lit("ß"), F.lit("ss")).alias("body"))
    return C.clean_special(df, ["body"])


@query("text_case", "T05", "SELECT doc_id, lower(body) AS lowered, upper(label) AS raised, upper(label[1]) || lower(label[2:]) AS capital FROM messy")
def _(spark, sf):
    df = table(spark, sf, "messy").select("doc_id", F.col("body").alias("lowered"), F.col("label").alias("raised"), F.col("label").alias("capital"))
    return C.text_case(C.text_case(C.text_case(df, ["lowered"], "lower"), ["raised"], "upper"), ["capital"], "capitalize")


_WORDS = r"string_split(trim(regexp_replace(title, '\s+', ' ', 'g')), ' ')"
_CAPS = "({p} = upper({p}) AND {p} <> lower({p}) AND length({p}) BETWEEN 2 AND 5) OR upper({p}) IN (" + ", ".join(quoted(a) for a in text.ACRONYMS) + ")"
_SMALL = "lower({p}) IN (" + ", ".join(quoted(w) for w in text.SMALL_WORDS) + ")"
_CAPITAL = "upper({p}[1]) || lower({p}[2:])"


def titled(inner: str) -> str:
    part = f"CASE WHEN {_CAPS} THEN upper({{p}}) WHEN i = 1 OR i = n THEN {_CAPITAL} ELSE {inner} END".replace("{p}", "p")
    return f"""SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS title FROM (SELECT p_partkey, i, string_agg({part}, '-' ORDER BY j) AS w FROM (
      SELECT p_partkey, i, n, unnest(string_split(word, '-')) AS p, unnest(range(1, len(string_split(word, '-')) + 1)) AS j FROM (
      SELECT p_partkey, unnest({_WORDS}) AS word, unnest(range(1, len({_WORDS}) + 1)) AS i, len({_WORDS}) AS n FROM spelled)) GROUP BY p_partkey, i) GROUP BY p_partkey"""


for _style, _inner in {
    "apa": f"CASE WHEN {_SMALL} THEN lower({{p}}) ELSE {_CAPITAL} END", "chicago": f"CASE WHEN {_SMALL} AND length({{p}}) < 4 THEN lower({{p}}) ELSE {_CAPITAL} END",
    "nyt": _CAPITAL, "sentence": "lower({p})",
}.items():

    @query(f"title_case_{_style}", "T06", titled(_inner))
    def _(spark, sf, style=_style):
        case = "sentence" if style == "sentence" else "title"
        return C.text_case(table(spark, sf, "spelled"), ["title"], case, style).select("p_partkey", "title")


@query("trim_whitespace", "T07", f"SELECT doc_id, {TRIM.replace('{c}', 'label')} AS label, {TRIM.replace('{c}', 'body')} AS body FROM messy")
def _(spark, sf):
    return C.trim(table(spark, sf, "messy")).select("doc_id", "label", "body")


_NUM = r"CASE WHEN regexp_matches(trim(s), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim(s) AS DOUBLE) WHEN trim(s) = 'inf' THEN 'inf'::DOUBLE END"


@query("convert_types", "T08", f"""SELECT p_partkey, coalesce('' || x, 'none') AS as_float, CASE WHEN x < 1e300 AND x = floor(x) THEN CAST(CASE WHEN x < 1e300 THEN x END AS BIGINT) END AS as_int, s <> '' AS as_bool FROM (SELECT p_partkey, s, {_NUM} AS x FROM numeric_text)""")
def _(spark, sf):
    df = table(spark, sf, "numeric_text").select("p_partkey", F.col("s").alias("as_float"), F.col("s").alias("as_int"), F.col("s").alias("as_bool"))
    out = C.convert(df, {"as_float": "float", "as_int": "int", "as_bool": "bool"})
    shown = F.when(F.col("as_float") == float("inf"), "inf").otherwise(F.coalesce(F.col("as_float").cast("string"), F.lit("none")))
    return out.withColumn("as_float", shown)


@query("convert_dates", "T08", "SELECT o_orderkey, CASE WHEN s LIKE '____-__-__' THEN CAST(s AS TIMESTAMP) END AS s FROM dated_text")
def _(spark, sf):
    return C.convert(table(spark, sf, "dated_text"), {"s": "datetime"}).select("o_orderkey", F.col("s").cast("timestamp_ntz").alias("s"))


_IN_FENCE = """{c} IS NULL OR {c} BETWEEN (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {t}) AND (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {t})"""


@query("remove_outliers_iqr", "T09", f"""WITH a AS (SELECT * FROM gappy_customer WHERE {_IN_FENCE.replace('{c}', 'balance').replace('{t}', 'gappy_customer')})
  SELECT * FROM a WHERE {_IN_FENCE.replace('{c}', 'c_nationkey').replace('{t}', 'a')}""")
def _(spark, sf):
    return C.remove_outliers(table(spark, sf, "gappy_customer"), ["balance", "c_nationkey"])


@query("remove_outliers_zscore", "T10", """SELECT * FROM gappy_customer WHERE abs((balance - (SELECT avg(balance) FROM gappy_customer)) / (SELECT stddev_samp(balance) FROM gappy_customer)) < 3""")
def _(spark, sf):
    return C.remove_outliers(table(spark, sf, "gappy_customer"), ["balance"], "zscore")


@query("regex_replace", "T11", r"SELECT c_custkey, regexp_replace(c_name, '(\w)#0*(\d+)', '\1 no. \2', 'g') AS c_name FROM customer")
def _(spark, sf):
    return C.regex(table(spark, sf, "customer"), "c_name", r"(?P<l>\w)#0*(\d+)", r"\g<l> no. \2").select("c_custkey", "c_name")


@query("regex_extract", "T11", r"SELECT doc_id, label, CASE WHEN regexp_matches(label, '(\d+)') THEN regexp_extract(label, '(\d+)', 1) END AS label_extracted FROM messy")
def _(spark, sf):
    return C.regex(table(spark, sf, "messy"), "label", r"(\d+)", action="extract").select("doc_id", "label", "label_extracted")


@query("regex_match_filter", "T11", r"SELECT 'match' AS action, count(*) AS rows FROM messy WHERE regexp_matches(label, '^(?:\w+\d)') UNION ALL SELECT 'filter', count(*) FROM messy WHERE regexp_matches(body, '\d{4}')")
def _(spark, sf):
    df = table(spark, sf, "messy")
    a = C.regex(df, "label", r"\w+\d", action="match").agg(F.lit("match").alias("action"), F.count(F.lit(1)).alias("rows"))
    return a.unionByName(C.regex(df, "body", r"\d{4}", action="filter").agg(F.lit("filter").alias("action"), F.count(F.lit(1)).alias("rows")))


@query("business_rule_range", "T12", "SELECT * FROM gappy_customer WHERE balance >= 0 AND balance <= 5000")
def _(spark, sf):
    return C.business_rule(table(spark, sf, "gappy_customer"), "balance", "range", min_val=0, max_val=5000)


@query("business_rule_texts", "T13 T14 T20", f"""SELECT 'length' AS rule, count(*) AS rows FROM messy WHERE length(label) BETWEEN 4 AND 12 UNION ALL SELECT 'email_format', count(*) FROM messy WHERE regexp_matches(label, {quoted(text.EMAIL)})
  UNION ALL SELECT 'phone_format', count(*) FROM messy WHERE length(regexp_replace(body, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 UNION ALL SELECT 'pattern', count(*) FROM messy WHERE regexp_matches(label, {quoted('^(?:' + text.PATTERNS['Alphanumeric'] + ')')})""")
def _(spark, sf):
    df = table(spark, sf, "messy")
    picks = [("label", "length", {"min_len": 4, "max_len": 12}), ("label", "email_format", {}), ("body", "phone_format", {}), ("label", "pattern", {"pattern": text.PATTERNS["Alphanumeric"]})]
    out = None
    for c, rule, options in picks:
        one = C.business_rule(df, c, rule, **options).agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("business_rule_dates", "T15", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'")
def _(spark, sf):
    return C.business_rule(table(spark, sf, "orders"), "o_orderdate", "date_range", min_date="1996-01-01", max_date="1997-06-30")


@query("business_rule_values", "T16 T17", "SELECT * FROM gappy_customer WHERE segment IN ('BUILDING', 'MACHINERY') AND balance IS NOT NULL")
def _(spark, sf):
    df = C.business_rule(table(spark, sf, "gappy_customer"), "segment", "allowed_values", allowed_values=["BUILDING", "MACHINERY"])
    return C.business_rule(df, "balance", "not_null")


@query("business_rule_not_blank", "T17", "SELECT doc_id, label FROM messy WHERE label <> ''")
def _(spark, sf):
    return C.business_rule(table(spark, sf, "messy"), "label", "not_null").select("doc_id", "label")


@query("business_rule_unique", "T17", "SELECT doc_id, label FROM messy QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) = 1")
def _(spark, sf):
    return C.business_rule(table(spark, sf, "messy"), "label", "unique", order_by="doc_id").select("doc_id", "label")


@query("rule_impact", "T18", """SELECT 'range' AS rule, count(*) AS total, CAST(count_if(balance >= 0) AS BIGINT) AS kept, CAST(count(*) - count_if(balance >= 0) AS BIGINT) AS removed FROM gappy_customer
  UNION ALL SELECT 'unique', count(*), count(DISTINCT segment), count(*) - count(DISTINCT segment) FROM gappy_customer""")
def _(spark, sf):
    df = table(spark, sf, "gappy_customer")
    a = C.rule_impact(df, "balance", "range", min_val=0).withColumn("rule", F.lit("range"))
    return a.unionByName(C.rule_impact(df, "segment", "unique").withColumn("rule", F.lit("unique"))).drop("kept_percentage")


@query("auto_fix", "T19", f"""WITH d AS (SELECT DISTINCT label, lang, CASE WHEN n_chars > 3000 THEN NULL ELSE n_chars END AS size FROM messy)
  SELECT trim(coalesce(label, {mode_of('label', 'd')})) AS label_text, lang AS lang_code, round(coalesce(CAST(size AS DOUBLE), (SELECT CASE WHEN abs(skewness(size)) > 2 THEN quantile_cont(size, 0.5) ELSE avg(size) END FROM d)), 6) AS text_size FROM d""")
def _(spark, sf):
    df = table(spark, sf, "messy").select(F.col("label").alias("LabelText"), F.col("lang").alias("lang-code"), F.expr("CASE WHEN n_chars > 3000 THEN NULL ELSE n_chars END").alias("Text Size"))
    return C.auto_fix(df).withColumn("text_size", F.round("text_size", 6))


@query("pattern_library", "T20", " UNION ALL ".join(f"SELECT {quoted(n)} AS pattern, CAST(count_if(regexp_matches(body, {quoted(p)})) AS BIGINT) AS matching FROM messy" for n, p in text.PATTERNS.items() if n not in ("Whitespace",)))
def _(spark, sf):
    names = [n for n in text.PATTERNS if n != "Whitespace"]
    row = table(spark, sf, "messy").agg(F.array(*[F.struct(F.lit(n).alias("pattern"), F.count_if(text.contains(F.col("body"), text.PATTERNS[n])).alias("matching")) for n in names]).alias("x"))
    return row.select(F.inline("x"))
