"""Selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import select as S
from plumbline.plans import query
from plumbline.plans.inputs import table


@query("pick_columns", "P01", "SELECT l_shipdate, l_orderkey FROM lineitem")
def _(spark, sf):
    return S.pick(table(spark, sf, "lineitem"), ["l_shipdate", "l_orderkey"])


@query("drop_columns", "P02", "SELECT * EXCLUDE (p_type, p_size) FROM part")
def _(spark, sf):
    return S.drop_columns(table(spark, sf, "part"), ["p_type", "p_size"])


@query("drop_ghost_columns", "P03", "SELECT p_partkey, p_brand AS _c7 FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.lit(None).cast("string").alias("Unnamed: 3"), F.lit(None).cast("int").alias("_c3"), F.col("p_brand").alias("_c7"))
    return S.drop_ghost_columns(df)


@query("page_of_rows", "P04", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 150")
def _(spark, sf):
    return S.page(table(spark, sf, "orders"), 3, 50, ["o_orderdate", "o_orderkey"])


@query("search_rows", "P05", r"SELECT * FROM messy WHERE regexp_matches('' || doc_id, '(?i)SRC1\d|99') OR regexp_matches(lang, '(?i)SRC1\d|99') OR regexp_matches('' || n_chars, '(?i)SRC1\d|99') OR coalesce(regexp_matches(label, '(?i)SRC1\d|99'), false) OR regexp_matches(body, '(?i)SRC1\d|99')")
def _(spark, sf):
    return S.search(table(spark, sf, "messy"), r"SRC1\d|99")


@query("sample_percent", "P06")
def _(spark, sf):
    return S.sample_percent(table(spark, sf, "lineitem"), 5)


@query("expression_rule", "P07 P09", "SELECT count(*) AS total, CAST(count_if(balance >= 0 AND balance < 5000) AS BIGINT) AS valid, CAST(count(*) - count_if(balance >= 0 AND balance < 5000) AS BIGINT) AS invalid, round(count_if(balance >= 0 AND balance < 5000) * 100.0 / count(*), 2) AS coverage FROM gappy_customer")
def _(spark, sf):
    return S.mask_summary(table(spark, sf, "gappy_customer"), S.expression_mask("balance", "value >= 0 and value < 5000"))


@query("regex_rule", "P08 P09", "SELECT count(*) AS total, CAST(count_if(regexp_matches(label, '^(?:src|SRC)')) AS BIGINT) AS valid, CAST(count(*) - count_if(regexp_matches(label, '^(?:src|SRC)')) AS BIGINT) AS invalid, round(count_if(regexp_matches(label, '^(?:src|SRC)')) * 100.0 / count(*), 2) AS coverage FROM messy")
def _(spark, sf):
    return S.mask_summary(table(spark, sf, "messy"), S.regex_mask("label", "src|SRC"))


@query("regex_rule_invalid_rows", "P09", "SELECT doc_id, label FROM messy WHERE NOT coalesce(regexp_matches(label, '^(?:src|SRC)'), false)")
def _(spark, sf):
    return S.invalid_rows(table(spark, sf, "messy"), S.regex_mask("label", "src|SRC")).select("doc_id", "label")


@query("top_values", "P10", 'SELECT l_suppkey AS "value", count(*) AS "count" FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 10')
def _(spark, sf):
    return S.top_values(table(spark, sf, "lineitem"), "l_suppkey")


@query("safe_preview", "P12", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS text, lang, source, n_chars FROM documents")
def _(spark, sf):
    return S.safe_preview(table(spark, sf, "documents"))


@query("safe_preview_nested", "P12", "SELECT event_id, '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' AS detail FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")).alias("detail"))
    return S.safe_preview(df)
