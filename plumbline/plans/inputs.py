"""Inputs of the registered queries: the given tables, and tables derived from all of their rows.

The given tables hold no NULLs and little dirt, so gaps and defects are derived with expressions
that read the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DERIVED = {
    "gappy_customer": """
        SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment,
               CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN c_acctbal * 40 ELSE c_acctbal END AS balance
        FROM {customer}""",
    "messy": """
        SELECT doc_id, lang, n_chars,
               CASE doc_id % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
                    WHEN 3 THEN upper(source) || '  ' || lang WHEN 4 THEN source || '@' || lang || '.com'
                    WHEN 5 THEN 'http://' || source || '/' || lang WHEN 6 THEN '2024-01-' || (10 + doc_id % 19)
                    WHEN 7 THEN '+1 555-' || (1000 + doc_id % 9000) WHEN 8 THEN ' ' || source || '_' || '_' || lang
                    WHEN 9 THEN 'Source Of ' || upper(lang) WHEN 10 THEN 'N/A' ELSE source END AS label,
               text AS body
        FROM {documents}""",
    "mostly_emails": """
        SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'no mail' ELSE lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.com' END AS email
        FROM {customer}""",
    "numeric_text": """
        SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN p_size || 'd'
               WHEN 3 THEN p_size || 'e2' WHEN 4 THEN 'inf' WHEN 5 THEN '1,' || p_size WHEN 6 THEN '-' || p_size || '.5' ELSE '' || p_size END AS s
        FROM {part}""",
    "dated_text": """
        SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '31/02/2024' WHEN 1 THEN substr('' || o_orderdate, 1, 10) WHEN 2 THEN NULL
               WHEN 3 THEN 'soon' ELSE '2099-12-31' END AS s, o_orderdate
        FROM {orders}""",
    "changed_customer": """
        SELECT c_custkey + CASE WHEN c_custkey % 97 = 0 THEN 100000000 ELSE 0 END AS c_custkey, c_name,
               c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment,
               CASE WHEN c_custkey % 13 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
        FROM {customer}""",
    "vendors": """
        SELECT s_suppkey AS vendor_id, CASE WHEN s_suppkey % 4 = 0 THEN 'N/A' WHEN s_suppkey % 4 = 1 THEN s_name ELSE 'Vendor ' || (s_suppkey % 37) END AS vendor_name,
               CASE WHEN s_suppkey % 3 = 0 THEN '-' WHEN s_suppkey % 3 = 1 THEN 'x' || (s_suppkey % 41) || '@mail.com' ELSE NULL END AS email,
               CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status, s_acctbal AS balance,
               'note ' || (s_suppkey % 500) AS note
        FROM {supplier}""",
    "spelled": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'The ' || p_name || ' of ' || p_type ELSE replace(p_name, ' ', '-') END AS title,
               CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE lower(p_brand) END AS brand, p_size, p_retailprice
        FROM {part}""",
    "rule_texts": """
        SELECT p_partkey AS rule_id, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 4 = 0 THEN '*' ELSE '' END AS column_name,
               CASE p_partkey % 16 WHEN 0 THEN 'VARCHAR2(' || p_size || ' CHAR)' WHEN 1 THEN 'NUMBER(' || (10 + p_size) || ',2)'
                    WHEN 2 THEN 'must be unique, max length ' || p_size WHEN 3 THEN 'Mandatory if status is open. See lov'
                    WHEN 4 THEN 'Yes / No in uppercase' WHEN 5 THEN 'INT ' || p_size WHEN 6 THEN 'CHAR(10) or VARCHAR(' || p_size || ')'
                    WHEN 7 THEN 'alphanumeric, no spaces, no leading zero' WHEN 8 THEN 'Code (' || p_size || ')'
                    WHEN 9 THEN 'YYYY-MM-DD, future date not allowed' WHEN 10 THEN 'primary key, lower case'
                    WHEN 11 THEN 'maximum ' || p_size || ' characters' WHEN 12 THEN 'required when paid'
                    WHEN 13 THEN NULL WHEN 14 THEN 'TEXT ' || p_size ELSE p_type END AS rule_text
        FROM {part}""",
    "rule_rows": """
        SELECT p_partkey AS s_no, 'col' || (p_partkey % 50) AS column_name,
               CASE p_partkey % 6 WHEN 0 THEN 'Completeness' WHEN 1 THEN 'Conformity' WHEN 2 THEN 'Character Length' WHEN 3 THEN 'Validity'
                    WHEN 4 THEN 'Uniqueness' ELSE 'Accuracy' END AS dimension,
               CASE p_partkey % 12 WHEN 0 THEN p_name || ' should be filled' WHEN 1 THEN p_name || ' must be in uppercase'
                    WHEN 2 THEN p_name || ' should be maximum ' || p_size || ' characters' WHEN 3 THEN p_name || ' must be one of: A, ' || p_type || ', x.y'
                    WHEN 4 THEN p_name || ' must be unique' WHEN 5 THEN p_name || ' must be numeric' WHEN 6 THEN p_name || ' must not be blank'
                    WHEN 7 THEN p_name || ' must be alphanumeric' WHEN 8 THEN p_name || ' max ' || p_size || ' characters'
                    WHEN 9 THEN p_name || ' must be in YYYY-MM-DD' WHEN 10 THEN p_name || ' no duplicates' ELSE p_name || ' must follow the email format' END AS data_quality_rule,
               CASE WHEN p_partkey % 7 = 0 THEN '^x$' WHEN p_partkey % 7 = 1 THEN ' ' ELSE '' END AS regex_pattern,
               p_name AS business_field
        FROM {part}""",
    "rule_facts": """
        SELECT 'col' || (p_partkey % 50) AS column_name, max(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) = 1 AS mandatory, CAST(min(p_size) AS INT) AS max_length
        FROM {part} GROUP BY 'col' || (p_partkey % 50)""",
    "constraints": """
        SELECT p_partkey AS rule_id, p_name AS column_name, p_partkey % 2 = 0 AS mandatory,
               CASE p_partkey % 7 WHEN 0 THEN p_size || ' Characters' WHEN 1 THEN 'YYYY/MM/DD' WHEN 2 THEN ' Number' WHEN 3 THEN 'Number without thousand separator'
                    WHEN 4 THEN 'Text' WHEN 5 THEN p_brand ELSE p_size || ' chars only' END AS constraint_text
        FROM {part}""",
    "noted": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'p_size: at most ' || p_size WHEN 1 THEN 'p_name - ' || p_type WHEN 2 THEN NULL ELSE 'other: ' || p_brand END AS dq_rules,
               p_name, p_size
        FROM {part}""",
    "wide_keys": """
        SELECT o_orderkey + 9007199254740993 AS wide_key, CAST(o_orderkey AS DECIMAL(20, 2)) * 100000000000000 + 0.07 AS amount
        FROM {orders}""",
    "tied_parts": """
        SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS p_size
        FROM {part}""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, or one of the derived ones."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    sql = DERIVED[name]
    used = set(re.findall(r"{(\w+)}", sql))
    return spark.sql(sql, **{t: table(spark, sf, t) for t in used})


def with_inputs(sql: str) -> str:
    """Put the derived tables that a DuckDB query names in front of it."""
    needed = [n for n in DERIVED if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', DERIVED[n])})" for n in needed]
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
