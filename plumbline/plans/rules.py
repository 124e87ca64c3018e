"""Rule queries: reading, suggesting, validating, applying."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import apply as A, rules as R, validate as V
from plumbline.plans import query
from plumbline.plans.inputs import table
from plumbline.plans.profiles import SPACES, TRIM, prof, quoted

AS_OF = dt.datetime(2024, 1, 15)


def found(pattern: str, of: str = "s") -> str:
    return f"regexp_matches({of}, {quoted(pattern)})"


def every(pattern: str, group: int) -> str:
    return f"regexp_extract_all(s, {quoted(pattern)}, {group})"


_SCAN = "(SELECT rule_id, column_name || ' ' || coalesce(rule_text, '') AS s FROM rule_texts)"


@query("rule_metadata_flags", "R01 R02 R06 R07", f"""SELECT rule_id, contains(s, '*') OR {found(R.MANDATORY_WORDS)} AS mandatory, {found(R.UNIQUE_WORDS)} AS uniqueness_required,
  concat_ws(',', {', '.join(f"CASE WHEN {found(p)} THEN '{n}' END" for n, p in R.RESTRICTIONS.items())}) AS format_restrictions,
  CASE WHEN {found(R.YES_NO)} THEN 'Yes,No' END AS allowed_values, nullif(regexp_extract(s, {quoted(R.CONDITION)}, 0), '') AS conditional_rule FROM {_SCAN}""")
def _(spark, sf):
    m = R.metadata(table(spark, sf, "rule_texts"), "column_name")
    return m.select(
        "rule_id", "mandatory", "uniqueness_required", F.array_join("format_restrictions", ",").alias("format_restrictions"),
        F.array_join("allowed_values", ",").alias("allowed_values"), "conditional_rule",
    )


@query("rule_metadata_sizes", "R03 R04 R05", f"""SELECT rule_id, coalesce(mx, own) AS max_length, coalesce(np, CASE WHEN np IS NULL THEN ip END) AS precision, ns AS scale,
  coalesce(CASE WHEN np IS NULL AND ip IS NOT NULL THEN 'NUMBER' END, nt, tt) AS data_type_hint,
  len(list_distinct(list_filter(list_concat(ts, CASE WHEN sized IS NULL AND bare IS NOT NULL THEN [bare] ELSE [] END, ms), lambda x: x > 0))) > 1 AS conflict_flag
  FROM (SELECT *, coalesce(sized, bare) AS own FROM (SELECT rule_id, list_transform({every(R.SIZED_TEXT, 2)}, lambda x: TRY_CAST(x AS INTEGER)) AS ts, list_transform({every(R.MAX_SIZE, 1)}, lambda x: TRY_CAST(x AS INTEGER)) AS ms,
  TRY_CAST(ts[-1] AS INTEGER) AS sized, TRY_CAST(({every(R.BARE_SIZE, 1)})[1] AS INTEGER) AS bare, ms[-1] AS mx,
  TRY_CAST(({every(R.SIZED_NUMBER, 2)})[-1] AS INTEGER) AS np, TRY_CAST(({every(R.SIZED_NUMBER, 3)})[-1] AS INTEGER) AS ns, TRY_CAST(({every(R.SIZED_INTEGER, 2)})[-1] AS INTEGER) AS ip,
  upper(({every(R.SIZED_NUMBER, 1)})[-1]) AS nt, upper(({every(R.SIZED_TEXT, 1)})[-1]) AS tt FROM {_SCAN}))""")
def _(spark, sf):
    return R.metadata(table(spark, sf, "rule_texts"), "column_name").select("rule_id", "max_length", "precision", "scale", "data_type_hint", "conflict_flag")


@query("rule_metadata_conversations", "R01 R02 R07", f"""SELECT conv_id, turn, contains(s, '*') OR {found(R.MANDATORY_WORDS)} AS mandatory, {found(R.UNIQUE_WORDS)} AS uniqueness_required
  FROM (SELECT conv_id, turn, role || ' ' || text AS s FROM conversations)""")
def _(spark, sf):
    m = R.metadata(table(spark, sf, "conversations"), "role", "text")
    return m.select("conv_id", "turn", "mandatory", "uniqueness_required")


@query("column_metadata", "R08", f"""SELECT rule_id, CASE WHEN {found(R.SIZED_TEXT)} THEN upper(regexp_extract(s, {quoted(R.SIZED_TEXT)}, 1)) WHEN {found(R.SIZED_NUMBER)} THEN upper(regexp_extract(s, {quoted(R.SIZED_NUMBER)}, 1)) END AS data_type_hint,
  TRY_CAST(coalesce(nullif(regexp_extract(s, {quoted(R.SIZED_TEXT)}, 2), ''), nullif(regexp_extract(s, {quoted(R.SIZED_NUMBER)}, 2), ''), nullif(regexp_extract(s, {quoted(R.BARE_SIZE)}, 1), '')) AS INTEGER) AS max_length FROM {_SCAN}""")
def _(spark, sf):
    scan = table(spark, sf, "rule_texts").select("rule_id", F.concat("column_name", F.lit(" "), F.coalesce("rule_text", F.lit(""))).alias("s"))
    return R.column_metadata(scan, "s").drop("s")


@query("existing_rules", "R09", """SELECT "column", max(rule) AS rule FROM (SELECT CASE WHEN contains(dq_rules, ':') THEN trim(split_part(dq_rules, ':', 1)) ELSE trim(split_part(dq_rules, '-', 1)) END AS "column",
  CASE WHEN contains(dq_rules, ':') THEN trim(substr(dq_rules, instr(dq_rules, ':') + 1)) ELSE trim(substr(dq_rules, instr(dq_rules, '-') + 1)) END AS rule FROM noted WHERE dq_rules IS NOT NULL)
  WHERE "column" IN ('p_partkey', 'dq_rules', 'p_name', 'p_size') GROUP BY 1""")
def _(spark, sf):
    return R.existing_rules(table(spark, sf, "noted"))


_SIZE = r"^(\d+)\s*characters?$"
_LOW = "lower(trim(constraint_text))"


@query("constraint_rules", "R10", f"""SELECT rule_id, x.d AS dimension, column_name || x.r AS data_quality_rule FROM (SELECT *, unnest(list_concat(CASE
  WHEN regexp_matches({_LOW}, '{_SIZE}') THEN [{{'d': 'Character Length', 'r': ' should be maximum ' || regexp_extract({_LOW}, '{_SIZE}', 1) || ' characters'}}]
  WHEN regexp_matches({_LOW}, 'yyyy|mm|dd') THEN [{{'d': 'Validity', 'r': ' must be in ' || constraint_text || ' date format'}}, {{'d': 'Timeliness', 'r': ' should not be future dated'}}]
  WHEN {_LOW} = 'number' THEN [{{'d': 'Validity', 'r': ' must be numeric'}}]
  WHEN contains({_LOW}, 'number without thousand separator') THEN [{{'d': 'Validity', 'r': ' must be numeric'}}, {{'d': 'Conformity', 'r': ' must not contain thousand separators (commas)'}}]
  WHEN regexp_matches({_LOW}, 'text|string') THEN [{{'d': 'Validity', 'r': ' must contain valid text'}}]
  ELSE [{{'d': 'Conformity', 'r': ' must conform to format: ' || constraint_text}}] END,
  CASE WHEN mandatory THEN [{{'d': 'Completeness', 'r': ' must not be blank'}}] ELSE [] END)) AS x FROM constraints)""")
def _(spark, sf):
    c = table(spark, sf, "constraints").select("rule_id", F.col("column_name").alias("column"), F.col("constraint_text").alias("constraint"), "mandatory")
    return R.parse_constraints(c).select("rule_id", "dimension", "data_quality_rule")


HEADERS = ["p_name", "Brand#1", "RING", "large", "ring bolt"]


@query("header_matches", "R11", f"""SELECT p_partkey, CASE {' '.join(f"WHEN lower(trim(p_name)) = '{h.lower()}' THEN '{h}'" for h in HEADERS)}
  {' '.join(f"WHEN contains('{h.lower()}', lower(trim(p_name))) OR contains(lower(trim(p_name)), '{h.lower()}') THEN '{h}'" for h in HEADERS)} END AS matched FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.match_header(F.col("p_name"), HEADERS).alias("matched"))


def rule_rows(spark, sf):
    return table(spark, sf, "rule_rows").withColumnRenamed("column_name", "column")


@query("post_processed_rules", "R12", """WITH j AS (SELECT r.*, f.mandatory, f.max_length AS ml, contains(lower(data_quality_rule), 'character') AS len, contains(lower(data_quality_rule), 'must not be blank') AS blank,
  dimension = 'Completeness' OR contains(lower(data_quality_rule), 'must not be blank') AS comp FROM rule_rows r LEFT JOIN rule_facts f USING (column_name)),
  g AS (SELECT column_name, bool_or(comp) AS comp, bool_or(len) AS len, arg_min(business_field, s_no) AS bf, max(s_no) AS s_no FROM j GROUP BY column_name)
  SELECT s_no, column_name AS "column", CASE WHEN len THEN 'Character Length' ELSE dimension END AS dimension, CASE WHEN comp AND NOT blank THEN business_field || ' must not be blank' WHEN len AND ml > 0 THEN business_field || ' should be maximum ' || ml || ' characters' ELSE data_quality_rule END AS data_quality_rule,
  CASE WHEN trim(regex_pattern) <> '' THEN regex_pattern WHEN (len OR dimension = 'Character Length') AND ml IS NOT NULL THEN '^.{0,' || ml || '}$' ELSE '' END AS regex_pattern FROM j
  UNION ALL SELECT g.s_no, column_name, 'Completeness', bf || ' must not be blank', '' FROM rule_facts f JOIN g USING (column_name) WHERE f.mandatory AND NOT g.comp
  UNION ALL SELECT g.s_no, column_name, 'Character Length', bf || ' should be maximum ' || f.max_length || ' characters', '^.{0,' || f.max_length || '}$' FROM rule_facts f JOIN g USING (column_name) WHERE f.max_length > 0 AND NOT g.len""")
def _(spark, sf):
    facts = table(spark, sf, "rule_facts").withColumnRenamed("column_name", "column")
    return R.post_process(rule_rows(spark, sf), facts).drop("business_field")


_L = "lower(trim(data_quality_rule))"
_REGEX = f"""CASE WHEN dimension IN ('Uniqueness', 'Relevance') THEN '' WHEN {found(R.ALLOWED_VALUES, 'data_quality_rule')} THEN
  '(?i)^(' || array_to_string(list_transform(list_filter(list_transform(string_split(rtrim(trim(regexp_extract(data_quality_rule, {quoted(R.ALLOWED_VALUES)}, 1)), '.'), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(x, '([.& #-])', '\\\\\\1', 'g')), '|') || ')$'
  WHEN dimension = 'Completeness' OR contains({_L}, 'must not be blank') OR contains({_L}, 'not be null') THEN '^(?=.*\\S).*$' WHEN contains({_L}, 'must be numeric') THEN '^-?\\d+(\\.\\d+)?$'
  WHEN dimension = 'Conformity' AND contains({_L}, 'uppercase') THEN '^[^a-z]*$' WHEN dimension = 'Conformity' AND contains({_L}, 'alphanumeric') THEN '^[A-Za-z0-9\\s]+$'
  WHEN {found(R.MAX_CHARS, 'data_quality_rule')} THEN '^.{{0,' || regexp_extract(data_quality_rule, {quoted(R.MAX_CHARS)}, 1) || '}}$' WHEN contains({_L}, 'email') AND contains({_L}, 'format') THEN '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$'
  WHEN regexp_matches({_L}, '\\byyyy-mm-dd\\b') THEN '^\\d{{4}}-\\d{{2}}-\\d{{2}}$' WHEN regexp_matches({_L}, '(in uppercase|uppercase format|must be uppercase)\\b') THEN '^[^a-z]*$' ELSE '' END"""


@query("inferred_patterns", "R13 R14", f"SELECT s_no, CASE WHEN trim(regex_pattern) <> '' THEN regex_pattern ELSE {_REGEX} END AS regex_pattern FROM rule_rows")
def _(spark, sf):
    return R.fill_regex(rule_rows(spark, sf)).select("s_no", "regex_pattern")


@query("suggested_rules", "R15", """WITH f AS (SELECT 'c_custkey' AS "column", 'C Custkey' AS field, 'Numeric' AS fam, 0.0 AS np, count(DISTINCT c_custkey) * 100.0 / count(*) AS up FROM gappy_customer
  UNION ALL SELECT 'c_name', 'C Name', 'Text', 0.0, count(DISTINCT c_name) * 100.0 / count(*) FROM gappy_customer UNION ALL SELECT 'c_nationkey', 'C Nationkey', 'Numeric', 0.0, count(DISTINCT c_nationkey) * 100.0 / count(*) FROM gappy_customer
  UNION ALL SELECT 'segment', 'Segment', 'Text', (count(*) - count(segment)) * 100.0 / count(*), count(DISTINCT segment) * 100.0 / count(*) FROM gappy_customer
  UNION ALL SELECT 'balance', 'Balance', 'Numeric', (count(*) - count(balance)) * 100.0 / count(*), count(DISTINCT balance) * 100.0 / count(*) FROM gappy_customer)
  SELECT "column", field AS business_field, 'Completeness' AS dimension, field || ' should not be blank or null' AS data_quality_rule FROM f WHERE np > 0 UNION ALL SELECT "column", field, 'Uniqueness', field || ' must be unique' FROM f WHERE up >= 95
  UNION ALL SELECT "column", field, 'Validity', field || CASE fam WHEN 'Numeric' THEN ' must be numeric' ELSE ' must contain valid text' END FROM f""")
def _(spark, sf):
    return R.suggest(prof(spark, sf, "gappy_customer")).drop("position")


@query("suggested_rules_plain", "R15", """SELECT 'segment' AS "column", 'Completeness' AS dimension, 'segment should not be blank' AS data_quality_rule FROM gappy_customer HAVING count(*) > count(segment) UNION ALL SELECT 'balance', 'Completeness', 'balance should not be blank' FROM gappy_customer HAVING count(*) > count(balance)
  UNION ALL SELECT 'balance', 'Validity', 'balance must be numeric' FROM gappy_customer HAVING count(*) > 0 UNION ALL SELECT 'c_custkey', 'Uniqueness', 'c_custkey must be unique' FROM gappy_customer HAVING count(DISTINCT c_custkey) * 100.0 / count(*) > 95 UNION ALL SELECT 'c_custkey', 'Validity', 'c_custkey must be numeric' FROM gappy_customer HAVING count(*) > 0""")
def _(spark, sf):
    return R.suggest(prof(spark, sf, "gappy_customer", ["segment", "balance", "c_custkey"]), named_fields=False).select("column", "dimension", "data_quality_rule")


_PAT = "trim(coalesce(regex_pattern, ''))"
_UP = "(dimension = 'Conformity' AND regexp_matches(lower(data_quality_rule), 'upper ?case'))"
_LEN = f"(dimension = 'Character Length' AND {found(R.MAX_CHARS, 'data_quality_rule')})"


@query("executable_rules", "R17", f"""SELECT column_name AS "column", CASE WHEN {_PAT} <> '' THEN 'RG · ' || dimension || ': ' || substr(data_quality_rule, 1, 48) WHEN {_UP} THEN 'RG · Case: ' || substr(data_quality_rule, 1, 48)
  ELSE 'RG · Length ≤ ' || regexp_extract(data_quality_rule, {quoted(R.MAX_CHARS)}, 1) END AS name, CASE WHEN {_PAT} <> '' THEN 'Validate' WHEN {_UP} THEN 'Case' ELSE 'Length' END AS mode,
  {_PAT} AS pattern, CASE WHEN {_PAT} = '' AND NOT {_UP} THEN CAST(regexp_extract(data_quality_rule, {quoted(R.MAX_CHARS)}, 1) AS INTEGER) ELSE 50 END AS max_length FROM rule_rows WHERE {_PAT} <> '' OR {_UP} OR {_LEN}""")
def _(spark, sf):
    return R.executable(rule_rows(spark, sf)).select("column", "name", "mode", "pattern", "max_length")


@query("sample_based_suggestion", "R16 R18", """SELECT vendor_id, CASE WHEN (SELECT bool_or(note LIKE '%\\_%' ESCAPE '\\') FROM (SELECT note FROM vendors WHERE note IS NOT NULL ORDER BY vendor_id LIMIT 20))
  THEN replace(note, '_', ' ') ELSE regexp_replace(note, '[^a-zA-Z0-9\\s]', '', 'g') END AS note FROM vendors""")
def _(spark, sf):
    df = table(spark, sf, "vendors")
    rule = R.suggest_cleaning(df, "note", "vendor_id").first().asDict()
    return A.apply_rules(df, {"note": [rule]}, at=AS_OF)[0].select("vendor_id", "note")


_ASKED = """SELECT p_partkey, p_name || CASE p_partkey % 10 WHEN 0 THEN ' Remove special marks' WHEN 1 THEN ' underscore to SPACE' WHEN 2 THEN ' Upper' WHEN 3 THEN ' lower' WHEN 4 THEN ' title'
  WHEN 5 THEN ' extract number' WHEN 6 THEN ' only digits' WHEN 7 THEN ' email' WHEN 8 THEN ' special' ELSE '' END AS request, p_partkey % 3 = 0 AS underscore FROM part"""


@query("requested_rules", "R16 R18", f"""WITH asked AS ({_ASKED}), said AS (SELECT *, lower(request) AS r FROM asked)
  SELECT p_partkey, CASE WHEN r LIKE '%special%' AND r LIKE '%remove%' THEN 'Remove Special Chars' WHEN r LIKE '%underscore%' AND r LIKE '%space%' THEN 'Replace _ with Space' WHEN r LIKE '%upper%' THEN 'To UPPERCASE'
  WHEN r LIKE '%lower%' THEN 'To lowercase' WHEN r LIKE '%title%' THEN 'To Title Case' WHEN (r LIKE '%number%' OR r LIKE '%digit%') AND (r LIKE '%extract%' OR r LIKE '%only%') THEN 'Extract Digits'
  WHEN r LIKE '%email%' THEN 'Validate Email' WHEN underscore THEN 'Replace _ with Space' ELSE 'Remove Special Chars' END AS name FROM said""")
def _(spark, sf):
    asked = spark.sql(_ASKED.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return asked.select("p_partkey", R.rule_label(R.rule_for_request(F.col("request"), F.col("underscore"))).alias("name"))


@query("explained_rules", "R16", f"""WITH asked AS ({_ASKED}), said AS (SELECT *, lower(request) AS r FROM asked)
  SELECT p_partkey, CASE WHEN r LIKE '%special%' AND r LIKE '%remove%' THEN 'Remove special characters' WHEN r LIKE '%underscore%' AND r LIKE '%space%' THEN 'Replace underscores with spaces' WHEN r LIKE '%upper%' THEN 'Convert to UPPERCASE'
  WHEN r LIKE '%lower%' THEN 'Convert to lowercase' WHEN r LIKE '%title%' THEN 'Convert to Title Case' WHEN (r LIKE '%number%' OR r LIKE '%digit%') AND (r LIKE '%extract%' OR r LIKE '%only%') THEN 'Extract only digits'
  WHEN r LIKE '%email%' THEN 'Validate email format' WHEN underscore THEN 'Replace underscores with spaces' ELSE 'Remove special characters' END AS explanation FROM said""")
def _(spark, sf):
    asked = spark.sql(_ASKED.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return asked.select("p_partkey", R.rule_for_request(F.col("request"), F.col("underscore"))["explanation"].alias("explanation"))


# --- validation -----------------------------------------------------------------------------

RULES = [
    ("label", "Completeness", "Label must not be blank", f"count_if(label IS NULL OR {TRIM.replace('{c}', 'label')} = '')"),
    ("label", "Uniqueness", "Label must be unique", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM messy WHERE label IS NOT NULL GROUP BY label) WHERE n > 1)"),
    ("lang", "Validity", "Lang must be one of: EN, fr, 'de'.", "count_if(lower(trim(lang)) NOT IN ('en', 'fr', 'de'))"),
    ("n_chars", "Validity", "N Chars must be numeric", "count_if(TRY_CAST(n_chars AS DOUBLE) IS NULL AND n_chars IS NOT NULL)"),
    ("label", "Validity", "Label must be a valid string", f"count_if(label IS NULL OR {TRIM.replace('{c}', 'label')} = '')"),
    ("label", "Character Length", "Label should be maximum 8 characters", "count_if(length(label) > 8)"),
    ("label", "Conformity", "Label must be in uppercase", f"count_if({TRIM.replace('{c}', 'label')} <> '' AND label <> upper(label))"),
    ("label", "Conformity", "Label must be in lowercase", f"count_if({TRIM.replace('{c}', 'label')} <> '' AND label <> lower(label))"),
    ("label", "Conformity", "Label must be alphanumeric", f"count_if(trim(label) <> '' AND NOT regexp_matches(trim(label), '^[A-Za-z0-9{SPACES}]+$'))"),
    ("body", "Conformity", "Body has no special characters", f"count_if({TRIM.replace('{c}', 'body')} <> '' AND NOT regexp_matches({TRIM.replace('{c}', 'body')}, '^[A-Za-z0-9{SPACES}\\-_.]+$'))"),
    ("body", "Conformity", "Body should not exceed reasonable length", "count_if(length(body) > 255)"),
    ("label", "Consistency", "Label needs consistent casing", "(SELECT coalesce(sum(k), 0) FROM (SELECT count(DISTINCT trim(label)) AS k FROM messy WHERE label IS NOT NULL GROUP BY lower(trim(label))) WHERE k > 1)"),
    ("n_chars", "Accuracy", "N Chars should be within the range of 100 to 2000", "count_if(n_chars < 100 OR n_chars > 2000)"),
    ("label", "Conformity", "Label should follow the specified format", "(SELECT CASE WHEN count(DISTINCT regexp_replace(regexp_replace(trim(label), '[0-9]', 'N', 'g'), '[A-Za-z]', 'A', 'g')) > 1 THEN count(label) ELSE 0 END FROM messy)"),
    ("label", "Conformity", "Label should conform to expected text format", f"count_if(label IS NULL OR {TRIM.replace('{c}', 'label')} = '')"),
    ("label", "Consistency", "Label should maintain consistent values", "(SELECT coalesce(sum(k), 0) FROM (SELECT count(DISTINCT trim(label)) AS k FROM messy WHERE label IS NOT NULL GROUP BY lower(trim(label))) WHERE k > 1)"),
    ("label", "Relevance", "Label should reflect reality", "0"),
    ("nowhere", "Validity", "Nowhere must be numeric", "0"),
]


def rule_list(items):
    return [{"s_no": i + 1, "column": c, "dimension": d, "data_quality_rule": t, "business_field": c.title(), "source": "stated" if i % 2 else "found"} for i, (c, d, t, _) in enumerate(items)]


@query("validate_rules", "V01 V02 V03 V05 V06 V07 V08 V09 V10 V11 V12 V13 V14 V15 V20", " UNION ALL ".join(
    f"SELECT {i + 1} AS s_no, '{c}' AS \"column\", CAST({sql} AS BIGINT) AS issues_found FROM messy" if sql.startswith("count_if") else f"SELECT {i + 1}, '{c}', CAST({sql} AS BIGINT)"
    for i, (c, _, _, sql) in enumerate(RULES)))
def _(spark, sf):
    return V.validate(table(spark, sf, "messy"), rule_list(RULES), as_of=AS_OF).select("s_no", "column", "issues_found")


_EXAMPLE = """SELECT {i} AS s_no, '{c}' AS "column", n || '{says}' || ex || CASE WHEN d > 5 THEN ' ... and ' || (d - 5) || ' more' ELSE '' END AS example FROM (SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS d,
  (SELECT string_agg({q} || v || {q}, ', ' ORDER BY v) FROM (SELECT DISTINCT {v} AS v FROM messy WHERE {bad} ORDER BY v LIMIT 5)) AS ex FROM (SELECT {v} AS v, count(*) AS k FROM messy WHERE {bad} GROUP BY 1))"""


def example(i, c, says, v, bad, quote=True):
    return _EXAMPLE.replace("{i}", str(i)).replace("{c}", c).replace("{says}", says).replace("{v}", v).replace("{bad}", bad).replace("{q}", "''''" if quote else "''")


@query("validate_examples", "V20", " UNION ALL ".join([
    example(3, "lang", " values not in allowed list, e.g. ", "trim(lang)", "lower(trim(lang)) NOT IN ('en', 'fr', 'de')"),
    example(6, "label", " values exceed 8 chars, e.g. ", "label", "length(label) > 8"),
    example(13, "n_chars", " values outside range [100.0, 2000.0], e.g. ", "'' || n_chars", "n_chars < 100 OR n_chars > 2000", False),
]))
def _(spark, sf):
    out = V.validate(table(spark, sf, "messy"), rule_list(RULES), as_of=AS_OF)
    return out.filter("s_no IN (3, 6, 13)").select("s_no", "column", F.col("issues_found_example").alias("example"))


@query("validate_decimals", "V04", """SELECT 'l_extendedprice' AS "column", CAST(count_if(abs(l_extendedprice * 10 - round(l_extendedprice * 10)) > 1e-6) AS BIGINT) AS issues_found FROM lineitem
  UNION ALL SELECT 'l_discount', CAST(count_if(abs(l_discount * 10 - round(l_discount * 10)) > 1e-6) AS BIGINT) FROM lineitem""")
def _(spark, sf):
    rules = [("l_extendedprice", "Accuracy", "Price may have a maximum of 1 decimal places", ""), ("l_discount", "Accuracy", "Discount has maximum 1 decimal place", "")]
    return V.validate(table(spark, sf, "lineitem"), rule_list(rules)).select("column", "issues_found")


@query("validate_numeric_text", "V05 V12 V18", """WITH n AS (SELECT *, CASE WHEN regexp_matches(trim(s), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim(s) AS DOUBLE) WHEN trim(s) = 'inf' THEN 'inf'::DOUBLE END AS x FROM numeric_text)
  SELECT 1 AS s_no, CAST(count_if(s IS NOT NULL AND x IS NULL) AS BIGINT) AS issues_found FROM n UNION ALL SELECT 2, CAST(count_if(x < 5 OR x > 40) AS BIGINT) FROM n""")
def _(spark, sf):
    rules = [("s", "Validity", "S must be numeric", ""), ("s", "Accuracy", "S should be between 5 and 40", "")]
    return V.validate(table(spark, sf, "numeric_text"), rule_list(rules)).select("s_no", "issues_found")


STATEMENTS = [
    ("label", "Completeness", "label should not be blank", "count_if(label IS NULL)"),
    ("label", "Uniqueness", "label must be unique", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM messy GROUP BY label) WHERE n > 1)"),
    ("n_chars", "Validity", "n_chars should not be negative", "count_if(n_chars < 0)"),
    ("label", "Validity", "label must hold only digits", "count_if(NOT regexp_matches(label, '^[0-9]+$'))"),
    ("label", "Validity", "label must be an email", f"count_if(NOT regexp_matches(label, {quoted(text.EMAIL)}))"),
    ("label", "Validity", "label must be alphanumeric", "count_if(NOT regexp_matches(label, '^[a-zA-Z0-9]+$'))"),
    ("label", "Validity", "label should be maximum 8 characters", "count_if(length(label) > 8)"),
]


@query("validate_statements", "V18 V19", " UNION ALL ".join(
    f"SELECT {i + 1} AS s_no, CAST({sql} AS BIGINT) AS issues_found FROM messy" if sql.startswith("count_if") else f"SELECT {i + 1}, CAST({sql} AS BIGINT)"
    for i, (_, _, _, sql) in enumerate(STATEMENTS)))
def _(spark, sf):
    return V.validate(table(spark, sf, "messy"), rule_list(STATEMENTS), style="statement", as_of=AS_OF).select("s_no", "issues_found")


@query("validate_dates", "V16 V17", """SELECT 1 AS s_no, CAST(count_if(s IN ('soon', '31/02/2024')) AS BIGINT) AS issues_found FROM dated_text UNION ALL SELECT 2, CAST(count_if(s = '2099-12-31' OR (s LIKE '____-__-__' AND s > '2024-01-15')) AS BIGINT) FROM dated_text
  UNION ALL SELECT 3, CAST(count_if(o_orderdate > TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) FROM dated_text""")
def _(spark, sf):
    rules = [("s", "Validity", "S must be a valid calendar date", ""), ("s", "Timeliness", "S must not be future dated", ""), ("o_orderdate", "Timeliness", "Order date must not be in the future", "")]
    return V.validate(table(spark, sf, "dated_text"), rule_list(rules), style="statement", as_of=AS_OF).select("s_no", "issues_found")


@query("merged_results", "V21", """SELECT 'label' AS "column", 'Conformity' AS dimension, CAST(count_if(trim(label) <> '' AND label <> upper(label)) + count_if(trim(label) <> '' AND label <> lower(label)) AS BIGINT) AS issues_found, 'Label must be in uppercase; Label must be in lowercase' AS data_quality_rule FROM messy
  UNION ALL SELECT 'n_chars', 'Accuracy', CAST(count_if(n_chars < 100 OR n_chars > 2000) AS BIGINT), 'N Chars should be within the range of 100 to 2000' FROM messy""")
def _(spark, sf):
    rules = [{**r, "source": "stated"} for r in rule_list([RULES[6], RULES[7], RULES[12]])]
    return R.merge_results(V.validate(table(spark, sf, "messy"), rules)).select("column", "dimension", "issues_found", "data_quality_rule")


# --- application ----------------------------------------------------------------------------

STEPS = {
    "label": [
        {"name": "No marks", "mode": "Clean", "pattern": "[@:]"},
        {"name": "Spaces", "mode": "Replace", "pattern": "(_)_", "replace": r"\1 "},
        {"name": "Letters first", "mode": "Validate", "pattern": "[a-zA-Z]"},
        {"name": "Upper", "mode": "Case", "case": "UPPERCASE"},
        {"name": "Short", "mode": "Length", "length_mode": "Maximum", "max_length": 12},
    ],
    "lang": [{"name": "Vowels", "mode": "Extract", "pattern": "[aeiou]"}],
}
_S1 = "regexp_replace(label, '[@:]', '', 'g')"
_S2 = f"regexp_replace({_S1}, '(_)_', '\\1 ', 'g')"
_WHY = f"CASE WHEN label IS NULL OR NOT regexp_matches({_S2}, '^[a-zA-Z]') THEN 'Letters first - Does not match' WHEN length({_S2}) > 12 THEN 'Short - Length check failed' WHEN NOT regexp_matches(lang, '[aeiou]') THEN 'Vowels - No matches' END"


@query("apply_rules_good", "X01 X02 X03 X04 X05 X06 X07 X08", f"""SELECT doc_id, upper({_S2}) AS label, array_to_string(regexp_extract_all(lang, '[aeiou]'), '') AS lang, n_chars, body FROM messy WHERE {_WHY} IS NULL""")
def _(spark, sf):
    return A.apply_rules(table(spark, sf, "messy"), STEPS, at=AS_OF)[0]


@query("apply_rules_rejects", "X07 X08 S20", f"""SELECT doc_id, CASE WHEN why LIKE 'Letters%' THEN {_S2} ELSE upper({_S2}) END AS label, CASE WHEN why LIKE 'Vowels%' THEN '' ELSE lang END AS lang, why AS rejection_reason, CASE WHEN why LIKE 'Vowels%' THEN 'lang' ELSE 'label' END AS rejected_column, '2024-01-15 00:00:00' AS rejected_at
  FROM (SELECT *, {_WHY} AS why FROM messy) WHERE why IS NOT NULL""")
def _(spark, sf):
    return A.apply_rules(table(spark, sf, "messy"), STEPS, at=AS_OF)[1].drop("n_chars", "body")


@query("apply_title_case", "X05", f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(body, 'ß', 'ss'), '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS body FROM messy""")
def _(spark, sf):
    rule = {"name": "Title", "mode": "Case", "case": "Title Case"}
    # The engines differ on the capital of one letter, so it is spelled out first.
    df = table(spark, sf, "messy").withColumn("body", F.replace("body", F.lit("ß"), F.lit("ss")))
    return A.apply_rules(df, {"body": [rule]}, at=AS_OF)[0].select("doc_id", "body")


@query("apply_length_modes", "X06", """SELECT mode, count(*) AS kept FROM (SELECT 'Exact' AS mode, label FROM messy WHERE length(label) = 5 UNION ALL SELECT 'Minimum', label FROM messy WHERE length(label) >= 4 UNION ALL SELECT 'Range', label FROM messy WHERE length(label) BETWEEN 4 AND 9) GROUP BY mode""")
def _(spark, sf):
    out = None
    for mode in ("Exact", "Minimum", "Range"):
        rule = {"name": mode, "mode": "Length", "length_mode": mode, "exact_length": 5, "min_length": 4, "max_length": 9}
        one = A.apply_rules(table(spark, sf, "messy"), {"label": [rule]}, at=AS_OF)[0].agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out


@query("apply_keep_nulls", "X07", """SELECT doc_id, label FROM messy WHERE label IS NULL OR regexp_matches(label, '^src')""")
def _(spark, sf):
    rule = {"name": "Source", "mode": "Validate", "pattern": "src"}
    return A.apply_rules(table(spark, sf, "messy"), {"label": [rule]}, null_policy="keep", at=AS_OF)[0].select("doc_id", "label")


@query("rule_preview", "X09", """SELECT label AS "before", CASE WHEN regexp_matches(label, '^src') THEN label ELSE '[REJECT]' END AS "after", CASE WHEN regexp_matches(label, '^src') THEN 'Valid' ELSE 'Rejected' END AS status
  FROM (SELECT * FROM messy WHERE label IS NOT NULL ORDER BY doc_id LIMIT 10)""")
def _(spark, sf):
    return A.preview(table(spark, sf, "messy"), "label", {"name": "Source", "mode": "Validate", "pattern": "src"}, order_by="doc_id")
