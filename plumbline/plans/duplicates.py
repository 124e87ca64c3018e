"""Duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import similarity
from plumbline.operators import duplicates as D, fuzzy as Z
from plumbline.plans import query
from plumbline.plans.inputs import table
from plumbline.plans.profiles import prof

PLACE = "upper(trim({c})) IN ('', 'NULL', 'NONE', 'NA', 'N/A', 'NAN', 'BLANK', '-', '--', '---')"


@query("exact_groups", "D01", """SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS group_id, p_partkey AS row_id, 'exact' AS match_type, CAST(100.0 AS DOUBLE) AS similarity FROM tied_parts
  QUALIFY count(*) OVER (PARTITION BY p_brand, p_type, p_size) > 1""")
def _(spark, sf):
    return D.exact_groups(table(spark, sf, "tied_parts"), "p_partkey", ["p_brand", "p_type", "p_size"]).select("group_id", "row_id", "match_type", "similarity")


@query("exact_groups_long_text", "D01", """SELECT min(doc_id) OVER (PARTITION BY text) AS group_id, doc_id AS row_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1""")
def _(spark, sf):
    return D.exact_groups(table(spark, sf, "documents"), "doc_id", ["text"]).select("group_id", "row_id")


@query("exact_groups_null_pairs", "D01", """SELECT min(doc_id) OVER (PARTITION BY a, b) AS group_id, doc_id AS row_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS a, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS b FROM documents)
  WHERE a IS NOT NULL OR b IS NOT NULL QUALIFY count(*) OVER (PARTITION BY a, b) > 1""")
def _(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS a", "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS b")
    return D.exact_groups(df, "doc_id", ["a", "b"]).select("group_id", "row_id")


@query("exact_group_sizes", "D01", """SELECT l_quantity, l_discount, l_returnflag, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return D.group_sizes(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"])


@query("drop_duplicates_first", "D02", """SELECT * FROM tied_parts QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1""")
def _(spark, sf):
    return D.drop_duplicates(table(spark, sf, "tied_parts"), ["p_brand", "p_size"], "first", "p_partkey")


@query("drop_duplicates_last", "D02", """SELECT * FROM tied_parts QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey DESC) = 1""")
def _(spark, sf):
    return D.drop_duplicates(table(spark, sf, "tied_parts"), ["p_brand", "p_size"], "last", "p_partkey")


@query("drop_duplicates_none", "D03", """SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_quantity) = 1""")
def _(spark, sf):
    return D.drop_duplicates(table(spark, sf, "lineitem"), ["l_partkey", "l_quantity"], "none")


@query("normalize_text", "D04", r"""SELECT p_partkey, strip_accents(trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS normalized FROM spelled""")
def _(spark, sf):
    return table(spark, sf, "spelled").select("p_partkey", similarity.normalize(F.col("title")).alias("normalized"))


@query("normalize_long_text", "D04")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", similarity.normalize(F.col("text")).alias("normalized"))


def name_pairs(spark, sf):
    """Every distinct name beside itself with its brand in front."""
    return table(spark, sf, "spelled").select(F.lower("title").alias("a"), F.concat("brand", F.lit(" "), F.lower("title")).alias("b")).distinct()


_PAIRS = "(SELECT DISTINCT lower(title) AS a, brand || ' ' || lower(title) AS b FROM spelled)"


@query("similarity_jaro_winkler", "D07", f"SELECT a, b, round(jaro_winkler_similarity(a, b) * 100, 6) AS jaro_winkler FROM {_PAIRS}")
def _(spark, sf):
    return Z.pair_scores(name_pairs(spark, sf), "a", "b", ["jaro_winkler"]).withColumn("jaro_winkler", F.round("jaro_winkler", 6))


@query("similarity_ratio", "D05", f"SELECT a, b, round(200.0 * length(a) / (length(a) + length(b)), 6) AS ratio FROM {_PAIRS}")
def _(spark, sf):
    # The second text contains the first one whole, so their longest common subsequence is the first.
    return Z.pair_scores(name_pairs(spark, sf), "a", "b", ["ratio"]).withColumn("ratio", F.round("ratio", 6))


@query("similarity_others", "D06 D08 D09")
def _(spark, sf):
    return Z.pair_scores(name_pairs(spark, sf), "a", "b", ["difflib", "phonetic", "combined"])


@query("phonetic_groups", "D08 D10")
def _(spark, sf):
    return Z.fuzzy_groups(table(spark, sf, "part"), "p_name", "p_partkey", algorithm="phonetic")


@query("fuzzy_groups_names", "D10", """WITH RECURSIVE
  n AS (SELECT p_name AS t, min(p_partkey) AS id FROM part GROUP BY p_name),
  r AS (SELECT t, id, row_number() OVER (ORDER BY id) AS k FROM n),
  e AS (SELECT x.k AS lo, y.k AS hi FROM r x, r y WHERE x.k < y.k AND jaro_winkler_similarity(x.t, y.t) >= 0.85),
  walk(k, lead) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
    UNION ALL
    SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.hi = w.k + 1 AND list_contains(w.lead, e.lo)) THEN w.lead ELSE list_append(w.lead, w.k + 1) END
    FROM walk w WHERE w.k < (SELECT max(k) FROM r)),
  heads AS (SELECT unnest(lead) AS k FROM walk WHERE k = (SELECT max(k) FROM r)),
  own AS (SELECT r.t, r.k, coalesce((SELECT min(e.lo) FROM e WHERE e.hi = r.k AND e.lo IN (SELECT k FROM heads)), r.k) AS head,
          r.k IN (SELECT k FROM heads) AS is_head FROM r),
  final AS (SELECT o.t, h.id AS group_id FROM own o JOIN r h ON h.k = CASE WHEN o.is_head THEN o.k ELSE o.head END)
  SELECT f.group_id, p.p_partkey AS row_id FROM part p JOIN final f ON f.t = p.p_name
  QUALIFY count(*) OVER (PARTITION BY f.group_id) > 1""")
def _(spark, sf):
    return Z.fuzzy_groups(table(spark, sf, "part"), "p_name", "p_partkey", 85.0, "jaro_winkler").select("group_id", "row_id")


def lcs_ratio(a: str, b: str) -> str:
    """SQL: Indel similarity of two ASCII texts of up to 120 characters, their longest common subsequence by bits."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = ch THEN 1::HUGEINT << i ELSE 0::HUGEINT END))"
    steps = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    row = f"list_reduce(list_prepend({full}, {steps}), lambda row, m: ((row + (row & m)) | (row - (row & m))) & {full})"
    return f"(200.0 * (length({a}) - bit_count({row})) / (length({a}) + length({b})))"


def ratio_groups(rows: str, match_type: str) -> str:
    """SQL: groups of similar texts among rows (block, row_id, value), one by one in the order of the ids."""
    plain = r"regexp_replace(lower(value), '[^\w\s]', '', 'g')"
    return f"""WITH RECURSIVE
  src AS ({rows}),
  x AS (SELECT block, row_id, value, trim(regexp_replace({plain}, '\\s+', ' ', 'g')) AS t FROM src WHERE value IS NOT NULL),
  n AS (SELECT block, t, min(row_id) AS id FROM x WHERE t <> '' GROUP BY block, t),
  r AS (SELECT *, row_number() OVER (ORDER BY id, block) AS k FROM n),
  e AS (SELECT a.k AS lo, b.k AS hi FROM r a JOIN r b ON a.block = b.block AND a.k < b.k AND least(length(a.t), length(b.t)) >= 0.73 * greatest(length(a.t), length(b.t)) WHERE {lcs_ratio('a.t', 'b.t')} >= 85),
  walk(k, lead) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
    UNION ALL
    SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.hi = w.k + 1 AND list_contains(w.lead, e.lo)) THEN w.lead ELSE list_append(w.lead, w.k + 1) END
    FROM walk w WHERE w.k < (SELECT max(k) FROM r)),
  heads AS (SELECT unnest(lead) AS k FROM walk WHERE k = (SELECT max(k) FROM r)),
  own AS (SELECT r.*, CASE WHEN r.k IN (SELECT k FROM heads) THEN r.k ELSE (SELECT min(e.lo) FROM e WHERE e.hi = r.k AND e.lo IN (SELECT k FROM heads)) END AS head FROM r),
  member AS (SELECT x.*, o.head, l.id AS leader, l.t AS lead_text, row_number() OVER (PARTITION BY o.head ORDER BY x.row_id) AS place, count(*) OVER (PARTITION BY o.head) AS size
             FROM x JOIN own o USING (block, t) JOIN r l ON l.k = o.head),
  two AS (SELECT head, {lcs_ratio('lead_text', 't')} AS similarity FROM member WHERE place = 2)
  SELECT m.leader AS group_id, m.row_id, '{match_type}' AS match_type, two.similarity, first_value(m.value) OVER (PARTITION BY m.head ORDER BY m.row_id) AS representative
  FROM member m JOIN two USING (head)"""


@query("fuzzy_groups_customers", "D10")
def _(spark, sf):
    return Z.fuzzy_groups(table(spark, sf, "customer"), "c_name", "c_custkey")


@query("fuzzy_groups_urls", "D10", ratio_groups("SELECT 0 AS block, page_id AS row_id, url AS value FROM pages", "fuzzy"))
def _(spark, sf):
    return Z.fuzzy_groups(table(spark, sf, "pages"), "url", "page_id").drop("key_columns")


@query("fuzzy_groups_titles", "D10", ratio_groups("SELECT 0 AS block, p_partkey AS row_id, p_name || ' ' || p_brand AS value FROM part", "fuzzy"))
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    return Z.fuzzy_groups(parts, "title", "p_partkey").drop("key_columns")


_NAMES, _MAILS = (ratio_groups(f"SELECT 0 AS block, vendor_id AS row_id, {c} AS value FROM vendors", "fuzzy") for c in ("vendor_name", "email"))


@query("fuzzy_groups_columns", "D11", f"SELECT 'vendor_name:' || group_id AS group_id, * EXCLUDE (group_id) FROM ({_NAMES}) UNION ALL SELECT 'email:' || group_id, * EXCLUDE (group_id) FROM ({_MAILS})")
def _(spark, sf):
    return Z.fuzzy_groups_all(table(spark, sf, "vendors"), ["vendor_name", "email"], "vendor_id").drop("key_columns")


@query("combined_groups", "D12", f"SELECT 'p_name:' || group_id AS group_id, * EXCLUDE (group_id) FROM ({ratio_groups('SELECT p_brand AS block, p_partkey AS row_id, p_name AS value FROM part', 'combined')})")
def _(spark, sf):
    return Z.combined_groups(table(spark, sf, "part"), ["p_brand"], ["p_name"], "p_partkey").drop("key_columns")


def brand_groups(spark, sf):
    return D.exact_groups(table(spark, sf, "tied_parts"), "p_partkey", ["p_brand", "p_size"])


@query("resolve_keep_first", "D13", """SELECT * FROM tied_parts QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1""")
def _(spark, sf):
    return D.resolve(table(spark, sf, "tied_parts"), "p_partkey", brand_groups(spark, sf), "keep_first")


@query("resolve_keep_last", "D13", """SELECT * FROM tied_parts QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey DESC) = 1""")
def _(spark, sf):
    return D.resolve(table(spark, sf, "tied_parts"), "p_partkey", brand_groups(spark, sf), "keep_last")


@query("resolve_keep_multiple", "D14", """SELECT p_partkey, p_brand, p_type, p_size FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM tied_parts WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey))
  WHERE n = 1 OR (n >= 2 AND r = 2) OR (n >= 6 AND r = 6)""")
def _(spark, sf):
    return D.resolve(table(spark, sf, "tied_parts"), "p_partkey", brand_groups(spark, sf), "keep_multiple", positions=[1, 5])


@query("resolve_keep_selected", "D14", """SELECT p_partkey, p_brand, p_type, p_size FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM tied_parts WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey))
  WHERE n = 1 OR CASE WHEN n >= 5 THEN r = 5 ELSE r = 1 END""")
def _(spark, sf):
    return D.resolve(table(spark, sf, "tied_parts"), "p_partkey", brand_groups(spark, sf), "keep_selected", positions=[4])


@query("resolve_merge", "D15", """SELECT min(p_partkey) AS p_partkey, p_brand, arg_min(p_type, p_partkey) AS p_type, arg_min(p_size, p_partkey) AS p_size FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM tied_parts) GROUP BY p_brand, p_type""")
def _(spark, sf):
    df = table(spark, sf, "tied_parts")
    return D.resolve(df, "p_partkey", D.exact_groups(df, "p_partkey", ["p_brand", "p_type"]), "merge")


@query("resolve_selected_groups", "D16", """SELECT p_partkey, p_brand, p_type, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS g FROM tied_parts)
  WHERE r = 1 OR p_brand <> 'Brand#13' OR p_size IS NULL""")
def _(spark, sf):
    df = table(spark, sf, "tied_parts")
    groups = brand_groups(spark, sf)
    chosen = groups.join(df.filter("p_brand = 'Brand#13' AND p_size IS NOT NULL").select(F.col("p_partkey").alias("row_id")), "row_id", "left_semi")
    return D.resolve(df, "p_partkey", groups, "keep_first", group_ids=chosen)


@query("group_summary", "D17", """SELECT min(p_partkey) AS group_id, count(*) AS rows, CAST(100.0 AS DOUBLE) AS similarity, 'exact' AS match_type, 'p_brand, p_size' AS key_columns FROM tied_parts GROUP BY p_brand, p_size HAVING count(*) > 1""")
def _(spark, sf):
    return D.group_summary(brand_groups(spark, sf)).drop("preview").withColumn("key_columns", F.array_join("key_columns", ", "))


@query("group_totals", "D17", """SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM tied_parts GROUP BY p_brand, p_size HAVING count(*) > 1)""")
def _(spark, sf):
    return D.group_totals(brand_groups(spark, sf))


_VENDOR_COLUMNS = {"vendor_id": False, "vendor_name": True, "email": True, "status": True, "balance": False, "note": True}
_STATS = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", {str(t).lower()} AS is_text, count(*) AS n, (count(*) - count({c})) * 100.0 / count(*) AS np, count(DISTINCT {c}) * 100.0 / count(*) AS up,
    count(*) - count(DISTINCT {c}) AS dups, (count(*) - count(DISTINCT {c})) * 100.0 / count(*) AS dp, {f'min(length({c}))' if t else '0'} AS minl, {f'max(length({c}))' if t else '0'} AS maxl,
    {f'coalesce(avg(length({c})), 0)' if t else '0.0'} AS avgl FROM vendors"""
    for i, (c, t) in enumerate(_VENDOR_COLUMNS.items())
)


@query("match_rules_exact", "D18", f"""SELECT "column", score FROM (SELECT *, CASE WHEN up >= 95 THEN 35 WHEN up >= 80 THEN 25 ELSE 0 END + CASE WHEN np < 1 THEN 20 WHEN np < 5 THEN 15 ELSE 0 END
  + CASE WHEN is_text AND minl = maxl AND avgl BETWEEN 4 AND 20 THEN 25 ELSE 0 END + CASE WHEN dp > 0 AND dp < 5 THEN 15 ELSE 0 END AS score FROM ({_STATS}) WHERE up < 100 AND dups > 0) WHERE score >= 50""")
def _(spark, sf):
    return D.exact_candidates(prof(spark, sf, "vendors")).select("column", "score")


@query("match_rules_fuzzy", "D19", f"""SELECT "column", score FROM (SELECT *, CASE WHEN up BETWEEN 30 AND 90 THEN 35 WHEN up >= 10 AND up < 30 THEN 20 ELSE 0 END + CASE WHEN avgl BETWEEN 10 AND 100 THEN 25 WHEN avgl > 100 THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches("column", 'name|desc|title|product|customer|company|vendor|supplier|brand|item') THEN 25 ELSE 0 END + CASE WHEN dups > 1 THEN 15 ELSE 0 END AS score FROM ({_STATS}) WHERE is_text) WHERE score >= 45""")
def _(spark, sf):
    return D.fuzzy_candidates(prof(spark, sf, "vendors")).select("column", "score")


@query("match_rules", "D18 D19 D20")
def _(spark, sf):
    return D.suggest_match_rules(prof(spark, sf, "vendors"))


@query("match_rule_table", "D18 D19 D20", f"""WITH st AS ({_STATS}),
  ex AS (SELECT position, "column" AS c, score, row_number() OVER (ORDER BY score DESC, position) AS r FROM (SELECT *, CASE WHEN up >= 95 THEN 35 WHEN up >= 80 THEN 25 ELSE 0 END + CASE WHEN np < 1 THEN 20 WHEN np < 5 THEN 15 ELSE 0 END
    + CASE WHEN is_text AND minl = maxl AND avgl BETWEEN 4 AND 20 THEN 25 ELSE 0 END + CASE WHEN dp > 0 AND dp < 5 THEN 15 ELSE 0 END AS score FROM st WHERE up < 100 AND dups > 0) WHERE score >= 50 QUALIFY r <= 4),
  fu AS (SELECT position, "column" AS c, score, row_number() OVER (ORDER BY score DESC, position) AS r FROM (SELECT *, CASE WHEN up BETWEEN 30 AND 90 THEN 35 WHEN up >= 10 AND up < 30 THEN 20 ELSE 0 END + CASE WHEN avgl BETWEEN 10 AND 100 THEN 25 WHEN avgl > 100 THEN 15 ELSE 0 END
    + CASE WHEN regexp_matches("column", 'name|desc|title|product|customer|company|vendor|supplier|brand|item') THEN 25 ELSE 0 END + CASE WHEN dups > 1 THEN 15 ELSE 0 END AS score FROM st WHERE is_text) WHERE score >= 45 QUALIFY r <= 4),
  rules AS (SELECT 0 AS kind, r, 'Exact' AS rule_type, c AS columns, CASE WHEN score >= 85 THEN 'Strongest' WHEN score >= 75 THEN 'Very Strong' WHEN score >= 65 THEN 'Strong' ELSE 'Good' END AS match_probability, CAST(score AS DOUBLE) AS confidence FROM ex
    UNION ALL SELECT 1, r, 'Fuzzy', c, CASE WHEN score >= 70 THEN 'Strong' WHEN score >= 60 THEN 'Good' ELSE 'Medium' END, CAST(score AS DOUBLE) FROM fu
    UNION ALL SELECT 2, ex.r * 10 + fu.r, 'Combined', ex.c || ' (Exact) + ' || fu.c || ' (Fuzzy)', CASE WHEN (ex.score + fu.score) / 2.0 >= 75 THEN 'Enterprise' WHEN (ex.score + fu.score) / 2.0 >= 65 THEN 'Strong' ELSE 'Good' END, (ex.score + fu.score) / 2.0 FROM ex, fu WHERE ex.r <= 2 AND fu.r <= 3 AND ex.c <> fu.c),
  best AS (SELECT * FROM rules ORDER BY kind, r LIMIT 10)
  SELECT printf('R%02d', row_number() OVER (ORDER BY confidence DESC, kind, r)) AS rule_no, rule_type, columns, match_probability, confidence FROM best""")
def _(spark, sf):
    return D.suggest_match_rules(prof(spark, sf, "vendors")).drop("rationale")


@query("column_roles", "D21", f"""SELECT "column", CASE WHEN regexp_matches("column", 'id|key|uuid|guid|serial|sequence') AND up > 95 THEN 'unique_identifiers'
  WHEN regexp_matches("column", 'name|number|email|phone|mobile|tax|pan|gstin|account|code|vendor|supplier|customer') THEN 'critical_business'
  WHEN regexp_matches("column", 'batch|import|action|status|created|updated|modified|date|time|user') THEN 'metadata' ELSE 'descriptive' END AS category FROM ({_STATS})""")
def _(spark, sf):
    return D.categorize(prof(spark, sf, "vendors")).select("column", "category")


_REAL = "({c} IS NOT NULL AND NOT " + PLACE + ")"


@query("tiered_duplicates", "D22 D23", f"""SELECT * EXCLUDE (a, b, d, e), CASE WHEN a THEN 'vendor_name' WHEN b THEN 'email' WHEN d THEN 'balance' ELSE 'note' END AS matched_fields FROM (SELECT *,
  {_REAL.replace('{c}', 'vendor_name')} AND count(*) OVER (PARTITION BY vendor_name) > 1 AS a, {_REAL.replace('{c}', 'email')} AND count(*) OVER (PARTITION BY email) > 1 AS b,
  balance IS NOT NULL AND count(*) OVER (PARTITION BY balance) > 1 AS d, {_REAL.replace('{c}', 'note')} AND count(*) OVER (PARTITION BY note) > 1 AS e FROM vendors) WHERE a OR b OR d OR e""")
def _(spark, sf):
    return D.tiered(table(spark, sf, "vendors"), "vendor_id", D.categorize(prof(spark, sf, "vendors")))


@query("repeated_values", "D22 D24", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS "value", count(*) AS "count" FROM vendors WHERE {_REAL.replace('{c}', c)} GROUP BY {c} HAVING count(*) > 1""" for c in ("vendor_name", "email", "status", "note")))
def _(spark, sf):
    return D.repeated_values(table(spark, sf, "vendors"), ["vendor_name", "email", "status", "note"])


@query("similar_values", "D24", ratio_groups("SELECT 0 AS block, s_suppkey AS row_id, s_name AS value FROM supplier QUALIFY count(*) OVER (PARTITION BY s_name) = 1", "fuzzy"))
def _(spark, sf):
    return Z.similar_values(table(spark, sf, "supplier"), "s_name", "s_suppkey").drop("key_columns")
