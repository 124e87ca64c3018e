"""Exact duplicates: groups, removal, resolution, tiers, and match-rule suggestions.

Rows are identified by a key column the caller names (``rid``). Groups are found by aggregation
with map-side combine, never by collecting a group into one task. A group's id is its smallest row
id: unique, and stable without numbering groups globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import dtypes, text
from plumbline.operators.profile import cells
from plumbline.operators.quality import any_value, row_keys
from plumbline.operators.quantiles import col

# Words in column names that tell their role in a table.
IDENTIFIER_WORDS = ["id", "key", "uuid", "guid", "serial", "sequence"]
BUSINESS_WORDS = [
    "name", "number", "email", "phone", "mobile", "tax", "pan", "gstin", "account", "code", "vendor", "supplier",
    "customer",
]
METADATA_WORDS = ["batch", "import", "action", "status", "created", "updated", "modified", "date", "time", "user"]

# Words that mark a name or description column.
NAME_WORDS = ["name", "desc", "title", "product", "customer", "company", "vendor", "supplier", "brand", "item"]


def exact_groups(df: DataFrame, rid: str, subset: list[str] | None = None) -> DataFrame:
    """(group_id, row_id, match_type, similarity, key_columns, representative) of equal rows.

    NULLs equal each other, but rows with no value at all in the subset are left out.
    """
    subset = [c for c in df.columns if c != rid] if subset is None else subset
    names = [f"k{i}" for i in range(len(subset))]
    rows = df.filter(any_value(df, subset)).select(
        col(rid).alias("row_id"), F.to_json(F.struct(*[col(c) for c in subset])).alias("representative"), *row_keys(df, subset)
    )
    groups = (
        rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("group_id")).filter("n > 1")
        .select("group_id", *[F.col(n).alias("g" + n) for n in names])
    )
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col("g" + n))
    return rows.join(groups, same).select(
        "group_id", "row_id", F.lit("exact").alias("match_type"), F.lit(100.0).alias("similarity"),
        F.array(*[F.lit(c) for c in subset]).alias("key_columns"), "representative",
    )


def group_sizes(df: DataFrame, subset: list[str]) -> DataFrame:
    """Key values and size of every group of equal rows; cheaper than listing the members."""
    keys = [col(c) for c in subset]
    present = F.coalesce(*[k.cast("string") for k in keys]).isNotNull()
    return df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str = "first", order_by: str | None = None) -> DataFrame:
    """One row per key: the first or last in the given order, or none of a repeated key.

    The surviving row travels as a struct through a partial aggregate, so a key that holds a third
    of all rows still shrinks before the shuffle.
    """
    if keep not in ("first", "last", "none"):
        raise ValueError(f"keep must be first, last or none, not {keep!r}")
    if subset is None and keep != "none":
        if order_by is None:
            return df.dropDuplicates()
        subset = [c for c in df.columns if c != order_by]
    subset = subset or df.columns
    keys = row_keys(df, subset)
    row = F.struct(*[col(c) for c in df.columns])
    order = col(order_by) if order_by else F.lit(0)
    chosen = F.max_by(row, order) if keep == "last" else F.min_by(row, order)
    out = df.groupBy(*keys).agg(chosen.alias("row"), F.count(F.lit(1)).alias("n"))
    if keep == "none":
        out = out.filter("n = 1")
    return out.select("row.*")


def resolve(
    df: DataFrame, rid: str, groups: DataFrame, strategy: str = "keep_first", positions: list[int] | None = None,
    group_ids: DataFrame | None = None,
) -> DataFrame:
    """The table with duplicate groups resolved.

    ``strategy``: keep_first, keep_last, keep_selected / keep_multiple (``positions`` inside each
    group, from 0; an impossible choice keeps the first), or merge (the first row, its gaps filled
    from later rows). ``group_ids`` restricts the work to some groups.
    """
    members = groups.select("group_id", "row_id").distinct()
    if group_ids is not None:
        members = members.join(group_ids.select("group_id").distinct(), "group_id", "left_semi")
    if strategy == "merge":
        return _merge(df, rid, members)
    if strategy in ("keep_selected", "keep_multiple"):
        dropped = _unselected(members, positions or [])
    else:
        pick = F.max("row_id") if strategy == "keep_last" else F.min("row_id")
        kept = members.groupBy("group_id").agg(pick.alias("row_id"))
        dropped = members.join(kept, ["group_id", "row_id"], "left_anti")
    return df.join(dropped.select(F.col("row_id").alias(rid)), rid, "left_anti").select(df.columns)


def _unselected(members: DataFrame, positions: list[int]) -> DataFrame:
    wanted = sorted({p for p in positions if p >= 0})
    deepest = max(wanted, default=0)
    # Only the first few rows of a group can be selected, so the window keeps no more than those.
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy("row_id")) - 1).filter(
        F.col("r") <= deepest
    )
    ranked = ranked.withColumn("hit", F.col("r").isin(wanted) if wanted else F.lit(False))
    valid = ranked.filter("hit").select("group_id").distinct().withColumn("valid", F.lit(True))
    kept = (
        ranked.join(valid, "group_id", "left")
        .filter(F.when(F.col("valid"), F.col("hit")).otherwise(F.col("r") == 0)).select("group_id", "row_id")
    )
    return members.join(kept, ["group_id", "row_id"], "left_anti")


def _merge(df: DataFrame, rid: str, members: DataFrame) -> DataFrame:
    rows = df.join(members.withColumnRenamed("row_id", rid), rid, "left")
    alone = rows.filter(F.col("group_id").isNull()).select(df.columns)
    filled = (
        rows.filter(F.col("group_id").isNotNull()).groupBy("group_id")
        .agg(
            F.min(col(rid)).alias(rid),
            *[F.min_by(F.when(col(c).isNotNull(), F.struct(col(c).alias("v"))), F.when(col(c).isNotNull(), col(rid)))["v"].alias(c)
              for c in df.columns if c != rid],
        )
        .select(df.columns)
    )
    return alone.unionByName(filled)


def group_summary(groups: DataFrame) -> DataFrame:
    """Rows, similarity, type, keys and a 50-character preview per group."""
    preview = F.min("representative")
    return groups.groupBy("group_id", "match_type", "key_columns").agg(
        F.count(F.lit(1)).alias("rows"), F.max("similarity").alias("similarity"),
        F.when(F.length(preview) > 50, F.concat(F.substring(preview, 1, 50), F.lit("..."))).otherwise(preview).alias("preview"),
    )


def group_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("rows"))


# --- column roles and tiers -----------------------------------------------------------------


def _has_word(words: list[str]) -> Column:
    return F.lower("column").rlike("|".join(words))


def categorize(profile: DataFrame) -> DataFrame:
    """(column, category): unique_identifiers, critical_business, metadata or descriptive."""
    category = (
        F.when(_has_word(IDENTIFIER_WORDS) & (F.col("unique_percentage") > 95), "unique_identifiers")
        .when(_has_word(BUSINESS_WORDS), "critical_business")
        .when(_has_word(METADATA_WORDS), "metadata").otherwise("descriptive")
    )
    return profile.select("position", "column", category.alias("category"))


def tiered(df: DataFrame, rid: str, categories: DataFrame, max_descriptive: int | None = None) -> DataFrame:
    """Rows that share a real value with another row, at the first column where they do.

    Important columns are the business ones, then the descriptive ones (the first ``max_descriptive``, if given). A row repeated
    on several columns together is also repeated on the first of them alone, so the tiers for
    pairs, triples and all business columns can never add a row to the single-column tier; only
    when there is no important column does the complete-row tier decide.
    """
    roles = categories.orderBy("position").collect()
    business = [r["column"] for r in roles if r["category"] == "critical_business"]
    important = business + [r["column"] for r in roles if r["category"] == "descriptive"][:max_descriptive]
    compared = [r["column"] for r in roles if r["category"] != "unique_identifiers"] or [r["column"] for r in roles]
    if not important:
        return _complete_tier(df, rid, compared)
    keyed = df.select(
        col(rid).alias("row_id"),
        F.inline(
            F.array(*[
                F.struct(F.lit(i).alias("tier"), text.compact_key(col(c).cast("string")).alias("v"), text.is_placeholder(col(c)).alias("hollow"))
                for i, c in enumerate(important)
            ])
        ),
    ).filter(~F.col("hollow")).drop("hollow")
    repeated = keyed.groupBy("tier", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = keyed.join(repeated, ["tier", "v"], "left_semi").groupBy("row_id").agg(F.min("tier").alias("tier"))
    labels = F.element_at(F.array(*[F.lit(c) for c in important]), F.col("tier") + 1)
    return df.join(first.withColumnRenamed("row_id", rid), rid).select(labels.alias("matched_fields"), *[col(c) for c in df.columns])


def _complete_tier(df: DataFrame, rid: str, compared: list[str]) -> DataFrame:
    real = F.lit(True)
    for c in compared:
        real = real & ~text.is_placeholder(col(c))
    groups = exact_groups(df.filter(real), rid, compared).select(F.col("row_id").alias(rid))
    return df.join(groups, rid, "left_semi").select(F.lit("All fields").alias("matched_fields"), *[col(c) for c in df.columns])


def repeated_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) of text values that occur more than once, placeholders aside (D24, exact part)."""
    columns = dtypes.text_columns(df) if columns is None else columns
    return (
        cells(df, columns).groupBy("column", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("count"))
        .filter((F.col("count") > 1) & ~text.is_placeholder(F.col("value")))
    )


# --- match-rule suggestions -----------------------------------------------------------------


def exact_candidates(profile: DataFrame) -> DataFrame:
    """Columns worth matching exactly, with score and reasons."""
    u, n, d = F.col("unique_percentage"), F.col("null_percentage"), F.col("duplicate_percentage")
    fixed = (F.col("family") == "Text") & (F.col("max_length") == F.col("min_length")) & F.col("avg_length").between(4, 20)
    near, high, low = u.between(95, 100) & (u < 100), (u >= 80) & (u < 95), (d > 0) & (d < 5)
    score = (
        F.when(near, 35).when(high, 25).otherwise(0) + F.when(n < 1, 20).when(n < 5, 15).otherwise(0)
        + F.when(fixed, 25).otherwise(0) + F.when(low, 15).otherwise(0)
    )
    reasons = F.array_compact(F.array(
        F.when(near, _reason("Near-unique (", u, 1, "%)")).when(high, _reason("High uniqueness (", u, 1, "%)")),
        F.when(n < 1, "Complete data (no nulls)").when(n < 5, "Low null rate"),
        F.when(fixed, F.concat(F.lit("Fixed length ("), F.floor("avg_length").cast("string"), F.lit(" chars)"))),
        F.when(low, _reason("Low duplicates (", d, 1, "%)")),
    ))
    return profile.filter((u < 100) & (F.col("duplicate_count") > 0)).select(
        "position", "column", score.alias("score"), reasons.alias("reasons"), "duplicate_count"
    ).filter("score >= 50")


def fuzzy_candidates(profile: DataFrame) -> DataFrame:
    """Text columns worth matching by similarity, with score and reasons."""
    u, length = F.col("unique_percentage"), F.col("avg_length")
    medium, low_medium = u.between(30, 90), (u >= 10) & (u < 30)
    name_like, repeats = F.lower("column").rlike("|".join(NAME_WORDS)), F.col("duplicate_count") > 1
    score = (
        F.when(medium, 35).when(low_medium, 20).otherwise(0)
        + F.when(length.between(10, 100), 25).when(length > 100, 15).otherwise(0)
        + F.when(name_like, 25).otherwise(0) + F.when(repeats, 15).otherwise(0)
    )
    reasons = F.array_compact(F.array(
        F.when(medium, _reason("Medium uniqueness (", u, 1, "%)")).when(low_medium, _reason("Low-medium uniqueness (", u, 1, "%)")),
        F.when(length.between(10, 100), _reason("Name/description length (", length, 0, " chars)")).when(length > 100, "Long text field"),
        F.when(name_like, "Name/description column"),
        F.when(repeats, F.concat(F.lit("Has duplicates to match ("), F.col("duplicate_count").cast("string"), F.lit(")"))),
    ))
    return profile.filter(F.col("family") == "Text").select(
        "position", "column", score.alias("score"), reasons.alias("reasons")
    ).filter("score >= 45")


def _reason(before: str, value: Column, decimals: int, after: str) -> Column:
    return F.concat(F.lit(before), F.format_string(f"%.{decimals}f", F.bround(value, decimals)), F.lit(after))


def suggest_match_rules(profile: DataFrame) -> DataFrame:
    """At most ten matching rules: exact, fuzzy, and both combined.

    The profile has one row per column and at most four candidates of each kind are kept, so the
    un-partitioned windows below only ever see a handful of rows.
    """
    best = Window.orderBy(F.desc("score"), "position")
    exact = exact_candidates(profile).orderBy(F.desc("score"), "position").limit(4).withColumn("r", F.row_number().over(best))
    fuzzy = fuzzy_candidates(profile).orderBy(F.desc("score"), "position").limit(4).withColumn("r", F.row_number().over(best))
    s = F.col("score")
    shown = lambda n: F.array_join(F.slice("reasons", 1, n), "; ")
    exact_rules = exact.select(
        F.lit(0).alias("kind"), "r", F.lit("Exact").alias("rule_type"), F.col("column").alias("columns"),
        F.when(s >= 85, "Strongest").when(s >= 75, "Very Strong").when(s >= 65, "Strong").otherwise("Good").alias("match_probability"),
        F.concat(shown(2), F.lit(" | Duplicates: "), F.col("duplicate_count").cast("string")).alias("rationale"),
        s.cast("double").alias("confidence"),
    )
    fuzzy_rules = fuzzy.select(
        F.lit(1).alias("kind"), "r", F.lit("Fuzzy").alias("rule_type"), F.col("column").alias("columns"),
        F.when(s >= 70, "Strong").when(s >= 60, "Good").otherwise("Medium").alias("match_probability"),
        shown(3).alias("rationale"), s.cast("double").alias("confidence"),
    )
    e = exact.filter("r <= 2").select(F.col("column").alias("e"), F.col("score").alias("es"), F.col("r").alias("er"))
    f = fuzzy.filter("r <= 3").select(F.col("column").alias("f"), F.col("score").alias("fs"), F.col("r").alias("fr"))
    mean = (F.col("es") + F.col("fs")) / 2.0
    # At most 2 x 3 rows.
    combined = e.join(F.broadcast(f), F.col("e") != F.col("f")).select(
        F.lit(2).alias("kind"), (F.col("er") * 10 + F.col("fr")).alias("r"), F.lit("Combined").alias("rule_type"),
        F.concat("e", F.lit(" (Exact) + "), "f", F.lit(" (Fuzzy)")).alias("columns"),
        F.when(mean >= 75, "Enterprise").when(mean >= 65, "Strong").otherwise("Good").alias("match_probability"),
        F.concat(F.lit("Exact on "), "e", F.lit("; Fuzzy match on "), "f").alias("rationale"), mean.alias("confidence"),
    )
    rules = exact_rules.unionByName(fuzzy_rules).unionByName(combined).orderBy("kind", "r").limit(10)
    fallback = profile.filter("position = 0").select(
        F.lit(9).alias("kind"), F.lit(0).alias("r"), F.lit("Exact").alias("rule_type"), F.col("column").alias("columns"),
        F.lit("Medium").alias("match_probability"), F.lit("Default fallback rule").alias("rationale"), F.lit(50.0).alias("confidence"),
    )
    everything = rules.unionByName(fallback).withColumn("others", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    kept = everything.filter((F.col("kind") < 9) | (F.col("others") == 1))
    number = F.row_number().over(Window.orderBy(F.desc("confidence"), "kind", "r"))
    return kept.select(
        F.format_string("R%02d", number).alias("rule_no"), "rule_type", "columns", "match_probability", "rationale", "confidence"
    )

