"""Headline queries, timed on a warm session. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def workloads(spark):
    from plumbline.operators import apply, clean, compare, duplicates, fuzzy, profile, quality, quantiles, validate
    from plumbline.plans.inputs import table
    from plumbline.plans.rules import RULES, STEPS, rule_list

    t = lambda name: table(spark, SF, name)
    part_ids = lambda groups: groups.agg(F.count(F.lit(1)), F.count_distinct("group_id"))
    return {
        "full_profile_lineitem": lambda: profile.profile(t("lineitem")),
        "fast_profile_lineitem": lambda: profile.profile(t("lineitem"), fast=True, samples=False),
        "full_profile_documents": lambda: profile.profile(t("documents")),
        "quality_report_lineitem": lambda: quality.report(t("lineitem")),
        "exact_groups_lineitem": lambda: part_ids(duplicates.exact_groups(
            t("lineitem").withColumn("rid", F.expr("l_orderkey * 100000000L + l_partkey * 10000L + l_suppkey * 10L + l_linenumber")), "rid", ["l_partkey", "l_suppkey", "l_quantity"])),
        "tiered_duplicates_orders": lambda: duplicates.tiered(t("orders"), "o_orderkey", duplicates.categorize(profile.profile(t("orders"), samples=False))).agg(F.count(F.lit(1))),
        "pearson_lineitem": lambda: quantiles.correlation(t("lineitem")),
        "spearman_lineitem": lambda: quantiles.correlation(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "spearman"),
        "validate_documents": lambda: validate.validate(t("messy"), rule_list(RULES)),
        "apply_rules_documents": lambda: apply.apply_rules(t("messy"), STEPS)[0].agg(F.count(F.lit(1)), F.sum(F.length("label"))),
        "fuzzy_groups_urls": lambda: part_ids(fuzzy.fuzzy_groups(t("pages"), "url", "page_id")),
        "combined_groups_part": lambda: part_ids(fuzzy.combined_groups(t("part"), ["p_brand"], ["p_name"], "p_partkey")),
        "auto_fix_customer": lambda: clean.auto_fix(t("gappy_customer")).agg(F.count(F.lit(1)), F.sum(F.length("segment"))),
        "cell_diff_customer": lambda: compare.modified_cells(t("customer"), t("changed_customer"), ["c_custkey"]),
        "drift_orders": lambda: compare.drift(*[compare.baseline(t("orders"), profile.profile(t("orders"), samples=False))] * 2),
        "numeric_summary_lineitem": lambda: quantiles.numeric_summary(t("lineitem")),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    only = set(sys.argv[1:])
    seconds = {}
    for name, make in workloads(spark).items():
        if only and name not in only:
            continue
        best = None
        for _ in range(RUNS):
            start = time.time()
            make().collect()
            best = min(best or 1e9, time.time() - start)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
