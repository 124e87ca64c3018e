"""Source and sink queries (S01-S23): whole tables written, read back and summed up.

Files go to the cluster's shared scratch folder (next to spark.checkpoint.dir) where one is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from plumbline.operators import apply as A
from plumbline.operators.compare import baseline
from plumbline.operators.fuzzy import checkpoint
from plumbline.operators.profile import profile
from plumbline.plans import query
from plumbline.plans.inputs import table
from plumbline.sources import files, stores


def scratch(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/plumbline-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="plumbline-")


SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
SCHEMA = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
DOCUMENTS = "SELECT doc_id, text FROM documents"


@query("csv_round_trip", "S01 S02 S16", SUPPLIER)
def _(spark, sf):
    path = scratch(spark) + "/supplier.csv"
    files.write(table(spark, sf, "supplier"), path, "csv", compression="gzip")
    return files.read(spark, path, schema=SCHEMA)


@query("csv_inferred", "S02 S08", "SELECT count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_extendedprice), 2) AS price FROM lineitem")
def _(spark, sf):
    path = scratch(spark) + "/lineitem.csv"
    files.write(table(spark, sf, "lineitem"), path, "csv", delimiter=",")
    return files.read(spark, path, lines_are_rows=True).agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").cast("bigint").alias("keys"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("csv_texts", "S02 S16", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text || '"' || chr(10) || 'a "b", c' END AS text, lang FROM documents""")
def _(spark, sf):
    path = scratch(spark) + "/documents.csv"
    rows = table(spark, sf, "documents").selectExpr("doc_id", """CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text || '"' || chr(10) || 'a "b", c' END AS text""", "lang")
    files.write(rows, path, "csv")
    return files.read(spark, path, schema="doc_id bigint, text string, lang string")


@query("header_row_files", "S10", SUPPLIER)
def _(spark, sf):
    path = scratch(spark) + "/suppliers"
    lines = table(spark, sf, "supplier").select(F.pmod("s_suppkey", F.lit(3)).alias("part"), F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").alias("line"), F.col("s_suppkey").alias("at"))
    top = spark.range(3).select(F.col("id").alias("part"), F.posexplode(F.array(F.lit("made by hand,,,"), F.lit("s_suppkey,s_name,s_nationkey,s_acctbal"))).alias("at", "line"))
    both = top.select("part", (F.col("at") - 10).cast("bigint").alias("at"), "line").unionByName(lines)
    both.repartition(3, "part").sortWithinPartitions("part", "at").select("part", "line").write.partitionBy("part").text(path)
    return files.read(spark, path + "/part=*", "csv", header_row=1, schema=SCHEMA)


@query("metadata_rows", "S11", "SELECT p AS part, r AS row, CASE r WHEN 0 THEN 'made by \"hand\", or not' ELSE 'part' END AS first, CASE r WHEN 0 THEN (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = p) ELSE p END AS second FROM range(0, 3) a(p), range(0, 2) b(r)")
def _(spark, sf):
    path = scratch(spark) + "/reports"
    rows = table(spark, sf, "supplier").select(F.pmod("s_suppkey", F.lit(3)).alias("part"), F.concat_ws(",", "s_suppkey", "s_name").alias("line"), F.col("s_suppkey").alias("at"))
    head = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.inline(F.array(
        F.struct(F.lit(-3).cast("long").alias("at"), F.concat(F.lit('"made by ""hand"", or not",'), F.col("n")).alias("line")),
        F.struct(F.lit(-2).cast("long").alias("at"), F.concat(F.lit("part,"), F.col("part")).alias("line")),
        F.struct(F.lit(-1).cast("long").alias("at"), F.lit("s_suppkey,s_name").alias("line")))))
    head.unionByName(rows).repartition(3, "part").sortWithinPartitions("part", "at").select("part", "line").write.partitionBy("part").text(path)
    found = files.metadata_rows(spark, path + "/part=*", 2)
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return found.select(part.alias("part"), "row", F.col("fields")[0].alias("first"), F.col("fields")[1].cast("long").alias("second"))


@query("feather_files", "S07", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    path = scratch(spark) + "/feather"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").repartition(3, "o_orderkey")
    kind = "o_orderkey bigint, o_totalprice double, o_orderpriority string"
    spark.createDataFrame([], "x int").write.parquet(path)  # makes the shared folder
    files.write_feather(orders, path, 500).collect()
    return files.read(spark, path, "feather", schema=kind)


@query("csv_quoted_blocks", "S02 S03 S08", """SELECT doc_id, md5(coalesce(text, '') || chr(10) || '"x", y') AS digest FROM documents""")
def _(spark, sf):
    path = scratch(spark) + "/wide.csv"
    rows = table(spark, sf, "documents").selectExpr("doc_id", """coalesce(text, '') || chr(10) || '"x", y' AS text""")
    files.write(rows, path, "csv")
    size, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # several blocks in a file
        spark.conf.set(size, "256k")
        out = files.read(spark, path, schema="doc_id bigint, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
        return checkpoint(out)
    finally:
        spark.conf.set(size, before)


@query("tsv_round_trip", "S03 S16", SUPPLIER)
def _(spark, sf):
    path = scratch(spark) + "/supplier.tsv"
    files.write(table(spark, sf, "supplier"), path, "csv", delimiter="\t", compression="bz2")
    return files.read(spark, path, schema=SCHEMA)


@query("jsonl_round_trip", "S05 S18", DOCUMENTS)
def _(spark, sf):
    path = scratch(spark) + "/documents.jsonl"
    files.write(table(spark, sf, "documents"), path, "json", columns=["doc_id", "text"])
    return files.read(spark, path, schema="doc_id bigint, text string")


@query("json_document", "S04", SUPPLIER)
def _(spark, sf):
    path = scratch(spark) + "/supplier.json"
    # One JSON array per nation: a document need not be one line, and none grows with the whole table.
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))).alias("value"))
    rows.write.partitionBy("s_nationkey").text(path)
    return files.read(spark, path, schema=SCHEMA)


@query("parquet_round_trip", "S06 S17", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    path = scratch(spark) + "/orders.parquet"
    files.write(table(spark, sf, "orders"), path, columns=["o_orderkey", "o_totalprice"])
    return files.read(spark, path)


@query("parquet_preview", "S06 S09", "SELECT count(*) AS rows FROM (SELECT 1 FROM orders LIMIT 1000)")
def _(spark, sf):
    return files.preview(spark, f"{sf.rstrip('/')}/orders.parquet").agg(F.count(F.lit(1)).alias("rows"))


@query("batch_export", "S19", """WITH n AS (SELECT count(*) AS n FROM orders)
  SELECT (1000 * i + 1) || '-' || least(1000 * (i + 1), n) AS rows, CAST(least(1000, n - 1000 * i) AS BIGINT) AS count, CAST(1 AS BIGINT) AS files, k AS first_key
  FROM n, range(0, 100000) t(i) JOIN (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM orders) o ON o.at = 1000 * i WHERE 1000 * i < n""")
def _(spark, sf):
    path = scratch(spark) + "/batches.parquet"
    files.batch_export(table(spark, sf, "orders"), path, 1000, order_by=["o_orderkey"])
    back = spark.read.option("recursiveFileLookup", "true").parquet(path).select("o_orderkey", F.input_file_name().alias("f"))
    name = F.regexp_extract("f", r"rows=([0-9-]+)", 1)
    return back.groupBy(name.alias("rows")).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("f").alias("files"), F.min("o_orderkey").alias("first_key"))


@query("rejects_export", "S20", "SELECT rejection_reason, count(*) AS rows FROM (SELECT 'Source - Does not match' AS rejection_reason FROM messy WHERE label IS NULL OR NOT regexp_matches(label, '^src')) GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark) + "/rejects.parquet"
    rule = {"name": "Source", "mode": "Validate", "pattern": "src"}
    files.write(A.apply_rules(table(spark, sf, "messy"), {"label": [rule]})[1], path)
    return files.read(spark, path).groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("rows"))


@query("rule_sets", "S21 S22", "SELECT doc_id, upper(label) AS label FROM messy WHERE label IS NOT NULL AND length(label) <= 50")
def _(spark, sf):
    path = scratch(spark) + "/rule_sets"
    config = {"label": {"enabled": True, "applied_rules": [{"name": "Upper", "mode": "Case", "case": "UPPERCASE"}, {"name": "Fits", "mode": "Length", "length_mode": "Maximum", "max_length": 50}]}, "gone": {"enabled": True}}
    df = table(spark, sf, "messy").select("doc_id", "label")
    stores.save_rule_set(spark, path, "labels", A.import_config(A.export_config(config), df.columns))
    return A.apply_rules(df, A.enabled_rules(stores.load_rule_set(spark, path, "labels")))[0]


@query("saved_baseline", "C08", """SELECT 'c_acctbal' AS "column", round(avg(c_acctbal), 4) AS mean, count(*) AS row_count FROM customer UNION ALL SELECT 'c_custkey', round(avg(c_custkey), 4), count(*) FROM customer""")
def _(spark, sf):
    path = scratch(spark) + "/baselines"
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    stores.save_baseline(baseline(df, profile(df, samples=False)), path, "first")
    return stores.load_baseline(spark, path, "first").select("column", F.round("mean", 4).alias("mean"), "row_count")
