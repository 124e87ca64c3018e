"""Named baselines and rule sets, kept as Parquet folders partitioned by name."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def _save(df: DataFrame, path: str, key: str) -> None:
    # Only the partitions present in `df` are replaced.
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def _delete(spark: SparkSession, path: str, key: str, name: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"{key}={name}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(folder) and files.delete(folder, True))


def save_baseline(baseline: DataFrame, path: str, name: str, created_at: dt.datetime | None = None) -> None:
    """Keep a baseline under a name, replacing an earlier one."""
    stamp = (created_at or dt.datetime.now()).isoformat()
    _save(baseline.withColumns({"baseline": F.lit(name), "created_at": F.lit(stamp)}), path, "baseline")


def load_baseline(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("baseline") == name).drop("baseline", "created_at")


def list_baselines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(F.col("baseline").alias("name")).agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"))


def delete_baseline(spark: SparkSession, path: str, name: str) -> bool:
    return _delete(spark, path, "baseline", name)


def save_rule_set(spark: SparkSession, path: str, name: str, rules: dict, description: str = "", at: dt.datetime | None = None) -> None:
    """Keep a rule configuration under a name, replacing an earlier one."""
    stamp = (at or dt.datetime.now()).isoformat()
    row = [(name, description, json.dumps(rules, default=str), stamp)]
    _save(spark.createDataFrame(row, "rule_set string, description string, rules_json string, updated_at string"), path, "rule_set")


def load_rule_set(spark: SparkSession, path: str, name: str) -> dict | None:
    row = spark.read.parquet(path).filter(F.col("rule_set") == name).select("rules_json").first()
    return json.loads(row["rules_json"]) if row else None


def list_rule_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("rule_set").alias("name"), "description", "updated_at").orderBy(F.desc("updated_at"))


def delete_rule_set(spark: SparkSession, path: str, name: str) -> bool:
    return _delete(spark, path, "rule_set", name)
