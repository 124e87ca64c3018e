"""Queries of this subpackage: name -> function (spark, sf_dir), and SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality", "language", "mixing", "licences", "decontaminate", "ngram_join", "hamming", "sharding", "context_mixing", "toxicity", "merkle", "chat", "whitening"]

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def load() -> tuple[dict, dict]:
    for m in MODULES:
        import_module(f"plumbline.llm.{m}")
    return QUERIES, SQL
