"""What several operators of this subpackage use: checkpoints, literal tables, row hashes, fair samples."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Letters only, of which `^` negates; the two word patterns of the contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files.

    The folder is spark.checkpoint.dir. Where that is unset, as in tests, a temporary folder is set,
    but only for a local master: on a cluster the executors would not see it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, but by a Parquet table: compressed by column, read again column by column, and of a size that the
    planner knows, so that it may broadcast what is under its threshold."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        shared = spark.sparkContext.getCheckpointDir()
    path = f"{shared.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch of whole texts, at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most BATCH_ROWS rows: a larger setting of the session is lowered, as a
    batch of 10,000 long texts would fill the memory of an executor twice over (once on each side)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small plan table as one JSON literal: no Python or RDD behind it."""
    text = json.dumps(rows, ensure_ascii=True)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def text_of(column: str = "doc_id") -> Column:
    """An id as text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo modulus."""
    return F.crc32(text_of(column).cast("binary")) % modulus


def fraction(digest: str) -> Column:
    """A number in (0, 1) from a 64-bit digest."""
    return (F.pmod(F.xxhash64(digest), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def fair_draw(counted: DataFrame, digest: str, n: str, most: int) -> dict[int, int]:
    """How often each text of `counted` (one row per digest, n > 0 copies) comes in a sample of `most` copies,
    or of all if they are no more. A text comes as often as the whole part of its share says; the copies that
    are left go to the texts whose hash is smallest relative to the rest of their share. So the sample has
    `most` copies exactly, however many copies a text has, and depends on no partitioning."""
    rows = counted.filter(F.col(n) > 0).select(F.col(digest).alias("h"), F.col(n).cast("long").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    if total <= most:
        return {r["h"]: r["n"] for r in rows.collect()}
    parts = rows.selectExpr("h", f"n * {most}L DIV {total}L AS whole", f"n * {most}L % {total}L AS rest")
    out = {r["h"]: r["whole"] for r in parts.filter("whole > 0").select("h", "whole").collect()}
    left = most - sum(out.values())
    for r in parts.filter("rest > 0").orderBy(fraction("h") / F.col("rest"), "h").limit(left).select("h").collect():
        out[r["h"]] = out.get(r["h"], 0) + 1
    return out


def drawn(rows: DataFrame, digest: str, draws) -> DataFrame:
    """One row of each digest that was drawn. The digests are a filter, so that it sinks below joins."""
    listed = ",".join(str(int(d)) + "L" for d in sorted(draws)) or "NULL"
    return rows.filter(F.expr(f"{digest} IN ({listed})")).dropDuplicates([digest])


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add under the same names (in any case)."""
    return df.drop(*[c for c in df.columns if c.lower() in names])
