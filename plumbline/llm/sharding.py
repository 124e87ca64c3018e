"""Sharding (8): a Feistel permutation of global row numbers gives each row its shard and slot.

Rows are numbered 0..N-1 by hash bucket and by key inside a bucket, so numbers need no global sort and
do not depend on how the files are split. A Feistel network over the smallest grid a x b >= N permutes
the numbers; a number that leaves [0, N) walks its cycle until it is inside. Position p belongs to shard
p mod S, slot p div S: shard sizes differ by one row at most and slots have no gaps. Anybody who knows
(N, seed) can compute the place of a row number without the data.

Edge cases: null text has no bytes and crc32 0; rows with equal keys and texts are interchangeable (whichever
of them comes first depends on the order in which the input is read, which must not change between two reads); very
long texts are only hashed; an
empty table gives an empty result; other columns pass through untouched, but for
`law`, `shard` and `slot`, which are replaced. The columns this module adds
while it works start with `__sh_`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut, replaced

SHARDS = 40
#: Rows are numbered inside hash buckets; each offset table has one row per bucket.
BUCKETS = 4096
ROUNDS = 4
#: Equal rows that are more than one in HOT of the table are numbered in PARTS parts.
HOT, PARTS = 256, 256


def number_rows(df: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Add `__sh_row`, a number from 0 to N-1 that depends on the rows alone; also return N.

    Rows are numbered inside the hash bucket of their key and text. Rows that are equal in both and make up more
    than a `HOT`th of the table are dealt to `PARTS` parts first; as they are interchangeable, it does not
    matter which of them comes first."""
    keyed = df.withColumn("__sh_h", F.xxhash64(F.col(key).cast("string"), F.col(text))).withColumn("__sh_b", F.pmod("__sh_h", F.lit(buckets)).cast("int"))
    sizes = cut(keyed.groupBy("__sh_b").agg(F.count(F.lit(1)).alias("__sh_n")))  # `buckets` rows at most
    n = sizes.agg(F.sum("__sh_n")).first()[0] or 0
    heavy = [r[0] for r in sizes.filter(F.col("__sh_n") * HOT > n).filter("__sh_n > 1").select("__sh_b").collect()]  # HOT rows at most
    hot = []
    if heavy:
        equal = keyed.filter(F.col("__sh_b").isin(heavy)).groupBy("__sh_h").agg(F.count(F.lit(1)).alias("__sh_n"))
        hot = [r[0] for r in equal.filter(F.col("__sh_n") * HOT > n).select("__sh_h").collect()]
    part = F.when(F.col("__sh_h").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int") + 1).otherwise(0) if hot else F.lit(0)
    same = F.when(F.col("__sh_h").isin(hot), F.col("__sh_h")).otherwise(0) if hot else F.lit(0).cast("long")
    keyed = keyed.withColumns({"__sh_p": part, "__sh_e": same})
    group = ["__sh_b", "__sh_e", "__sh_p"]
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("__sh_n"))
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)  # buckets + HOT * PARTS rows at most
    offsets = cut(counts.select(*group, F.coalesce(F.sum("__sh_n").over(before), F.lit(0)).alias("__sh_at")))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("__sh_h", key, text)) - 1
    numbered = keyed.join(F.broadcast(offsets), group).withColumn("__sh_row", F.col("__sh_at") + inside)
    return numbered.drop(*group, "__sh_h", "__sh_at"), n


def grid(n: int) -> tuple[int, int]:
    """Sides of the permuted grid: a * b >= n, with fewer than a cells to spare."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute_once(df: DataFrame, x: str, n: int, seed: int) -> DataFrame:
    """Replace x by its image under the Feistel permutation of [0, a*b)."""
    a, b = grid(n)
    df = df.withColumns({"__sh_l": F.floor(F.col(x) / b).cast("long"), "__sh_r": F.col(x) % b})
    for k in range(ROUNDS):
        df = df.withColumn("__sh_l", (F.col("__sh_l") + F.pmod(F.xxhash64(F.lit(seed * 64 + 2 * k), "__sh_r"), F.lit(a))) % a)
        df = df.withColumn("__sh_r", (F.col("__sh_r") + F.pmod(F.xxhash64(F.lit(seed * 64 + 2 * k + 1), "__sh_l"), F.lit(b))) % b)
    return df.withColumn(x, F.col("__sh_l") * b + F.col("__sh_r")).drop("__sh_l", "__sh_r")


def walks(spark, n: int, seed: int) -> int:
    """The longest walk outside [0, n). Only a cell outside that is no image of another one there is reached from
    inside, so its walk comes back; cycles that lie wholly outside are never entered. Fewer than sqrt(n) + 1 cells."""
    a, b = grid(n)
    if a * b == n:
        return 0
    beyond = spark.range(n, a * b, 1, 1).toDF("__sh_x")
    image = permute_once(beyond, "__sh_x", n, seed)
    out, steps = cut(beyond.join(image, "__sh_x", "left_anti")), 0
    while out.count():
        out = cut(permute_once(out, "__sh_x", n, seed).filter(F.col("__sh_x") >= n))
        steps += 1
    return steps


def permute(df: DataFrame, x: str, n: int, seed: int) -> DataFrame:
    """Replace x in [0, n) by its image under a permutation of [0, n)."""
    df = permute_once(df, x, n, seed)
    for _ in range(walks(df.sparkSession, n, seed)):
        df = permute_once(df.withColumn("__sh_in", F.col(x)), x, n, seed)
        df = df.withColumn(x, F.when(F.col("__sh_in") < n, F.col("__sh_in")).otherwise(F.col(x))).drop("__sh_in")
    return df


def shard(df: DataFrame, shards: int = SHARDS, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of df with `shard` (int), `slot` (long) and `law`, shuffled reproducibly over `shards` shards."""
    numbered, n = number_rows(replaced(df, "law", "shard", "slot"), key, text)
    placed = permute(numbered, "__sh_row", max(n, 1), seed)
    return placed.withColumns({"law": F.lit("rows"), "shard": (F.col("__sh_row") % shards).cast("int"), "slot": F.floor(F.col("__sh_row") / shards).cast("long")}).drop("__sh_row")


def measures(text: str = "text") -> dict[str, Column]:
    """Bytes of the text plus 16, and the crc32 of its UTF-8 bytes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return {"size": (F.octet_length(whole) + 16).cast("long"), "text_crc32": F.crc32(whole.cast("binary")).cast("long")}


@query("op8_feistel_sharding")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("text")).withColumns(measures())
    # the numbers of a text stand for it from here on: no text is shuffled
    narrow = docs.select("doc_id", "size", "text_crc32")
    return shard(narrow.withColumn("mark", F.concat_ws(":", "size", "text_crc32")), text="mark").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
