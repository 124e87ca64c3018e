"""Exact top-k search (7): incremental multi-index hashing of binary codes.

A vector's code has a bit per dimension (1 where it is above 0), cut into segments of 16 bits. A shard of
codes has one table per segment, from segment value to codes. For a query, the radius of one segment after
the other grows by one: after radius s in segments 0..j (s - 1 in the others), every code within distance
m s + j has been met, as one further away in every segment would be further in all. A query ends when k
verified codes lie within that bound; so its result is exact, ties by id. A code is verified in the step that
meets it first, so none counts twice.

Queries and codes are dealt in blocks, a task per pair of blocks (`query_rows` x `code_rows`): the stated
query set against all rows. A query's best k of each block of codes are merged by Spark.

Edge cases: a row with null id, null or empty vector, or of another length than most rows' has no code and is
neither query nor answer; null and NaN elements are 0 bits; a query never meets rows with its own id; equal
codes are all met, in id order; fewer than k other rows give fewer than k answers; an empty table gives an
empty result. Repeated rows (same id and code) count once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.registry import query, table

K = 10
SEGMENT = 16
CODE_ROWS = 1 << 17
QUERY_ROWS = 1 << 12
#: Candidates verified at a time.
STEP = 1 << 22


def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with `radius` ones."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], np.int64)


class Tables:
    """A segment's codes in order of value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(self.m)]
        self.begin = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << SEGMENT))]) for j in range(self.m)]

    def meet(self, queries: np.ndarray, segment: int, radius: int):
        """(query number, code number, distance) of the codes first met at this step, in parts."""
        flips = masks(SEGMENT, radius)
        per = max(1, STEP // max(1, len(flips) * (1 + len(self.codes) >> SEGMENT)))
        for lo in range(0, len(queries), per):
            value = (queries[lo : lo + per, segment].astype(np.int64)[:, None] ^ flips).reshape(-1)
            a, b = self.begin[segment][value], self.begin[segment][value + 1]
            used = np.flatnonzero(b > a)
            n = (b - a)[used]
            for part in np.split(np.arange(len(used)), np.flatnonzero(np.diff(np.cumsum(n) // STEP)) + 1):
                if not len(part):
                    continue
                c = n[part]
                who = np.repeat(lo + used[part] // len(flips), c)
                code = self.order[segment][np.repeat(a[used[part]] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())]
                apart = np.bitwise_count(self.codes[code] ^ queries[who]).astype(np.int16)
                first = (apart[:, :segment] > radius).all(1) & (apart[:, segment + 1 :] >= radius).all(1)
                yield who[first], code[first], apart[first].sum(1)


def search(codes: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance): the k nearest of each query, ties by id."""
    tables, m = Tables(codes), codes.shape[1]
    open_, best, out = np.arange(len(queries)), [np.zeros(0, np.int64)] * 3, []
    for radius in range(SEGMENT + 1):
        for j in range(m):
            if not len(open_):
                break
            met = [best] + [[open_[w], ids[c], d] for w, c, d in tables.meet(queries[open_], j, radius)]
            q, i, d = (np.concatenate([x[t] for x in met]) for t in range(3))
            other = i != own[q]
            q, i, d = q[other], i[other], d[other]
            turn = np.lexsort((i, d, q))
            q, i, d = q[turn], i[turn], d[turn]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            best = [x[rank < k] for x in (q, i, d)]
            covered = np.bincount(best[0][best[2] <= m * radius + j], minlength=len(queries)) >= k
            done = covered[best[0]]
            out.append([x[done] for x in best])
            best = [x[~done] for x in best]
            open_ = open_[~covered[open_]]
    out.append(best)
    return tuple(np.concatenate([x[t] for x in out]) for t in range(3))


def encoded(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and code, an array of 16-bit numbers, of every row that has one."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and size(v) > 0")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = usual[0] if usual else 1
    bit = lambda i: F.when((F.col("v")[i] > 0) & ~F.isnan(F.col("v")[i]), 1 << (i % SEGMENT)).otherwise(0)
    parts = [sum((bit(i) for i in range(s + 1, min(size, s + SEGMENT))), bit(s)) for s in range(0, size, SEGMENT)]
    return rows.filter(F.size("v") == size).select("id", F.array(*parts).alias("code"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, code_rows: int = CODE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance for every row of queries (a part of vectors' rows)."""
    codes = encoded(vectors, key, vector).distinct()
    asked = encoded(queries, key, vector).distinct()
    n, n_asked = codes.count(), asked.count()
    shards, blocks = max(2, -(-n // code_rows)), max(6, -(-n_asked // query_rows))
    left = codes.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "code")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("qs"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("qb"), "id", "code")

    def one(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "distance": pa.array([], pa.int32())})
        unpack = lambda t: (t.column("id").to_numpy(), np.array(t.column("code").to_pylist(), np.uint16))
        (ids, c), (own, q) = unpack(mine), unpack(theirs)
        who, i, d = search(c, ids, q, own, k)
        return pa.table({"query_id": own[who], "neighbor_id": i, "distance": d.astype(np.int32)})

    found = left.groupBy("s", "b").cogroup(right.groupBy("qs", "qb")).applyInArrow(one, "query_id long, neighbor_id long, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


SQL = f"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) AS INT) AS distance FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank, neighbor_id, distance FROM d QUALIFY rank <= {K}"""


@query("op7_multi_index_hashing", SQL)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
