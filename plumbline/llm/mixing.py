"""Mixing sources to target weights (3): a multivariate-hypergeometric splitting tree over block quotas.

Each source is cut into hash blocks of about `block_words` words (at most `max_blocks` in all, plus one per
source). A source's documents are taken in a permuted order of its blocks until its target is reached: all of
them that fit, then once more, up to three times; where the next one does not fit, smaller ones go on in what is
left, so that a very long document costs no more than its place. Each copy of a block in the mix is a ticket. A binary tree over the output shards splits the vector of ticket counts by exact
multivariate-hypergeometric draws, so a leaf holds what drawing without replacement would give it; then
every source deals its permuted tickets to the shards in order, disjointly, and a shard is shuffled locally.

The plan (one row per source; ticket counts of sources by shards) passes through the driver as metadata.
Documents never do: they meet the plan in a broadcast join with the block table, whose size is bounded.

Edge cases: null text has no words and is taken 0 words; a null source is a source of its own, last in
order; rows that are equal in key and text are one unit and are taken alike; a text longer than its source's target is not taken; no words at all means all targets 0; an empty table gives an empty
result; other columns pass through. Working columns start with `__mx_`.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.shared import SPACE_WORD, cut, literal_rows

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_WORDS = 1 << 13
MAX_BLOCKS = 1 << 15
SHARD_WORDS = 1 << 22
#: A source has its words when it is as near to its target.
NEAR = 0.001
#: So many units of repeated rows at most are broadcast.
MOST_UNITS = 1 << 17


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the total by weight; a share stops at `most` times its size, and the others share the excess."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left, weight = total - sum(out[i] for i in range(len(sizes)) if i not in open_), sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in above or open_:
            out[i] = float(most * sizes[i]) if above else left * weights[i] / weight
        open_ -= above or open_
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` of good + bad: exact inversion, from the mode outwards."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    lg = math.lgamma
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    at = lambda k: math.exp(
        lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(draws - k + 1) - lg(bad - draws + k + 1) - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1)
    )
    u, down, up = rng.random(), mode - 1, mode + 1
    u -= at(mode)
    if u < 0:
        return mode
    while down >= lo or up <= hi:
        for k in [x for x in (down, up) if lo <= x <= hi]:
            u -= at(k)
            if u < 0:
                return k
        down, up = down - 1, up + 1
    return mode


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quotas of each shard: the tree halves the shards and draws the left half's tickets without replacement."""
    out, todo = [[0] * len(quotas)] * shards, [(0, shards, list(quotas))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        rng, mid, rest = random.Random(f"{seed} {lo} {hi}"), (lo + hi) // 2, sum(have)
        need, left = rest * (mid - lo) // (hi - lo), []
        for q in have:
            rest -= q
            left.append(hypergeometric(rng, q, rest, need))
            need -= left[-1]
        todo += [(lo, mid, left), (mid, hi, [a - b for a, b in zip(have, left)])]
    return out


STEPS = "array<struct<level:int,gap:bigint,whole:boolean,o:bigint,h:bigint>>"
PLAN = f"__mx_k string, __mx_source_size long, __mx_target double, __mx_blocks long, __mx_steps {STEPS}"


def copies(size, most: int) -> Column:
    """Copies that the steps of its source take of a document of this size, in block order `__mx_o` and hash `__mx_h`.
    A step takes one more copy of the documents that have `level` copies and fit into the gap: all of them, or those
    up to a place in the permuted order."""
    size = F.col(size) if isinstance(size, str) else size

    def step(c, s):
        before = (F.col("__mx_o") < s["o"]) | ((F.col("__mx_o") == s["o"]) & (F.col("__mx_h") <= s["h"]))
        return F.when((c == s["level"]) & (size <= s["gap"]) & (s["whole"] | before), c + 1).otherwise(c)

    return F.when(size > 0, F.aggregate("__mx_steps", F.lit(0), step)).otherwise(0)


def fill(plan: dict, in_blocks, narrow: DataFrame, most: int, near: float) -> None:
    """Add the steps of every source to the plan, until no document that may be taken once more fits into the gap, or
    the gap is no more than the share `near` of the target.

    Documents with the fewest copies come first: those that fit are taken in permuted order of their blocks
    up to the first that does not; then smaller ones go on in what is left, until none fits; then come second and third
    copies. Every step leaves less than the document at which it stopped. All sources go in the same jobs."""
    state = {k: [0, round(p["__mx_target"])] for k, p in plan.items() if p["__mx_target"] >= 1}
    while state:
        now = literal_rows(narrow.sparkSession, [{"__mx_k": k, "__mx_level": v[0], "__mx_gap": v[1]} for k, v in state.items()], "__mx_k string, __mx_level int, __mx_gap long")
        widest = max(v[1] for v in state.values())
        fit = in_blocks(narrow.filter(f"__mx_w > 0 AND __mx_w <= {widest}"), list(state)).join(F.broadcast(now), "__mx_k")
        fit = fit.filter((F.col("__mx_w") <= F.col("__mx_gap")) & (copies("__mx_w", most) == F.col("__mx_level")))
        per_block = fit.groupBy("__mx_k", "__mx_gap", "__mx_o").agg(F.sum("__mx_w").alias("bw"))
        end = per_block.withColumn("end", F.sum("bw").over(Window.partitionBy("__mx_k").orderBy("__mx_o")))  # a row per block
        cross = (F.col("end") > F.col("__mx_gap"))
        told = {r["__mx_k"]: r for r in end.groupBy("__mx_k").agg(F.sum("bw").alias("total"), F.min(F.when(cross, F.struct("__mx_o", (F.col("end") - F.col("bw")).alias("start")))).alias("at")).collect()}
        parts = {k: r["at"] for k, r in told.items() if r["at"] is not None}
        inside = {}
        if parts:
            edges = literal_rows(narrow.sparkSession, [{"__mx_k": k, "__mx_o": r["__mx_o"], "start": r["start"]} for k, r in parts.items()], "__mx_k string, __mx_o long, start long")
            run = fit.join(F.broadcast(edges), ["__mx_k", "__mx_o"]).withColumn("end", F.col("start") + F.sum("__mx_w").over(Window.partitionBy("__mx_k").orderBy("__mx_h")))  # one block
            inside = {r["__mx_k"]: r for r in run.filter("end <= __mx_gap").groupBy("__mx_k").agg(F.max("__mx_h").alias("h"), F.max("end").alias("end")).collect()}
        for k in list(state):
            level, gap = state[k]
            step = {"level": level, "gap": gap, "whole": k not in parts, "o": 0, "h": -(1 << 63)}
            if k in parts:
                step["o"], end_ = parts[k]["__mx_o"], parts[k]["start"]
                if k in inside:
                    step["h"], end_ = inside[k]["h"], inside[k]["end"]
                state[k][1] -= end_
            elif k in told:
                state[k][1] -= told[k]["total"]
            if k in told:
                plan[k]["__mx_steps"].append(step)
            if k not in parts:  # nothing of this level is left that fits
                state[k][0] += 1
            if state[k][0] == most or state[k][1] <= near * plan[k]["__mx_target"]:
                del state[k]


def assign(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, max_blocks: int = MAX_BLOCKS, shards: int | None = None, seed: int = 1, near: float = NEAR) -> DataFrame:
    """Every row of df with `__mx_size`, `__mx_source_size`, `__mx_target`, `__mx_copies` and `__mx_taken`, and `__mx_h` and
    `__mx_shards`, the output shards of its copies. Weights repeat over the sources in code-point order, null last."""
    spark = df.sparkSession
    sized = df.withColumns({
        "__mx_k": F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))),
        "__mx_size": F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long"),
        "__mx_h": F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)),
    })
    narrow = cut(sized.groupBy("__mx_k", "__mx_h").agg(F.sum("__mx_size").alias("__mx_w"), F.count(F.lit(1)).alias("__mx_rows")))  # the numbers alone; the texts are read once for them
    found = sorted((r[0], r[1] or 0) for r in narrow.groupBy("__mx_k").agg(F.sum("__mx_w")).collect())
    total = sum(s for _, s in found)
    words = max(block_words, -(-total // max_blocks))
    goal = targets([s for _, s in found], [weights[i % len(weights)] for i in range(len(found))], most)
    plan = {k: {"__mx_k": k, "__mx_source_size": s, "__mx_target": t, "__mx_blocks": max(1, -(-s // words)), "__mx_steps": []} for (k, s), t in zip(found, goal)}

    def planned(names) -> DataFrame:
        """One row per source."""
        return F.broadcast(literal_rows(spark, [plan[k] for k in names], PLAN))

    def in_blocks(rows: DataFrame, names) -> DataFrame:
        rows = rows.join(planned(names), "__mx_k").withColumn("__mx_b", F.pmod("__mx_h", "__mx_blocks"))
        return rows.withColumn("__mx_o", F.xxhash64(F.lit(seed + 1), "__mx_k", "__mx_b"))

    fill(plan, in_blocks, narrow, most, near)
    copied = in_blocks(narrow, list(plan)).withColumn("__mx_c", copies("__mx_w", most))
    blocks = cut(copied.groupBy("__mx_k", "__mx_b", "__mx_o").agg(F.max("__mx_c").alias("__mx_passes")).filter("__mx_passes > 0"))

    # tickets, their split over the shards, and each block's shards in the order of its copies
    shards = shards or max(1, min(max_blocks // 8, total // SHARD_WORDS))
    order = Window.partitionBy("__mx_k").orderBy("__mx_pass", "__mx_o", "__mx_b")  # at most `most` times the blocks
    tickets = blocks.select("__mx_k", "__mx_b", "__mx_o", F.explode(F.sequence(F.lit(1), F.col("__mx_passes"))).alias("__mx_pass")).withColumn("__mx_ticket", F.row_number().over(order) - 1)
    quotas = dict(tickets.groupBy("__mx_k").count().collect())
    names, ranges = sorted(quotas), []
    begun = [0] * len(names)
    for s, have in enumerate(split_quotas([quotas[k] for k in names], shards, seed)):
        for i, q in enumerate(have):
            if q:
                ranges.append({"__mx_k": names[i], "__mx_shard": s, "__mx_lo": begun[i], "__mx_hi": begun[i] + q - 1})
                begun[i] += q
    dealt = literal_rows(spark, ranges, "__mx_k string, __mx_shard int, __mx_lo long, __mx_hi long").select("__mx_k", "__mx_shard", F.explode(F.sequence("__mx_lo", "__mx_hi")).alias("__mx_ticket"))
    placed = cut(tickets.join(dealt, ["__mx_k", "__mx_ticket"]).groupBy("__mx_k", "__mx_b").agg(F.array_sort(F.collect_list(F.struct("__mx_pass", "__mx_shard"))).alias("__mx_at")))

    # at most max_blocks rows, and one per source
    out = in_blocks(sized, list(plan)).join(F.broadcast(placed), ["__mx_k", "__mx_b"], "left")
    # rows that are equal in key and text are one unit, whose size decides; as a rule there are none
    units = cut(narrow.filter("__mx_rows > 1 AND __mx_w > 0").select("__mx_k", "__mx_h", "__mx_w"))
    repeated = units.count()
    if repeated:
        out = out.join(F.broadcast(units) if repeated <= MOST_UNITS else units, ["__mx_k", "__mx_h"], "left")
    size = F.coalesce("__mx_w", "__mx_size") if repeated else F.col("__mx_size")
    out = out.withColumn("__mx_c", copies(size, most))
    out = out.withColumns({"__mx_copies": F.col("__mx_c"), "__mx_taken": F.col("__mx_size") * F.col("__mx_c"), "__mx_shards": F.coalesce(F.slice("__mx_at.__mx_shard", F.lit(1), F.col("__mx_c")), F.array().cast("array<int>"))})
    return out.select(*df.columns, "__mx_size", "__mx_source_size", "__mx_target", "__mx_copies", "__mx_taken", "__mx_h", "__mx_shards")


def mix(df: DataFrame, seed: int = 1, shuffle: bool = True, **options) -> DataFrame:
    """The mixed rows themselves, with df's columns: a row per taken copy, in its shard and shuffled there."""
    rows = assign(df, seed=seed, **options).filter("__mx_copies > 0").select(*df.columns, "__mx_h", F.posexplode("__mx_shards").alias("__mx_copy", "__mx_shard"))
    if shuffle:
        rows = rows.repartition("__mx_shard").sortWithinPartitions("__mx_shard", F.xxhash64(F.lit(seed + 2), "__mx_h", "__mx_copy"))
    return rows.select(*df.columns)


@query("op3_hypergeometric_mixing")
def _(spark, sf):
    mixed = assign(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", *(F.col(f"__mx_{c}").alias(c) for c in ("size", "source_size", "target", "taken", "copies", "shards")))
