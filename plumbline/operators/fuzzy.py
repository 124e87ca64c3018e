"""Groups of similar texts.

Semantics: rows are taken in the order of their id; the first unclaimed row leads a group and
claims every later unclaimed row whose similarity reaches the threshold. Equivalently, leaders are
the lexicographically first maximal independent set of the similarity graph, and every other row
joins its smallest leader. That definition needs no order of execution, so it runs in parallel:

1. Rows collapse to distinct normalised texts (equal texts always share a group).
2. Each text gets tokens, at least one of which it shares with every text that is similar enough: of all its
   letters or letter pairs, in one global order, the first few, or the pairs of these where two must be shared.
   How many depends on the lengths of both texts, so there is a set of tokens per band of lengths.
3. In a round, the `depth` smallest texts of each token meet. Texts that have no smaller text beyond that
   depth are ready. Pairs that meet are compared by length and by a signature of their letters within the join,
   and only what is left is scored. Then the independent set is settled over the edges: a text without a
   smaller open neighbour leads, its neighbours follow, until nothing changes. Leaders claim their followers
   among all other texts, so that a crowd of near-equal texts is compared with its few leaders, not with itself.
4. Rounds end when no text is open. The depth is as large as a bounded number of expected pairs allows; where no
   token is crowded, one round is enough.

Before that, for ratio, crowds are peeled off (`peeled`): the first open texts are settled among themselves, and their leaders claim
what they reach of all open texts, compared many at a time. As all smaller texts are settled, this is final. It goes
on as long as leaders have enough followers; what is left goes the way above.

Nothing is capped: the filter is exact for every score and threshold, and nothing but counts and a batch of leaders reaches the driver.
"""

from __future__ import annotations

import math
import sys
import tempfile
from itertools import combinations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions import dtypes, phonetic, similarity, text
from plumbline.operators.quality import row_keys
from plumbline.operators.quantiles import col

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMMON_GRAMS = 5_000  # grams whose frequency is known when tokens are ordered
MAX_PAIRS = 200_000_000  # pairs that may meet in a round, or PAIRS_PER_TEXT for each text
PAIRS_PER_TEXT = 200
PAIRS_A_TASK, SCORES_A_TASK = 2_000_000, 50_000
MAX_SCORED, SCORED_PER_TEXT = 500_000, 30  # of these, so many may be left to be scored
DEPTHS = [16 * 4**k for k in range(14)]
BAND = 1.15  # lengths of one band differ by this factor at most, or not at all
MOST_TOGETHER = {2: 14, 3: 9}  # the longest prefixes whose characters are taken in twos and in threes
MAX_BROADCAST_LIMITS = 1 << 17
HEADS = [512 * 4**k for k in range(5)]  # open texts that are settled among themselves in one task
MOST_LEADERS = 4_096  # leaders that claim in one pass
CHEAP = 1 << 15  # open texts for each of which a pass pays with one follower more for every leader
SLICE_ROWS, SLICE_CHARACTERS = 1 << 15, 1 << 21
LONG_SHARE = 0.01


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's checkpoint folder. A temporary one is set only for a local
    master, as executors of a cluster would not see it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


class TokenFilter:
    """Which tokens two texts of sufficient similarity are bound to share.

    Texts are multisets of single characters (q=1) or of character pairs (q=2). If two texts must
    have at least ``o`` of them in common, then, with all in one global order, of the first ``n - o + k`` of each
    ``k`` must be common (for k up to o). Tokens are these k, taken together.

    Jaro-Winkler adds to the Jaro score for up to four equal first characters. There are tokens for each number
    of equal first characters, which hold these and allow for just this addition.
    """

    def __init__(self, algorithm: str, threshold: float):
        self.algorithm, self.threshold = algorithm, threshold
        self.exact_only = threshold > 100
        self.theta = None if algorithm == "jaro_winkler" else (threshold - 60.0) / 40.0 if algorithm == "combined" else threshold / 100.0
        self.starts = range(5) if algorithm == "jaro_winkler" else [0]
        self.shortest = min(self.least(k) for k in self.starts)
        # Without a common phonetic key a combined score ends at 80.
        self.spoken = algorithm == "phonetic" or (algorithm == "combined" and threshold > 80)

    def jaro(self, start: int) -> float:
        """The Jaro score that is needed beside so many equal first characters."""
        return (self.threshold / 100.0 - 0.1 * start) / (1 - 0.1 * start)

    def least(self, start: int) -> float:
        """How long the shorter text must be as a share of the longer one."""
        share = self.theta / (2 - self.theta) if self.theta is not None else 3 * self.jaro(start) - 2
        return min(1.0, share) if share > 0.05 else 0.0

    def band(self, n: int) -> int:
        """Bands are single lengths as long as these are further apart than the factor, else geometric."""
        return int(math.log(max(n, 1)) / math.log(BAND))

    def lowest(self, band: int) -> int:
        return max(1, math.ceil(BAND**band - 1e-9))

    def common(self, n: float, m: float, q: int, start: int) -> int:
        """The least number of characters (or pairs) that texts of n and m characters must share; 1 if nothing is known."""
        if self.theta is not None:
            need = (1.5 * self.theta - 1) * (n + m) - 1 if q == 2 else self.theta * (n + m) / 2
        else:
            need = (3 * self.jaro(start) - 1) * n * m / (n + m)
        return max(1, math.ceil(need - 1e-9))

    def scheme(self, a: int, b: int, start: int) -> tuple[int, int]:
        """(q, how many are taken together) of two bands; the same for all texts of these."""
        low_a, low_b = self.lowest(a), self.lowest(b)
        high = max(self.lowest(a + 1), self.lowest(b + 1)) - 1
        q = 2 if self.theta is not None and min(low_a, low_b) > 1 and self.common(low_a, low_b, 2, start) > 1 else 1
        need, have = self.common(low_a, low_b, q, start), max(high, low_a, low_b) - q + 1
        # what the equal first characters tell apart needs no more
        wanted = 1 if start > 1 else 3
        return q, max(k for k in (1, 2, 3) if k == 1 or (k <= min(wanted, need) and have - need + k <= MOST_TOGETHER[k]))

    def prefix(self, n: int, other: int, q: int, together: int, start: int) -> int:
        """How many of a text's characters or pairs stand in its tokens for a band of partners."""
        have = n - q + 1
        low = max(self.lowest(other), math.ceil(n * self.least(start) - 1e-9))
        return max(min(have, together), min(have, have - max(together, self.common(n, low, q, start)) + together))

    def partners(self, n: int, bands: list[int], start: int) -> list[int]:
        least = self.least(start)
        if not least:
            return bands
        return [b for b in bands if self.lowest(b + 1) - 1 >= n * least - 1e-9 and self.lowest(b) <= n / least + 1e-9]

    def factor(self, start: int) -> float:
        """What the lengths of two texts are weighed by to give the characters that they must share."""
        return max(self.theta, 0.0) / 2 if self.theta is not None else 3 * self.jaro(start) - 1

    def needed(self, x: str, y: str) -> Column:
        """Characters that two given texts must share if they have just the equal first characters that their token
        says; with more of these they meet at another token, too."""
        n, m, f = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"f{x}")
        return f * (n + m) if self.theta is not None else f * n * m / (n + m)


SIGNATURE = ["s0", "s1", "s2", "s3", "more"]
TOKENS = T.StructType([*(T.StructField(c, T.LongType()) for c in SIGNATURE), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("factors", T.ArrayType(T.DoubleType()))])


def _signature(t: str) -> list[int]:
    """Counts of 64 kinds of characters in unary, four bits each, and how many characters are beyond four."""
    counts = [0] * 64
    for ch in t:
        o = ord(ch)
        counts[o - 97 if 97 <= o < 123 else o - 22 if 48 <= o < 58 else 36 if o == 32 else 37 + o % 27] += 1
    bits = [sum(((1 << min(c, 4)) - 1) << (4 * (k % 16)) for k, c in enumerate(counts[16 * w : 16 * w + 16], 0)) for w in range(4)]
    return [b - (1 << 64) if b >> 63 else b for b in bits] + [sum(max(0, c - 4) for c in counts)]


def _token_udf(filter_: TokenFilter, frequency: dict[str, int], bands: list[int]):
    def of(t: str) -> tuple[list[str], list[float]]:
        n, out, factors, ordered = len(t), [], [], {}
        own = filter_.band(n)
        for start in filter_.starts:
            if start > n:
                break
            for other in filter_.partners(n, bands, start):
                lo, hi = min(own, other), max(own, other)
                q, together = filter_.scheme(lo, hi, start)
                if q not in ordered:
                    seen: dict[str, int] = {}
                    grams = []
                    for i in range(n - q + 1):
                        g = t[i : i + q]
                        seen[g] = seen.get(g, 0) + 1
                        grams.append((frequency.get(g, 0), g, seen[g]))
                    ordered[q] = sorted(grams)
                first = [f"{k}{g}" for _, g, k in ordered[q][: filter_.prefix(n, other, q, together, start)]]
                out += [f"{start}{t[:start]}|{lo}|{hi}|{q}|" + "|".join(c) for c in combinations(first, together)]
                factors += [filter_.factor(start)] * (len(out) - len(factors))
        return out, factors

    def tokens(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*_signature(t), *of(t)) for t in texts], columns=[*SIGNATURE, "tokens", "factors"])

    return F.pandas_udf(tokens, TOKENS)


def _frequencies(nodes: DataFrame) -> dict[str, int]:
    """Counts of the most common characters and pairs: at most COMMON_GRAMS rows; rarer ones come first anyway."""
    grams = "concat(split(text, ''), transform(sequence(1, greatest(length(text) - 1, 1)), i -> substring(text, i, 2)))"
    top = (
        nodes.select(F.explode(F.expr(grams)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "g").limit(COMMON_GRAMS).collect()
    )
    return {r["g"]: r["n"] for r in top}


def _tasks(df: DataFrame, wanted: float) -> int:
    return int(min(10_000, max(wanted, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


class Crowd:
    """The distinct texts (block, id, text) of one grouping, with their tokens."""

    def __init__(self, nodes: DataFrame, algorithm: str, threshold: float):
        self.nodes, self.algorithm, self.threshold = nodes, algorithm, threshold
        self.filter = TokenFilter(algorithm, threshold)
        base = nodes.select("block", "id", "text", F.length("text").cast("double").alias("n"))
        if algorithm == "phonetic":
            tokens = F.transform(phonetic.shared(F.col("keys")), lambda k: F.struct(F.xxhash64(k).alias("token"), F.lit(0.0).alias("f")))
            marked = base.withColumn("keys", phonetic.keys(F.col("text"))).select("block", "id", "n", *[F.lit(0).cast("long").alias(c) for c in SIGNATURE], tokens.alias("tokens"))
        else:
            marked = base.withColumn("t", _token_udf(self.filter, _frequencies(nodes), self._bands())("text"))
            pair = F.arrays_zip(F.col("t.tokens").alias("token"), F.col("t.factors").alias("f"))
            if self.filter.spoken:
                marked = marked.withColumn("keys", phonetic.shared(phonetic.keys(F.col("text"))))
                tokens = F.flatten(F.transform(pair, lambda t: F.transform("keys", lambda k: F.struct(F.xxhash64(t["token"], k).alias("token"), t["f"].alias("f")))))
            else:
                tokens = F.transform(pair, lambda t: F.struct(F.xxhash64(t["token"]).alias("token"), t["f"].alias("f")))
            marked = marked.select("block", "id", "n", *[f"t.{c}" for c in SIGNATURE], F.array_distinct(tokens).alias("tokens"))
        #: What meets in joins: no text, but its length and signature.
        self.marked = checkpoint(marked)

    def _bands(self) -> list[int]:
        """Bands of lengths that occur: their number grows with the logarithm of the longest text."""
        lengths = self.nodes.select(F.length("text").alias("n")).groupBy(F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).alias("b")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
        return sorted({self.filter.band(n) for r in lengths for n in (r["lo"], r["hi"])})

    def exploded(self, rows: DataFrame) -> DataFrame:
        return rows.select("block", "id", "n", *SIGNATURE, F.inline("tokens"))

    def pairs(self, left: DataFrame, right: DataFrame, expected: float = 0) -> DataFrame:
        """(l, r): pairs with l < r of exploded rows that may be similar; no similar pair is missing. Few rows can meet in
        many pairs, so the number of tasks follows the expected pairs, not the bytes."""
        parts = _tasks(left, expected / PAIRS_A_TASK)
        side = lambda df, s: df.repartition(parts, "block", "token").select("block", "token", *[F.col(c).alias(c + s) for c in ("id", "n", "f", *SIGNATURE)])
        met = side(left, "x").join(side(right, "y"), ["block", "token"]).filter("idx < idy")
        if self.algorithm != "phonetic":
            both = sum((F.bit_count(F.col(f"{c}x").bitwiseAND(F.col(f"{c}y"))) for c in SIGNATURE[:4]), F.least("morex", "morey"))
            met = met.filter(both >= self.filter.needed("x", "y") - 1e-6)
            if self.filter.shortest > 0:
                met = met.filter(F.least("nx", "ny") >= F.greatest("nx", "ny") * (self.filter.shortest - 1e-9))
        return met.select(F.col("idx").alias("l"), F.col("idy").alias("r")).distinct()

    def similar(self, pairs: DataFrame, n: int = 0) -> DataFrame:
        """The pairs, about n of them, that are similar."""
        texts = lambda i, t: self.nodes.select(F.col("id").alias(i), F.col("text").alias(t))
        known = pairs.join(texts("l", "lt"), "l").join(texts("r", "rt"), "r")
        return known.repartition(_tasks(pairs, n / SCORES_A_TASK)).filter(similarity.reaches(self.algorithm, F.col("lt"), F.col("rt"), self.threshold)).select("l", "r")

    def smallest(self, open_: DataFrame, own: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        """The `depth` smallest texts of each token, and the ids of texts all of whose smaller partners are among them."""
        place = F.row_number().over(Window.partitionBy("block", "token").orderBy("id"))
        top = checkpoint(own.withColumn("place", place).filter(F.col("place") <= depth))
        limits = checkpoint(top.groupBy("block", "token").agg(F.max("id").alias("last"), F.max("place").alias("place")).filter(F.col("place") == depth).drop("place"))
        limits = F.broadcast(limits) if limits.count() <= MAX_BROADCAST_LIMITS else limits
        late = own.select("block", "token", "id").join(limits, ["block", "token"]).filter("id > last").select("id").distinct()
        return top, checkpoint(open_.select("id").join(late, "id", "left_anti"))

    def leaders(self) -> DataFrame:
        """(id, leader) of every text."""
        ids = self.nodes.select("id")
        if self.filter.exact_only:
            return ids.withColumn("leader", F.col("id"))
        open_, settled, deepest = self.marked, None, DEPTHS[-1]
        while True:
            own = self.exploded(open_)
            sizes = own.groupBy("block", "token").agg(F.count(F.lit(1)).alias("k"))
            upto = lambda d: F.least(F.col("k"), F.lit(d)).cast("double")
            told = sizes.agg(F.max("k").alias("largest"), *[F.sum(upto(d) * (upto(d) - 1) / 2).alias(f"d{d}") for d in DEPTHS]).first()
            texts = open_.count()
            if not texts:
                break
            most = max(MAX_PAIRS, PAIRS_PER_TEXT * texts)
            depths = [d for d in DEPTHS if told[f"d{d}"] <= most and d <= deepest] or DEPTHS[:1]
            while True:
                depth = depths.pop()
                whole = told["largest"] <= depth
                if whole:
                    top, ready = own, open_.select("id")
                else:
                    top, ready = self.smallest(open_, own, depth)
                pairs = checkpoint(self.pairs(top, top if whole else top.join(ready, "id", "left_semi"), told[f"d{depth}"]))
                met = pairs.count()
                # a crowd of near-equal texts passes the signatures: it takes fewer texts to find its leaders
                if not depths or met <= max(MAX_SCORED, SCORED_PER_TEXT * texts):
                    break
                deepest = depths[-1]
            edges = checkpoint(self.similar(pairs, met))
            heads = checkpoint(_first_independent(ready, edges))
            claims = edges.join(heads.withColumnRenamed("id", "l"), "l", "left_semi")
            # texts that were not ready, and followers of a larger leader, have not met the new leaders
            others = None if whole else open_.join(ready, "id", "left_anti")
            if settled is not None:
                followers = self.marked.join(settled.filter("id <> leader").select("id"), "id", "left_semi")
                others = followers if others is None else others.unionByName(followers)
            if others is not None:
                claims = claims.unionByName(self.similar(self.pairs(self.exploded(open_.join(heads, "id", "left_semi")), self.exploded(others.join(heads, "id", "left_anti")))))
            claims = checkpoint(claims.groupBy(F.col("r").alias("id")).agg(F.min("l").alias("claim")))
            now = heads.withColumn("leader", F.col("id"))
            if settled is None:
                now = now.unionByName(claims.select("id", F.col("claim").alias("leader")))
            else:
                kept = settled.join(claims, "id", "left").select("id", F.least("leader", "claim").alias("leader"))
                now = now.unionByName(kept).unionByName(claims.join(settled, "id", "left_anti").select("id", F.col("claim").alias("leader")))
            settled = checkpoint(now)
            if whole:
                break
            open_ = checkpoint(open_.join(settled, "id", "left_anti"))
        return ids.withColumn("leader", F.col("id")) if settled is None else settled


def _first_independent(ready: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids among ready that lead: each is decided once all its smaller neighbours over edges (l, r), l < r, are. All r are
    ready; an l that is not stays undecided, and so does who waits for it."""
    touched = edges.select(F.col("l").alias("id")).union(edges.select(F.col("r").alias("id"))).distinct()
    heads = ready.join(touched, "id", "left_anti")
    undecided, alive = checkpoint(ready.join(touched, "id", "left_semi")), edges
    while True:
        first = checkpoint(undecided.join(alive.select(F.col("r").alias("id")), "id", "left_anti"))
        if first.isEmpty():
            return heads
        heads = heads.unionByName(first)
        gone = checkpoint(alive.join(first.withColumnRenamed("id", "l"), "l", "left_semi").select(F.col("r").alias("id")).distinct())
        alive = checkpoint(alive.join(gone.withColumnRenamed("id", "l"), "l", "left_anti").join(gone.withColumnRenamed("id", "r"), "r", "left_anti"))
        undecided = checkpoint(undecided.join(first, "id", "left_anti").join(gone, "id", "left_anti"))


def _by_block(table) -> list[tuple[object, object]]:
    """(block, rows) of an Arrow table; rows keep their order."""
    import numpy as np

    keys = table.column("block").combine_chunks().dictionary_encode()
    order = np.argsort(keys.indices.to_numpy(), kind="stable")
    edges = np.cumsum(np.bincount(keys.indices.to_numpy(), minlength=len(keys.dictionary)))
    return [(k, order[a:b]) for k, a, b in zip(keys.dictionary.to_pylist(), [0, *edges], edges)]


def _leading(threshold: float, most: int):
    """For mapInArrow over a bounded number of texts in one partition: those that lead among them. Once there are `most`, what comes
    later in a block stays undecided."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("id", "ascending"), ("text", "ascending")])
        leaders = []
        for _, rows in _by_block(table):
            if len(leaders) >= most:
                break
            texts, place = similarity.Texts(table.column("text").take(pa.array(rows)).to_pylist()), 0
            alive = np.ones(len(rows), bool)
            while len(leaders) < most and len(ahead := np.flatnonzero(alive[place:])):
                place += int(ahead[0])
                leaders.append(int(rows[place]))
                alive[texts.reaching(texts, place, threshold)] = False
                if alive.sum() * 4 < len(rows) * 3:  # what is settled is left out now and then
                    rows, texts, place = rows[alive], texts.take(np.flatnonzero(alive)), 0
                    alive = np.ones(len(rows), bool)
        yield from table.take(pa.array(leaders, pa.int64())).to_batches()

    return run


def _claiming(leaders, threshold: float):
    """For mapInArrow over open texts: the same with the smallest of the leaders, a broadcast Arrow table, that reaches them."""
    import numpy as np
    import pyarrow as pa

    def claimed(table, heads, ids, of):
        out = np.full(table.num_rows, -1, np.int64)
        for block, rows in _by_block(table):
            if block not in heads:
                continue
            texts = similarity.Texts(table.column("text").take(pa.array(rows)).to_pylist())
            for k, place in enumerate(of[block]):
                hit = rows[texts.reaching(heads[block], k, threshold)]
                out[hit[out[hit] < 0]] = place
                open_ = out[rows] < 0 if len(hit) else None
                if open_ is not None and open_.sum() * 4 < len(rows) * 3:
                    rows, texts = rows[open_], texts.take(np.flatnonzero(open_))
                if not len(rows):
                    break
        return ids.take(pa.array(out, mask=out < 0))

    def run(batches):
        found = leaders.value
        of = dict(_by_block(found))
        names = found.column("text").to_pylist()
        heads = {b: similarity.Texts([names[i] for i in rows]) for b, rows in of.items()}
        ids, held = found.column("id").combine_chunks(), []

        def flush():
            table = pa.Table.from_batches(held)
            held.clear()
            return table.append_column("leader", claimed(table, heads, ids, of)).to_batches()

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = np.cumsum(batch.column("n").slice(at, SLICE_ROWS).to_numpy())
                upto = max(1, int(np.searchsorted(size, SLICE_CHARACTERS, "right")))
                held.append(batch.slice(at, upto))
                at += upto
                if sum(b.num_rows for b in held) >= SLICE_ROWS or at < batch.num_rows:
                    yield from flush()
        if held:
            yield from flush()

    return run


def peeled(nodes: DataFrame, threshold: float) -> tuple[list[DataFrame], DataFrame | None]:
    """Settled texts (block, id, text, leader) of crowds by their ratio, and the open ones (block, id, text) that are left, if any.
    No text that is left is similar to a settled one's leader, so they form a problem of their own."""
    spark = nodes.sparkSession
    open_ = nodes.filter("id IS NOT NULL").select("block", "id", "text", F.length("text").cast("long").alias("n"))
    texts, long = open_.agg(F.count(F.lit(1)), F.count_if(F.col("n") > similarity.WORD)).first()
    if not texts:
        return [], None
    if long > texts * LONG_SHARE:
        return [], nodes
    open_ = checkpoint(open_.repartition(_tasks(nodes, texts / SLICE_ROWS), "id", "text"))
    fields = T.StructType(open_.schema.fields)
    settled, sizes = [], list(HEADS)
    while texts:
        size = sizes[0]
        head = open_
        if texts > CHEAP and texts > 4 * size:  # the smallest ids, about as many as wanted, by every 64th
            last = open_.filter(F.pmod(F.xxhash64("id", "text"), F.lit(64)) == 0).select("id").orderBy("id").limit(max(1, size // 64)).agg(F.max("id").alias("last"))
            head = open_.join(F.broadcast(last), F.col("id") <= F.col("last")).drop("last")
        head = head.orderBy("id", "text").limit(max(CHEAP, 2 * size))
        most = MOST_LEADERS
        found = head.coalesce(1).mapInArrow(_leading(threshold, most), fields).toArrow()
        if not found.num_rows:  # no id among every 64th
            found = open_.orderBy("id", "text").limit(size).coalesce(1).mapInArrow(_leading(threshold, most), fields).toArrow()
        leaders = spark.sparkContext.broadcast(found)
        claimed = checkpoint(open_.mapInArrow(_claiming(leaders, threshold), T.StructType([*fields, T.StructField("leader", fields["id"].dataType)])))
        leaders.destroy()
        settled.append(claimed.filter("leader IS NOT NULL").drop("n"))
        open_ = claimed.filter("leader IS NULL").drop("leader")
        left = open_.count()
        if left > CHEAP and texts - left - found.num_rows < found.num_rows * (texts / CHEAP):
            return settled, open_.drop("n")
        if found.num_rows < most // 4 and len(sizes) > 1:
            sizes.pop(0)
        texts = left
    return settled, None


def _assign(nodes: DataFrame, algorithm: str, threshold: float) -> DataFrame:
    """(block, id, text, leader) for every node (block, id, text)."""
    settled, rest = peeled(nodes, threshold) if algorithm == "ratio" and threshold <= 100 else ([], nodes)
    if rest is not None:
        settled = [*settled, rest.join(Crowd(rest, algorithm, threshold).leaders(), "id").select("block", "id", "text", "leader")]
    out = nodes.limit(0).withColumn("leader", F.col("id")).select("block", "id", "text", "leader")
    for s in settled:
        out = out.unionByName(s)
    return out


def _groups(rows: DataFrame, algorithm: str, threshold: float, match_type: str, key_columns: list[str], prefix: str = "") -> DataFrame:
    """Groups of (row_id, block, text, value) rows."""
    rows = rows.filter(F.col("text") != "")
    nodes = checkpoint(rows.groupBy("block", "text").agg(F.min("row_id").alias("id")).select("block", "id", "text"))
    assigned = checkpoint(_assign(nodes, algorithm, threshold))
    members = rows.join(assigned.select("block", "text", "leader"), ["block", "text"])
    head = assigned.filter("id = leader").select("leader", F.col("text").alias("head"))
    per_group = (
        members.groupBy("leader").agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("value", "row_id").alias("representative"),
            F.min_by(F.when(F.col("row_id") != F.col("leader"), F.col("text")), F.when(F.col("row_id") != F.col("leader"), F.col("row_id"))).alias("second"),
        ).filter("n > 1").join(head, "leader")
        .select("leader", "representative", similarity.score(algorithm, F.col("head"), F.col("second")).alias("similarity"))
    )
    group_id = F.concat(F.lit(prefix), F.col("leader").cast("string")) if prefix else F.col("leader")
    return members.select("row_id", "leader").join(per_group, "leader").select(
        group_id.alias("group_id"), "row_id", F.lit(match_type).alias("match_type"), "similarity",
        F.array(*[F.lit(c) for c in key_columns]).alias("key_columns"), "representative",
    )


def fuzzy_groups(df: DataFrame, column: str, rid: str, threshold: float = 85.0, algorithm: str = "ratio") -> DataFrame:
    """Groups of similar texts in one column (D10); same columns as ``exact_groups``.

    ``algorithm``: ratio, difflib, jaro_winkler, phonetic or combined. Texts that normalise to
    nothing form no group. The group's similarity is that of its first two rows.
    """
    rows = df.filter(col(column).isNotNull()).select(
        col(rid).alias("row_id"), F.lit(0).alias("block"), similarity.normalize(col(column)).alias("text"), col(column).alias("value")
    )
    return _groups(rows, algorithm, threshold, "fuzzy", [column])


def fuzzy_groups_all(df: DataFrame, columns: list[str], rid: str, threshold: float = 85.0, algorithm: str = "ratio") -> DataFrame:
    """``fuzzy_groups`` of several text columns; group ids read ``column:first row``."""
    out = None
    for c in [c for c in columns if dtypes.is_text(df.schema[c].dataType)]:
        one = fuzzy_groups(df, c, rid, threshold, algorithm).withColumn("group_id", F.concat(F.lit(c + ":"), F.col("group_id").cast("string")))
        out = one if out is None else out.unionByName(one)
    return out


def combined_groups(
    df: DataFrame, exact: list[str], fuzzy: list[str], rid: str, threshold: float = 85.0, algorithm: str = "ratio"
) -> DataFrame:
    """Similar texts among rows that agree exactly on other columns.

    The exact key is part of every join key. Without exact columns this is ``fuzzy_groups_all``.
    """
    if not exact:
        return fuzzy_groups_all(df, fuzzy, rid, threshold, algorithm)
    keys = row_keys(df, exact)
    block = F.sha2(F.to_json(F.struct(*keys)), 256)
    some = F.coalesce(*[k.cast("string") for k in keys]).isNotNull()
    out = None
    for c in [c for c in fuzzy if dtypes.is_text(df.schema[c].dataType)]:
        rows = df.filter(some & col(c).isNotNull()).select(
            col(rid).alias("row_id"), block.alias("block"), similarity.normalize(col(c)).alias("text"), col(c).alias("value")
        )
        one = _groups(rows, algorithm, threshold, "combined", [*exact, c], prefix=c + ":")
        out = one if out is None else out.unionByName(one)
    return out


def similar_values(df: DataFrame, column: str, rid: str, threshold: float = 85.0) -> DataFrame:
    """Similar values among those that occur once, placeholders aside (D24, similar part)."""
    c = col(column)
    real = df.filter(~text.is_placeholder(c))
    key = text.compact_key(c).alias("k")
    once = real.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(col(rid)).alias("row_id")).filter("n = 1")
    rows = real.join(once.select(F.col("row_id").alias(rid)), rid, "left_semi")
    return fuzzy_groups(rows, column, rid, threshold)


def pair_scores(pairs: DataFrame, left: str, right: str, algorithms: list[str]) -> DataFrame:
    """Add a score column per algorithm to given pairs of normalised texts."""
    scored: dict[str, Column] = {a: similarity.score(a, col(left), col(right)) for a in algorithms}
    return pairs.withColumns(scored)
