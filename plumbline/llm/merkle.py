"""Merkle dataset manifest (11): a tree of hashes over every source, one over the sources, and a proof for each row.

Leaves of a source ascend by key; every three consecutive nodes of a level become the hash of their
concatenation, until one is left (the subroot). The subroots, by source (null first, then by UTF-8 bytes),
likewise become the root.

1. Rows are ranked within their source without a task that sees a whole source: range partitions, their counts,
   and offsets. Equal rows are dealt over partitions, too.
2. A rank is a row of base-3 digits. Within a block of 3^`LEVELS` ranks the digit columns are grouped away one by
   one, lowest first, each time nesting the children's structs in their parent's. All these groupings use
   one shuffle by (source, block). Block roots are the leaves of the next tier, until a source has one.
3. From the top tier down, `transform` gives each child its siblings and the path above, and `explode` emits
   the children. A block meets the path above it by grouping the two kinds of rows; there is no join.

Edge cases: null columns hash as `-`; a null key comes first in its source, equal keys are ordered by leaf and
equal leaves get places of their own; a null source is a source; texts of any length are hashed whole; an empty
table gives an empty result and no root. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut

FAN, LEVELS = 3, 7
#: Rows of (range partition, source) up to which the offsets are broadcast.
MOST_OFFSETS = 1 << 17


def digest(*inputs: Column) -> Column:
    """Lower-case hex sha256 of the inputs' concatenation."""
    return F.sha2(F.concat(*inputs), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """rows with `__mk_r`, the rank from 0 among the rows of one `group` value (not null) by `order`, and `__mk_n`, the
    group's size; also the largest group's size. rows must read the same each time (a checkpoint or a table)."""
    order = [group, *order, "__mk_salt"]  # the salt parts equal rows; any order among them is right
    at = F.monotonically_increasing_id()  # partition and place in it
    laid = cut(rows.withColumn("__mk_salt", at).repartitionByRange(*order).sortWithinPartitions(*order).drop("__mk_salt"))
    placed = laid.withColumns({"__mk_p": F.shiftright(at, 33), "__mk_i": at.bitwiseAND((1 << 33) - 1)})
    runs = cut(placed.groupBy("__mk_p", group).agg(F.min("__mk_i").alias("__mk_first"), F.count(F.lit(1)).alias("__mk_k")))
    before = Window.orderBy("__mk_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = runs.groupBy("__mk_p").agg(F.sum("__mk_k").alias("k")).select("__mk_p", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("__mk_base"))
    runs = runs.join(F.broadcast(base), "__mk_p").withColumn("__mk_at", F.col("__mk_base") + F.col("__mk_first"))
    sizes = runs.groupBy(group).agg(F.min("__mk_at").alias("__mk_start"), F.sum("__mk_k").alias("__mk_n"))
    shifts = cut(runs.join(sizes, group).select("__mk_p", group, (F.col("__mk_at") - F.col("__mk_start") - F.col("__mk_first")).alias("__mk_shift"), "__mk_n"))
    many, most = shifts.agg(F.count(F.lit(1)), F.max("__mk_n")).first()
    # beyond the bound the join shuffles, by keys that a range partition bounds
    shifts = F.broadcast(shifts) if many <= MOST_OFFSETS else shifts
    return placed.join(shifts, ["__mk_p", group]).withColumn("__mk_r", F.col("__mk_i") + F.col("__mk_shift")).drop("__mk_p", "__mk_i", "__mk_shift"), most or 0


def rolled(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Blocks (s, n, b, kids, h) of nodes (s, n, r, h, item): n nodes of tree s, r the rank, b the block, h its root."""
    digit = lambda j: F.pmod(F.floor(F.col("r") / FAN ** (j - 1)), F.lit(FAN)).cast("byte")
    digits = [f"d{j}" for j in range(1, levels + 1)]
    df = nodes.select("s", "n", F.floor(F.col("r") / FAN**levels).alias("b"), *(digit(j).alias(f"d{j}") for j in range(1, levels + 1)), "h", F.col("item").alias("kids")).repartition("s", "b")
    for j, d in enumerate(digits, 1):
        df = df.groupBy("s", "n", "b", *digits[j:]).agg(F.sort_array(F.collect_list(F.struct(d, "h", "kids"))).alias("kids"))
        # above the tree's root nodes just pass
        df = df.withColumn("h", F.when(F.col("n") > FAN ** (j - 1), F.sha2(F.array_join(F.transform("kids", lambda k: k["h"]), ""), 256)).otherwise(F.col("kids")[0]["h"]))
    return df


def spread(blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Nodes (s, h, item, path, above) of blocks (s, n, kids, path, above); path runs from the node upwards."""
    text = lambda c: F.coalesce(c, F.lit(""))
    for j in range(levels, 0, -1):

        def child(k, i):
            at = lambda x: text(F.get(F.col("kids"), x)["h"])
            step = F.struct(F.concat(at(i - 2), at(i - 1)).alias("before"), F.concat(at(i + 1), at(i + 2)).alias("after"))
            path = F.when(F.col("n") > FAN ** (j - 1), F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
            return F.struct(k["h"].alias("h"), k["kids"].alias("kids"), path.alias("path"))

        blocks = blocks.select("s", "n", "above", F.explode(F.transform("kids", child)).alias("c")).select("s", "n", "above", "c.h", "c.kids", "c.path")
    return blocks.withColumnRenamed("kids", "item").drop("n")


def linked(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """blocks with the path above each: rows of both kinds, grouped by block."""
    known = blocks.select("s", "b", "n", "kids", F.lit(None).alias("path"), F.lit(None).alias("above"))
    told = paths.select("s", "b", F.lit(None).alias("n"), F.lit(None).alias("kids"), "path", "above")
    both = known.union(told)
    return both.groupBy("s", "b").agg(F.max("n").alias("n"), F.first("kids", True).alias("kids"), F.first("path", True).alias("path"), F.first("above", True).alias("above"))


def climbed(nodes: DataFrame, most: int, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all tiers over nodes (s, n, r, h, item), lowest first, and (s, h) of the roots."""
    tiers, size = [], FAN**levels
    while not tiers or most > 1:
        tiers.append(cut(rolled(nodes, levels)))
        nodes = tiers[-1].select("s", F.ceil(F.col("n") / size).alias("n"), F.col("b").alias("r"), "h", F.col("b").alias("item"))
        most = -(-most // size)
    return tiers, nodes.select("s", "h")


def descended(tiers: list[DataFrame], paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(s, h, item, path, above) of all nodes below the tiers; paths: (s, b, path, above) of the roots."""
    for tier in reversed(tiers[1:]):
        paths = cut(spread(linked(tier, paths), levels).select("s", F.col("item").alias("b"), "path", "above"))
    return spread(linked(tiers[0], paths), levels)


PATH = "array<struct<before string, after string>>"


def manifest(leaves: DataFrame, key: str, source: str, leaf: str = "leaf", carried: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """Every row of leaves (its key, source, leaf and carried columns) with `position` in its source, `subroot`, `root` and
    `path`: of each level from the leaf to the root the hashes `before` and `after` the row's own node, concatenated."""
    kept = [key, *carried]
    rows = cut(leaves.select(F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string"))).alias("s"), F.col(leaf).alias("h"), F.col(key).alias("k"), F.struct(*kept).alias("row")))
    places, most = ranked(rows, "s", ["k", "h"])
    nodes = places.select("s", F.col("__mk_n").alias("n"), F.col("__mk_r").alias("r"), "h", F.struct(F.col("__mk_r").alias("position"), "row").alias("item"))
    tiers, subroots = climbed(nodes, most, levels)
    subroots = cut(subroots)
    # the tree over the sources, all of it one tree
    tops, most = ranked(subroots.withColumn("all", F.lit("")), "all", ["s"])
    top_nodes = tops.select(F.col("all").alias("s"), F.col("__mk_n").alias("n"), F.col("__mk_r").alias("r"), "h", F.struct("s", F.col("h").alias("subroot")).alias("item"))
    top_tiers, root = climbed(top_nodes, most, levels)
    root = (root.select("h").first() or [None])[0]
    start = tops.sparkSession.range(0, 1 if root else 0, 1, 1).select(F.lit("").alias("s"), F.lit(0).cast("long").alias("b"), F.array().cast(PATH).alias("path"), F.lit("").alias("above"))
    sources = descended(top_tiers, start, levels)
    paths = cut(sources.select(F.col("item.s").alias("s"), F.lit(0).cast("long").alias("b"), "path", F.col("item.subroot").alias("above")))
    out = descended(tiers, paths, levels)
    return out.select(*(F.col("item.row")[c].alias(c) for c in kept), F.when(F.col("s") == "0", F.lit(None)).otherwise(F.substring("s", 2, 1 << 30)).alias(source), F.col("h").alias(leaf), F.col("item.position").alias("position"), F.col("above").alias("subroot"), F.lit(root).cast("string").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["before"], h, step["after"]))


def proof(path: Column) -> Column:
    """One digest of all siblings on the path."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BITS = "flatten([[(ascii(c) >> i) & 1 for i in range(0, 8)] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
_LEAF = " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in FIELDS)
_PLAIN = _LEAF.format(**{c: c for c in FIELDS})
_CUT = _LEAF.format(**{c: c for c in FIELDS} | {"text": "replace(text, chr(10), '')"})
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_PLAIN}) AS leaf, sha256({_CUT}) AS cut_leaf,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS crc FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id FROM d),
f AS (SELECT source, n, 0 AS level, r, leaf AS h FROM l
      UNION ALL SELECT source, (n + 2) // 3, level + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)) FROM f WHERE n > 1 GROUP BY source, n, level, r // 3),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM f WHERE n = 1),
t AS (SELECT n, 0 AS level, r, h FROM sub
      UNION ALL SELECT (n + 2) // 3, level + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)) FROM t WHERE n > 1 GROUP BY n, level, r // 3),
nodes AS (SELECT 'f' || coalesce('1' || source, '0') AS tree, n, level, r, h FROM f UNION ALL SELECT 't', n, level, r, h FROM t),
steps AS (SELECT tree, n, level, r, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, r // 3 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
                 coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, r // 3 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM nodes),
walk AS (SELECT id, 'f' || coalesce('1' || source, '0') AS tree, 0 AS level, r, CASE WHEN crc % 2 = 0 THEN cut_leaf ELSE leaf END AS acc, '' AS proof, false AS done FROM l
         UNION ALL
         SELECT w.id, CASE WHEN s.n > 1 THEN w.tree ELSE 't' END, CASE WHEN s.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN s.n > 1 THEN w.r // 3 ELSE sub.r END,
                CASE WHEN s.n > 1 THEN sha256(s.bef || w.acc || s.aft) ELSE w.acc END, CASE WHEN s.n > 1 THEN w.proof || s.bef || s.aft ELSE w.proof END, s.n = 1 AND w.tree = 't'
         FROM walk w JOIN steps s ON s.tree = w.tree AND s.level = w.level AND s.r = w.r LEFT JOIN sub ON w.tree = 'f' || coalesce('1' || sub.source, '0') WHERE NOT w.done)
SELECT l.doc_id, l.leaf, sub.h AS subroot, (SELECT h FROM t WHERE n = 1) AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = (SELECT h FROM t WHERE n = 1) AS verified
FROM walk w JOIN l USING (id) JOIN sub ON sub.source IS NOT DISTINCT FROM l.source WHERE w.done"""


@query("op11_merkle_manifest", SQL)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(*FIELDS)
    leaf = lambda **other: digest(*(framed(other.get(c, F.col(c))) for c in FIELDS))
    broken = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select("doc_id", "source", leaf().alias("leaf"), F.when(broken, leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))
    out = manifest(leaves, "doc_id", "source", carried=["tampered"])
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
