"""Sharding (8) and mixing (3)."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, sharding

ODD = [(1, None), (1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (None, None), (7, "z " * 5000)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 39, 40, 41, 203])
def test_rows_law(docs, n):
    rows = sharding.shard(docs([(i, f"t {i}") for i in range(n)]), 40).collect()
    by = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(by.values(), default=0) - min((by.get(s, 0) for s in range(40))) <= 1
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))


def test_sharding_is_reproducible_and_shuffles(docs):
    rows = [(i, f"t {i}") for i in range(300)]
    a, b = (sharding.shard(docs(x).repartition(p)) for x, p in ((rows, 3), (rows[::-1], 5)))
    place = lambda df: {r["doc_id"]: (r["shard"], r["slot"]) for r in df.collect()}
    assert place(a) == place(b) != place(sharding.shard(docs(rows), seed=2))
    assert len({r["shard"] for r in a.filter("doc_id < 40").collect()}) > 20


@pytest.mark.parametrize("n", [1, 2, 7, 8, 40, 227, 5042])
def test_permutation_is_a_bijection(spark, n):
    out = [r[0] for r in sharding.permute(spark.range(n).toDF("x"), "x", n, 5).collect()]
    assert sorted(out) == list(range(n))


def mixed64(h):
    mask = (1 << 64) - 1
    h = (h ^ h >> 33) * 0xC2B2AE3D27D4EB4F & mask
    h = (h ^ h >> 29) * 0x165667B19E3779F9 & mask
    return h ^ h >> 32


def xx64(seed, value):
    """Spark's xxhash64 of an int literal and a long."""
    mask, rot = (1 << 64) - 1, lambda v, k: (v << k | v >> (64 - k)) & ((1 << 64) - 1)
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    h = (42 + p5 + 4 & mask) ^ ((seed & 0xFFFFFFFF) * p1 & mask)
    h = mixed64((rot(h, 23) * p2 + p3) & mask)
    h = (h + p5 + 8 & mask) ^ (rot(value * p2 & mask, 31) * p1 & mask)
    h = mixed64((rot(h, 27) * p1 + p4) & mask)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("n", "seed"), [(8, 1), (39, 1), (227, 2), (1000, 3)])
def test_permutation_written_out(spark, n, seed):
    a, b = sharding.grid(n)

    def once(x):
        left, right = divmod(x, b)
        for k in range(sharding.ROUNDS):
            left = (left + xx64(seed * 64 + 2 * k, right) % a) % a
            right = (right + xx64(seed * 64 + 2 * k + 1, left) % b) % b
        return left * b + right

    def walk(x):
        x = once(x)
        while x >= n:
            x = once(x)
        return x

    got = sharding.permute(spark.range(n).select(F.col("id").alias("x"), F.col("id").alias("of")), "x", n, seed).collect()
    assert all(r["x"] == walk(r["of"]) for r in got)


def test_all_row_counts_end():
    """Walks from inside always come back: the permutation of the grid is one, so only cycles that lie wholly outside do not."""
    for seed in (1, 2, 3):
        for n in range(1, 400):
            a, b = sharding.grid(n)

            def once(x):
                left, right = divmod(x, b)
                for k in range(sharding.ROUNDS):
                    left = (left + xx64(seed * 64 + 2 * k, right) % a) % a
                    right = (right + xx64(seed * 64 + 2 * k + 1, left) % b) % b
                return left * b + right

            beyond = set(range(n, a * b))
            entered = beyond - {once(x) for x in beyond}  # what `walks` starts from
            steps = 0
            while entered:
                entered, steps = {y for x in entered if (y := once(x)) >= n}, steps + 1
                assert steps <= len(beyond)


def test_equal_rows_are_numbered_in_parts(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN NULL ELSE id END AS doc_id", "CASE WHEN id < 1500 THEN NULL ELSE 'a' END AS text").repartition(7)
    rows = sharding.shard(df.sortWithinPartitions("doc_id")).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((i % 40, i // 40) for i in range(3000))


def test_sharding_odd_rows(docs):
    rows = sharding.shard(docs(ODD, {"shard": "'mine'", "size": "1", "__x": "2"}).withColumns({**sharding.measures()}), 3).collect()
    assert len(rows) == len(ODD) and sorted((r["shard"], r["slot"]) for r in rows) == sorted((i % 3, i // 3) for i in range(len(ODD)))
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert mixing.targets([], []) == []
    t = mixing.targets([1, 1, 1000], [5, 2, 1])
    assert t == pytest.approx([3, 3, 996])


def test_splitting_tree_is_exact_and_fair():
    quotas = [1000, 30, 0, 7]
    shards = mixing.split_quotas(quotas, 13, 1)
    assert [sum(s[i] for s in shards) for i in range(4)] == quotas
    assert max(map(sum, shards)) - min(map(sum, shards)) <= 13
    first = [mixing.split_quotas([50, 50], 2, seed)[0][0] for seed in range(400)]
    mean = sum(first) / 400
    assert abs(mean - 25) < 0.6 and abs(sum((x - mean) ** 2 for x in first) / 400 - 50 * 50 * 50 * 50 / (100 * 100 * 99)) < 1.5


def mixed(df, **options):
    return mixing.assign(df, **options).collect()


def test_mix_meets_targets(docs):
    rows = [(i, "w " * (1 + i * 7 % 60), None, f"s{i % 5}" if i % 11 else None) for i in range(800)]
    out = mixed(docs(rows), block_words=300)
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        target = mine[0]["__mx_target"]
        assert sum(r["__mx_size"] for r in mine) == mine[0]["__mx_source_size"]
        assert abs(sum(r["__mx_taken"] for r in mine) - target) <= max(3, 0.01 * target)
    assert all(r["__mx_taken"] <= 3 * r["__mx_size"] and len(r["__mx_shards"]) == r["__mx_copies"] for r in out)
    assert sum({r["source"]: r["__mx_target"] for r in out}.values()) == pytest.approx(sum(r["__mx_size"] for r in out))
    again = mixed(docs(rows[::-1]).repartition(7), block_words=300)
    key = lambda r: (r["doc_id"], r["__mx_copies"], tuple(r["__mx_shards"]))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_long_texts_do_not_cost_the_target(docs):
    rows = [(i, "w " * 100, None, "b") for i in range(100)] + [(1000, "w " * 50_000, None, "b")] + [(2000 + i, "w " * 700, None, "a") for i in range(50)]
    for seed in (1, 2, 3):
        out = mixed(docs(rows), seed=seed, block_words=1000, near=0)
        for s in "ab":
            mine = [r for r in out if r["source"] == s]
            # what can be reached: three times all that is not longer than the target itself
            target = mine[0]["__mx_target"]
            reach = min(target, 3 * sum(r["__mx_size"] for r in mine if r["__mx_size"] <= target))
            taken = sum(r["__mx_taken"] for r in mine)
            left = [r["__mx_size"] for r in mine if r["__mx_copies"] < 3]
            assert taken <= target + 1 and (taken == reach or target - taken < min(left) + 1), (s, seed, taken, target)


def test_mix_against_the_rule_written_out(docs):
    import random

    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 8, 40, 300]), None, f"s{i % 3}") for i in range(120)] + [(7, "w w w", None, "s1")] * 4
    out = mixed(docs(rows), block_words=20, near=0)
    by = {}
    for r in out:
        by.setdefault(r["source"], {}).setdefault(r["__mx_h"], []).append(r)
    for mine in by.values():
        assert all(len({r["__mx_copies"] for r in same}) == 1 for same in mine.values())
        units = [(sum(r["__mx_size"] for r in same), same[0]["__mx_copies"]) for same in mine.values()]
        target = round(next(iter(mine.values()))[0]["__mx_target"])
        gap = target - sum(w * c for w, c in units)
        # nothing that may be taken once more fits, and fewer copies come first
        assert gap >= 0 and all(w == 0 or c == 3 or w > gap for w, c in units)


def test_shards_get_what_the_tree_draws(docs):
    df = docs([(i, "w " * (1 + i % 9), "en", f"s{i % 4}") for i in range(400)])
    out = mixed(df, block_words=40, shards=5)
    tickets = {}
    for r in out:
        for c, shard in enumerate(r["__mx_shards"]):
            tickets.setdefault((r["source"], block_of(r), c), set()).add(shard)
    assert all(len(s) == 1 for s in tickets.values())  # a copy of a block goes to one shard
    names = sorted({k[0] for k in tickets})
    quotas = [sum(k[0] == n for k in tickets) for n in names]
    drawn = mixing.split_quotas(quotas, 5, 1)
    got = [[sum(k[0] == n and s == {shard} for k, s in tickets.items()) for n in names] for shard in range(5)]
    assert got == drawn


def block_of(r, words=40):
    return r["__mx_h"] % max(1, -(-r["__mx_source_size"] // words))


def test_mix_returns_the_copies(docs):
    df = docs([(i, "w " * (1 + i % 9), "en", f"s{i % 4}") for i in range(300)], {"size": "9", "target": "'t'"})
    copies = {r["doc_id"]: r["__mx_copies"] for r in mixed(df, block_words=50)}
    out = mixing.mix(df, block_words=50, shards=5)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mix_odd_rows(docs):
    assert len(mixed(docs(ODD))) == len(ODD)
    assert mixed(docs([])) == [] and mixing.mix(docs([])).collect() == []
    none = mixed(docs([(1, None), (2, "")]))
    assert all(r["__mx_target"] == 0 and r["__mx_taken"] == 0 for r in none)


def test_natively(docs):
    for df in (sharding.shard(docs(ODD)), mixing.mix(docs(ODD))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
