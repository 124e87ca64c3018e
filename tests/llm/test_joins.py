"""N-gram join (6), exact search (7) and the pipeline."""

import random
import re

import pytest

import corpus_pipeline
from plumbline.llm import hamming, ngram_join

ODD = [(1, None), (1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  TWO\n"), (7, "two one"), (None, "x y z w"), (9, "X y z w"), (10, "a b c"), (10, "a b c"), (None, None)]


def grams(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_components(rows, percent=90, words=3):
    sets = [grams(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = []
    for group in members.values():
        named = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(repr(rows[i][0]), len(sets[i]), min(named, default=None)) for i in group]
    return sorted(out, key=repr), members


def result(df):
    return sorted(((repr(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def crowd(seed, n=140):
    """Texts of a few bases with few or many edits, a passage that many share, and short ones."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    bases = [[f"b{k}w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 70, 120]))] for k in range(6)]
    for i in range(n):
        base = list(bases[min(5, int(rng.expovariate(0.7)))])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            base[rng.randrange(len(base))] = f"e{rng.randint(0, 30)}"
        if rng.random() < 0.3:
            base = passage + base[: rng.randint(0, 12)]
        rows.append((i, " ".join(base[: rng.choice([len(base)] * 6 + [2, 4, 9])])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(docs, seed):
    rows = crowd(seed)
    assert result(ngram_join.join_components(docs(rows).repartition(5))) == brute_components(rows)[0]


def test_components_at_another_threshold(docs):
    rows = crowd(3, 90)
    assert result(ngram_join.join_components(docs(rows), percent=60)) == brute_components(rows, 60)[0]


def test_odd_rows_and_keep_one(docs):
    df = docs(ODD, {"component_id": "7", "n_shingles": "'n'"})
    assert result(ngram_join.join_components(df)) == brute_components(ODD)[0]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    texts = sorted((repr(r["doc_id"]), repr(r["text"])) for r in kept.collect())
    assert texts == sorted((repr(i), repr(t)) for i, t in [(1, None), (2, ""), (3, "one"), (5, "one two"), (7, "two one"), (9, "X y z w"), (10, "a b c"), (None, None)])
    assert ngram_join.join_components(docs([])).collect() == [] and ngram_join.keep_one(docs([])).collect() == []


def test_keep_one_takes_columns_of_any_name(docs):
    """Rows that stay without a check, that go, and that are repeated; columns named like those of the map."""
    same = "a b c d e f g h"
    rows = [(1, same), (2, same), (3, "q r s t u v"), (4, "one two three four"), (4, "one two three four"), (5, None)]
    df = docs(rows, {"m": "'m'", "b": "1", "`x.y`": "2"})
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["m"], r["b"], r["x.y"]) for r in kept.collect()) == [(i, "m", 1, 2) for i in (1, 3, 4, 5)]


def brute_links(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return {(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


@pytest.mark.parametrize("words", [1, 5])
def test_components_of_other_shingles(docs, words):
    rows = crowd(5, 90)
    group = {i: i for i, _ in rows}
    for _ in rows:
        for i, j in brute_links(rows, words, 80):
            group[i] = group[j] = min(group[i], group[j])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(docs(rows).repartition(3), percent=80, words=words).collect()}
    assert got == group


def test_near_duplicate_stage_drops_appended_copies(spark, docs):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, text + " " + " ".join(f"x{i}" for i in range(18))), (3, "other words than those of the rest")]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_stars_find_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(30)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in ngram_join.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in got:
        seen, todo = set(), [node]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert got[node] == min(seen)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("bits", [64, 20, 16, 5])
def test_search_is_exact(spark, bits):
    rng = random.Random(bits)
    rows = [(i, [rng.choice([-1.0, 1.0]) for _ in range(bits)]) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(15)] + [(1, rows[1][1]), (900, None), (901, []), (902, [1.0]), (None, rows[3][1]), (903, [None] * bits), (904, [float("nan")] * bits)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS distance", "2 AS rank", "3 AS id")
    code = {i: [int(x is not None and x > 0) for x in v] for i, v in rows if i is not None and v is not None and len(v) == bits}
    want = set()
    for q in code:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(code[q], code[i])), i) for i in code if i != q)[:10]
            want |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near)}
    got = hamming.nearest(df, df.filter("vec_id % 20 = 0"), code_rows=100, query_rows=5)
    assert {tuple(r) for r in got.collect()} == want
    few = df.filter("vec_id < 4 and vec_id <> 1")
    assert hamming.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert hamming.nearest(df.limit(0), df.limit(0)).count() == 0


def test_each_code_is_met_once():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (50, 2), dtype=np.uint16) & np.uint16(0xF00F)
    tables, met = hamming.Tables(codes), []
    for radius in range(17):
        for j in range(2):
            met += [(int(c), int(d)) for _, cs, ds in tables.meet(codes[:1], j, radius) for c, d in zip(cs, ds)]
            covered = {c for c, d in met}
            assert {c for c in range(50) if int(np.bitwise_count(codes[c] ^ codes[0]).sum()) <= 2 * radius + j} <= covered
    assert sorted(c for c, _ in met) == list(range(50))


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            groups = brute_components(rows, 80, 5)[1].values()
            assert {r["doc_id"] for r in docs.collect()} == {min(rows[i][0] for i in g) for g in groups}
    last = corpus_pipeline.run(spark, sf)
    assert set(columns) < set(last.columns) and last.count() == counts[-1]
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0


def test_pipeline_takes_extra_columns(spark, docs):
    prose = "river stone quiet garden morning letter window travel winter market".split()
    text = lambda i: " ".join(f"The {prose[(i + j) % 10]} of {prose[(i * 3 + j * 7) % 10]} number {chr(97 + i % 26)}{chr(97 + j)} was near. " for j in range(12))
    df = docs([(i, text(i), "en", f"s{i % 3}") for i in range(40)] + [(None, None), (41, "")], {"keep": "1", "score": "2", "size": "'x'", "shard": "4", "n_words": "5", "copies": "6"})
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "/root/testdata/sf0.001")
        assert set(columns) <= set(df.columns) and (name == "sharding" or df.columns == columns)
    assert df.count() > 20


def test_pipeline_of_an_empty_table(spark, docs):
    df = docs([])
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "/root/testdata/sf0.001")
        assert df.collect() == []


def test_prefix_grams_of_sizes_that_cannot_link_do_not_travel(spark, docs):
    words = [f"w{i}" for i in range(300)]
    long = (0, " ".join(words))
    short = [(1 + i, " ".join(words[i : i + 4])) for i in range(0, 298, 2)]  # every gram of the long text is in a short one
    join = ngram_join.Join(docs([long, *short]), "doc_id", "text", 90, 3)
    assert join.prefixes().count() == 0
    near = (999, " ".join([*words[:299], "other"]))
    rows = [long, near, near, *short]
    assert ngram_join.Join(docs(rows), "doc_id", "text", 90, 3).prefixes().filter("n = 298").count() > 0
    assert result(ngram_join.join_components(docs(rows))) == brute_components(rows)[0]


def test_bands_part_no_sizes_that_may_link(spark):
    for percent in (100, 90, 80, 50):
        sizes = [*range(1, 400), 4000, 4444, 4445, 20000, 22222, 22223, 99999, 111110]
        df = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("b", ngram_join.bands_of("n", percent))
        band = {r["n"]: r["b"] for r in df.collect()}
        pairs = [(x, y) for x in sizes for y in sizes if x < y and 100 * x >= percent * y]
        assert all((band[y] - band[x]) % ngram_join.BANDS in (0, 1) for x, y in pairs)
    cases = [(2, {3, 4}), (2, {3, 5}), (2, {7}), (3, {3, 9}), (2, {0, 63}), (3, {1, 2, 9}), (2, {62, 63}), (2, {1, 63})]
    signed = lambda bands: sum(1 << b for b in bands) - (1 << 64 if 63 in bands else 0)
    rows = spark.createDataFrame([(i, k, signed(b)) for i, (k, b) in enumerate(cases)], "i int, k long, seen long")
    meet = [r["m"] for r in rows.select("i", ngram_join.meeting_bands("k", "seen").alias("m")).orderBy("i").collect()]
    assert meet == [signed(b) for b in ({3, 4}, set(), {7}, {3, 9}, {0, 63}, {1, 2}, {62, 63}, set())]


def near_copies(n, seed, unlike=0):
    """Copies of a text with one to six other words each, and as many texts of a passage with few words before it."""
    rng = random.Random(seed)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), 1 + i % 6):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows + [(n + i, " ".join([f"q{rng.randint(0, 12)}" for _ in range(rng.randint(6, 14))] + passage)) for i in range(unlike)]


@pytest.mark.parametrize("crowded, block, growth", [(32, 256, 8), (6, 4, 4)])
def test_crowds_that_meet_by_blocks_match_brute_force(docs, monkeypatch, crowded, block, growth):
    for name, value in (("CROWD", crowded), ("BLOCK", block), ("GROWTH", growth)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = [*near_copies(110, 4, 50), *((1000 + i, t) for i, t in crowd(6, 60)), *((i, t) for i, t in near_copies(12, 4))]
    got = {(repr(r["doc_id"]), r["component_id"]) for r in ngram_join.join_components(docs(rows).repartition(3), percent=80, words=5).collect()}
    assert got == {(i, c) for i, _, c in brute_components(rows, 80, 5)[0]}


def test_a_crowd_of_near_copies_gives_few_candidates(docs, monkeypatch):
    """Copies that are too far from one another to link are not verified against all the others."""
    rows, asked, verified = near_copies(300, 9), [], ngram_join.Join.verified

    def counted(self, candidates):
        asked.append(candidates.count())
        return verified(self, candidates)

    monkeypatch.setattr(ngram_join.Join, "verified", counted)
    got = result(ngram_join.join_components(docs(rows), percent=80, words=5))
    assert got == brute_components(rows, 80, 5)[0]
    assert sum(asked[1:]) < 2 * len(rows)  # the first round has at most a pair per prefix gram and class


def test_parity_maps_never_tell_more_than_sets_have_apart(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    whole = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    sets = [np.sort(whole[a:b]) for a, b in ((0, 0), (0, 1), (3, 40), (0, 60), (2, 68), (50, 220), (0, 300), (0, 2000), (100, 2500), (0, 9000))]
    n = np.array([len(x) for x in sets])
    maps = ngram_join.parity_maps(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets)).tolist()
    join = ngram_join.Join.__new__(ngram_join.Join)
    pairs = [(i, j, len(sets[i]), len(sets[j]), *maps[i], *maps[j]) for i in range(len(sets)) for j in range(len(sets))]
    df = spark.createDataFrame(pairs, ", ".join(["i int", "j int", "nx long", "ny long", *(f"{q}{side} long" for side in "xy" for q in ngram_join.PARITY)]))
    for join.percent in (50, 80, 90, 100):
        fit = {(r["i"], r["j"]) for r in df.filter(join.parities_fit("nx", "ny", "x", "y")).collect()}
        link = {(i, j) for i, j, *_ in pairs if (k := len(np.intersect1d(sets[i], sets[j]))) * 100 >= join.percent * (len(sets[i]) + len(sets[j]) - k)}
        assert link <= fit and (join.percent < 80 or (3, 5) not in fit)
