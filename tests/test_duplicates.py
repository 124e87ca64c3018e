import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import similarity as S
from plumbline.operators import duplicates as D, fuzzy as Z, profile as P


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "hot", "x") for i in range(150)] + [(200, None, None), (201, None, None), (202, "1", None), (203, None, "1"), (204, "1", None), (205, "z", "z")]
    return spark.createDataFrame(data, "rid bigint, k string, v string")


def test_exact_groups(rows):
    groups = {}
    for r in D.exact_groups(rows, "rid", ["k", "v"]).collect():
        groups.setdefault(r["group_id"], []).append(r["row_id"])
    assert sorted(len(g) for g in groups.values()) == [2, 150] and sorted(groups[202]) == [202, 204]


def test_resolution_never_adds_rows(rows):
    groups = D.exact_groups(rows, "rid", ["k", "v"])
    sizes = {s: D.resolve(rows, "rid", groups, s).count() for s in ("keep_first", "keep_last", "merge")}
    assert set(sizes.values()) == {rows.count() - 150}
    kept = D.resolve(rows, "rid", groups, "keep_multiple", positions=[1, 3]).filter("k = 'hot'")
    assert [r["rid"] for r in kept.orderBy("rid").collect()] == [1, 3]


def test_merge_fills_gaps(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (2, "a", "x", 6), (3, "a", "y", None), (4, "b", None, None)], "rid bigint, k string, s string, n int")
    merged = D.resolve(df, "rid", D.exact_groups(df, "rid", ["k"]), "merge")
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", "x", 5), (4, "b", None, None)]


def brute_tiers(data, columns):
    hollow = {"", "NULL", "NONE", "NA", "N/A", "NAN", "BLANK", "-", "--", "---"}
    real = lambda v: v is not None and v.strip().upper() not in hollow
    from itertools import combinations

    tiers = [(c,) for c in columns] + list(combinations(columns, 2)) + list(combinations(columns, 3)) + [tuple(columns)]
    found = {}
    for tier in tiers:
        for rid, row in data.items():
            same = [r for r in data.values() if all(r[c] == row[c] for c in tier)]
            if rid not in found and len(same) > 1 and all(real(row[c]) for c in tier):
                found[rid] = ", ".join(tier)
    return found


def test_tiers_match_the_full_search(spark):
    rng = random.Random(2)
    pick = lambda: rng.choice(["a", "b", "c", "d", "e", "f", "-", "n/a", None])
    data = {i: {"vendor_name": pick(), "email": pick() and f"m{rng.randrange(9)}", "note": pick()} for i in range(14)}
    df = spark.createDataFrame([(i, *r.values()) for i, r in data.items()], "vid bigint, vendor_name string, email string, note string")
    roles = spark.createDataFrame(
        [(0, "vid", "unique_identifiers"), (1, "vendor_name", "critical_business"), (2, "email", "critical_business"), (3, "note", "descriptive")],
        "position int, column string, category string",
    )
    got = {r["vid"]: r["matched_fields"] for r in D.tiered(df, "vid", roles).collect()}
    assert got == brute_tiers(data, ["vendor_name", "email", "note"])


def test_match_rules_fall_back(spark):
    df = spark.createDataFrame([(1, 1.5), (2, 2.5)], "id bigint, x double")
    rules = D.suggest_match_rules(P.profile(df, samples=False)).collect()
    assert [(r["rule_no"], r["rationale"]) for r in rules] == [("R01", "Default fallback rule")]


def brute_groups(values, algorithm, threshold):
    score = {"ratio": S.indel, "difflib": S.sequence_matcher, "jaro_winkler": S.jaro_winkler}[algorithm]
    claimed, groups = set(), {}
    for i, a in enumerate(values):
        if i in claimed or not a:
            continue
        members = [j for j in range(i + 1, len(values)) if j not in claimed and values[j] and score(a, values[j]) >= threshold]
        if members:
            claimed.update([i, *members])
            groups[i] = [i, *members]
    return groups


def names():
    rng = random.Random(7)
    words = ["acme", "global", "trading", "co", "north", "data", "river", "labs"]
    out = []
    for _ in range(80):
        w = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        p = rng.randrange(len(w))
        out.append(w if rng.random() < 0.5 else w[:p] + rng.choice("xyz") + w[p + 1 :])
    return out + ["a", "ab", "ba", "abc", "...", "", "É cole", "ecole"] + [f"Customer#{i:05d}" for i in range(40)]


@pytest.mark.parametrize(("algorithm", "threshold", "depth"), [("ratio", 85, None), ("ratio", 85, 3), ("ratio", 70, None), ("jaro_winkler", 90, None), ("jaro_winkler", 85, 20), ("difflib", 80, None)])
def test_fuzzy_groups_match_brute_force(spark, monkeypatch, algorithm, threshold, depth):
    if depth:  # few texts of a token meet in a round
        monkeypatch.setattr(Z, "MAX_PAIRS", 0)
        monkeypatch.setattr(Z, "PAIRS_PER_TEXT", 0)
        monkeypatch.setattr(Z, "DEPTHS", [depth, 1000])
    df = spark.createDataFrame(list(enumerate(names())), "rid bigint, name string")
    plain = [r[0] for r in df.orderBy("rid").select(S.normalize(F.col("name"))).collect()]
    got = {}
    for r in Z.fuzzy_groups(df, "name", "rid", threshold, algorithm).collect():
        got.setdefault(r["group_id"], []).append(r["row_id"])
    assert {k: sorted(v) for k, v in got.items()} == brute_groups(plain, algorithm, threshold)


@pytest.mark.parametrize(("heads", "most", "cheap", "rows"), [([3, 12], 2, 1, 4), ([1], 100, 8, 100), ([50], 1, 1000, 7)])
def test_peeled_groups_match_brute_force(spark, monkeypatch, heads, most, cheap, rows):
    """Any size of the batches, also with texts beyond a machine word, and rest for the tokens."""
    for name, v in (("HEADS", heads), ("MOST_LEADERS", most), ("CHEAP", cheap), ("SLICE_ROWS", rows), ("LONG_SHARE", 1)):
        monkeypatch.setattr(Z, name, v)
    values = names()[::2] + ["river data " * 7 + x for x in ("", "xyz", "north labs global co", "\u00fc")] + [f"Customer#{i * 37:09d}" for i in range(60)]
    df = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(values)], "rid bigint, half int, name string").repartition(3)
    plain = [r[0] for r in df.orderBy("rid").select(S.normalize(F.col("name"))).collect()]
    got, halves = {}, {}
    for r in Z.fuzzy_groups(df, "name", "rid", 80).collect():
        got.setdefault(r["group_id"], []).append(r["row_id"])
    assert {k: sorted(v) for k, v in got.items()} == brute_groups(plain, "ratio", 80)
    for r in Z.combined_groups(df, ["half"], ["name"], "rid", 80).collect():
        halves.setdefault(int(r["group_id"].split(":")[1]), []).append(r["row_id"])
    want = {}
    for h in (0, 1):
        want |= {2 * k + h: [2 * i + h for i in v] for k, v in brute_groups(plain[h::2], "ratio", 80).items()}
    assert {k: sorted(v) for k, v in halves.items()} == want


def test_crowds_do_not_meet_at_tokens(spark, monkeypatch):
    """Names that are all alike are settled by their few leaders, a batch of them at a time."""
    monkeypatch.setattr(Z, "CHEAP", 64)
    monkeypatch.setattr(Z, "HEADS", [16])
    nodes = spark.range(1500).selectExpr("0 AS block", "id", "format_string('customer%09d', id) AS text")
    settled, rest = Z.peeled(nodes, 85)
    assert rest is None and sum(s.count() for s in settled) == 1500


def test_one_text_against_many_scores_as_pairs_do():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 \u00fc\U0001f600") for _ in range(rng.choice([0, 1, 5, 9, 63, 64, 65, 130]))) for _ in range(150)]
    many = S.Texts(texts)
    for k, t in enumerate(texts):
        for threshold in (60, 85, 100):
            assert sorted(many.reaching(many, k, threshold).tolist()) == [i for i, u in enumerate(texts) if S.indel(t, u) >= threshold]


def test_no_similar_pair_is_lost():
    """Every pair of random texts that is similar shares a token, and its signatures overlap enough."""
    rng = random.Random(5)
    texts = list({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 18))) for _ in range(250)} | {"abcdef" * k for k in range(1, 9)})
    scores = {"ratio": S.indel, "jaro_winkler": S.jaro_winkler}
    for algorithm, threshold in (("ratio", 85), ("ratio", 60), ("jaro_winkler", 85), ("jaro_winkler", 70)):
        f = Z.TokenFilter(algorithm, threshold)
        bands = sorted({f.band(len(t)) for t in texts})
        import pandas as pd

        made = Z._token_udf(f, {"a": 9, "ab": 3}, bands).func(pd.Series(texts))
        tokens = [set(x) for x in made["tokens"]]
        for i, a in enumerate(texts):
            for j in range(i):
                if scores[algorithm](a, texts[j]) >= threshold:
                    assert tokens[i] & tokens[j], (algorithm, threshold, a, texts[j])
                    both = sum(((int(made[c][i]) & int(made[c][j])) % (1 << 64)).bit_count() for c in Z.SIGNATURE[:4]) + min(made["more"][i], made["more"][j])
                    assert both >= (Counter(a) & Counter(texts[j])).total()


def test_phonetic_grades():
    from plumbline.functions import phonetic

    assert phonetic.encode("Smith") == ("SM0", "SMT") and phonetic.encode("Schmidt") == ("XMT", "SKMT")
    assert [phonetic.grade(a, b) for a, b in (("philip", "filip"), ("thomas", "tomas"), ("jose", "hose"), ("jose", "joseph"), ("knight", "night"), ("church", "kirk"))] == [100, 85, 85, 0, 100, 85]
    assert phonetic.grade("catherine", "kathryn") == 100 and phonetic.grade("jan chen", "han chen") == 70 and phonetic.grade("12", "34") == 100
    assert phonetic.grade("jan", "hat") == 0 and phonetic.grade("thomas jo", "tomas ho") == 85 and phonetic.grade("zoe", "soe") == 100


def test_leader_order_matters_in_chains(spark):
    # a~b and b~c but not a~c: b follows a, c stays alone.
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefxy"), (3, "abcdwzxy")], "rid bigint, name string")
    got = Z.fuzzy_groups(df, "name", "rid", 75).select("group_id", "row_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (1, 2)]


def test_combined_groups_stay_inside_their_key(spark):
    df = spark.createDataFrame([(1, "x", "acme ltd"), (2, "y", "acme ltd"), (3, "x", "acme lt"), (4, "y", "other")], "rid bigint, k string, name string")
    got = Z.combined_groups(df, ["k"], ["name"], "rid").collect()
    assert sorted(r["row_id"] for r in got) == [1, 3] and got[0]["match_type"] == "combined"


def test_combined_score_and_phonetic_groups_match_all_pairs(spark):
    df = spark.createDataFrame(list(enumerate(n for n in names()[:45] if len(n) > 1)), "rid bigint, name string")
    plain = df.select("rid", S.normalize(F.col("name")).alias("t")).filter("t <> ''")
    a, b = plain.toDF("l", "lt"), plain.toDF("r", "rt")
    for algorithm, threshold in (("combined", 80), ("phonetic", 100)):
        near = {
            (r["l"], r["r"])
            for r in a.crossJoin(b).filter("l < r").filter(S.score(algorithm, F.col("lt"), F.col("rt")) >= threshold).collect()
        }
        claimed, groups = set(), {}
        ids = [r[0] for r in plain.select("rid").orderBy("rid").collect()]
        for i in ids:
            members = [] if i in claimed else [j for j in ids if (i, j) in near and j not in claimed]
            if members:
                claimed.update([i, *members])
                groups[i] = [i, *members]
        got = {}
        for r in Z.fuzzy_groups(df, "name", "rid", threshold, algorithm).collect():
            got.setdefault(r["group_id"], []).append(r["row_id"])
        assert {k: sorted(v) for k, v in got.items()} == groups
