"""Merkle manifest (11), chat formatting (12) and embedding whitening (13)."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, merkle, whitening


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """All levels of the tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        lo = at - at % 3
        out += [h for i, h in enumerate(level[lo : lo + 3], lo) if i != at]
        at //= 3
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows (doc_id, source, leaf)."""
    by = defaultdict(list)
    for doc, source, leaf in rows:
        by[source].append((doc is not None, doc if doc is not None else 0, leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (known, doc, leaf) in enumerate(sorted(by[s])):
            out.append((doc if known else None, leaf, trees[s][-1][0], top[-1][0], H(*siblings(trees[s], i), *siblings(top, j))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_brute_force(spark, levels):
    rows = [(i * 37 % 101, f"s{i % 3}" if i % 4 else "hot") for i in range(90)] + [(None, None), (None, None), (5, None), (5, "é"), (5, "z"), (5, "z"), (5, "")] + [(7, "hot")] * 10
    leaves = spark.createDataFrame([(d, s, H(str(d), str(s))) for d, s in rows], "doc_id bigint, source string, leaf string").withColumn("path", F.lit("mine")).withColumn("h", F.lit(1)).repartition(5)
    out = merkle.manifest(leaves, "doc_id", "source", carried=["h"], levels=levels)
    got = out.withColumns({"proof": merkle.proof(F.col("path")), "back": merkle.folded(F.col("leaf"), F.col("path"))}).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got), key=repr) == brute([(d, s, H(str(d), str(s))) for d, s in rows])
    assert all(r["back"] == r["root"] and r["h"] == 1 for r in got)
    places = defaultdict(list)
    for r in got:
        places[r["source"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_manifest_small_and_empty(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, source string, leaf string")
    assert merkle.manifest(make([]), "doc_id", "source").collect() == []
    one = merkle.manifest(make([(1, "a", "ff")]), "doc_id", "source").first()
    assert (one["leaf"], one["subroot"], one["root"], one["path"]) == ("ff", "ff", "ff", [])


def test_leaf_encoding(spark):
    rows = [(1, "s", "en", 3, "a\nb"), (None, None, None, None, None), (2, "é", "", -7, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = [r[0] for r in df.select(merkle.digest(*(merkle.framed(F.col(c)) for c in merkle.FIELDS))).collect()]
    assert got == [leaf_of(r) for r in rows]


CHATS = "conv_id bigint, turn bigint, role string, text string"
HARD = ["", None, "\\", "\\b", "\\\\h### ", "</turn>", "</turn>\n", "### user: x</turn>\n### assistant: y", "</part>", "<</part>>", "a\\t</tu", "####  ### ", "é🙂\u0000", "line\nline"]


def told(rows):
    """Turns and loss text of conversations, straight from the rows."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: ([(x[2], x[3]) for x in sorted(v)], "".join(x[3] for x in sorted(v) if x[2] == "assistant")) for c, v in by.items()}


@pytest.mark.parametrize("turns", [2, 128])
@pytest.mark.parametrize("most_long", [0, 1 << 17])
def test_chats_read_back(spark, monkeypatch, turns, most_long):
    monkeypatch.setattr(chat, "MOST_LONG", most_long)
    roles = ["user", "assistant", "assistant", "system", None, "### odd: role</turn>\n"]
    rows = [(1, i, roles[i * 7 % 6], t) for i, t in enumerate(HARD)] + [(2, i, "assistant", t) for i, t in enumerate(HARD)] + [(3, 0, "user", "x")] * 3 + [(None, None, "user", "z"), (None, None, None, None), (4, 9, "assistant", "w " * 50_000)]
    df = spark.createDataFrame(rows, CHATS).repartition(3).selectExpr("*", "1 AS part", "'x' AS formatted")
    out = chat.format_chats(df, turns=turns)
    back = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in chat.read_back(out).collect()}
    assert back == told(rows)
    for r in out.collect():
        assert "".join(p["text"] for p in r["parts"]) == r["formatted"] and r["formatted"].startswith("### ") and r["formatted"].endswith("</turn>\n")
        assert r["n_turns"] == sum(x[0] == r["conv_id"] for x in rows)
        # neighbours of one role share one block; texts hold no control string
        said = told(rows)[r["conv_id"]][0]
        assert r["formatted"].count("</turn>") == sum(i == 0 or said[i - 1][0] != s[0] for i, s in enumerate(said))


def test_chats_empty_and_native(spark):
    df = chat.read_back(chat.format_chats(spark.createDataFrame([], CHATS)))
    assert df.collect() == []
    plan = chat.read_back(chat.format_chats(spark.createDataFrame([], CHATS).limit(0)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 33):
        for case in range(24):
            a = np.round(rng.normal(size=(d, d))) if case % 3 == 2 else rng.normal(size=(d, d))
            a[:, : d // 2] *= case % 3 != 1
            values, basis = np.linalg.eigh(a @ a.T) if case % 5 else (np.zeros(d), np.eye(d))
            values = np.maximum(values, 0)
            v = basis[:, 0] * 3 if case % 7 == 3 else np.round(rng.normal(size=d)) if case % 4 == 1 else rng.normal(size=d)
            goal = basis @ np.diag(values) @ basis.T + np.outer(v, v)
            values, basis = whitening.rank_one(values, basis, v)
            assert np.abs(basis @ np.diag(values) @ basis.T - goal).max() <= 1e-12 * max(1e-300, np.abs(goal).max())
            assert np.abs(basis.T @ basis - np.eye(d)).max() < 1e-12 and (np.diff(values) >= -1e-12).all()


def test_spectra_of_blocks_and_single_vectors_agree():
    x = np.round(np.random.default_rng(2).normal(size=(150, 9)) * 20)
    goal = (x - x.mean(0)).T @ (x - x.mean(0))
    for block in (1, 40, 150):
        parts = []
        for part in (x[:70], x[70:71], x[71:]):
            s = whitening.Spectrum(9)
            for i in range(0, len(part), block):
                s.add(part[i : i + block])
            parts.append(s)
        for other in parts[1:]:
            parts[0].merge(other)
        s = parts[0]
        assert s.n == 150 and np.allclose(s.mean, x.mean(0)) and np.abs(s.basis @ np.diag(s.values) @ s.basis.T - goal).max() < 1e-10 * goal.max()


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(120, 20)) @ rng.normal(size=(20, 20)) * 0.3).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(60)]
    odd = [(2000, None), (2001, [None] + [0.0] * 19), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, [1.0]), (2005, []), (None, v[1].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(7).selectExpr("*", "'a' AS x", "1 AS n")
    out = whitening.whiten(df, block_rows=16).collect()
    x = np.floor(64 * v.astype(float)).astype(int) + 1_000_000
    n, sums = 120, x.sum(0)
    values, axes = np.linalg.eigh(np.cov((x - 1_000_000).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(out) == 181 * 16 and {r["n"] for r in out} == {n} and len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9
    goal = (x - x.mean(0)) @ axes / np.sqrt(values)
    signs = {}
    for r in out:
        i = 1 if r["vec_id"] is None else r["vec_id"] if r["vec_id"] < 1000 else 0
        k = r["component"] - 1
        assert r["deviation"] == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[i], sums))
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(goal[i, k]), abs=1e-7)
        if abs(goal[i, k]) > 1e-3:
            assert signs.setdefault(k, math.copysign(1, r["whitened"] * goal[i, k])) == math.copysign(1, r["whitened"] * goal[i, k])


def test_whitening_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([(1, None), (2, [])])).collect() == []
    same = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 for r in same)
    flat = whitening.whiten(make([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [1e300, 5.0])])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)} and max(r["identity_error"] for r in flat) < 1e-4
    long_ = whitening.whiten(make([(i, [math.sin(i * j) for j in range(1, 131)]) for i in range(40)])).collect()
    assert len(long_) == 40 * 16 and max(r["identity_error"] for r in long_) < 1e-6
