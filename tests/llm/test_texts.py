"""Quality (1), language (2), licences (4), decontamination (5), LM scoring (9) and toxicity (10)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from plumbline.llm import context_mixing, decontaminate, language, licences, quality, toxicity
from plumbline.llm.registry import load
from plumbline.llm.shared import fair_draw
from plumbline.llm.tokens import ALNUM, NOT_SPACE, hash_spans, word_spans

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (3, "  \n\t "), (4, "é"), (None, "all rights reserved"), (5, "w" * 30000), (6, "a b " * 4000), (7, "?!")]


def words(text, pattern=rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").encode().lower())


def test_spans_follow_the_word_patterns():
    texts = ["", "Äb c,d\x0b\x1f", " x", "y ", "0A-b", " z", "q"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for kind, pattern in ((ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NOT_SPACE, rb"[^\x20\x09-\x0D]+")):
        starts, stops, first = word_spans(data, rows, kind)
        got = [bytes(data[a:b]).lower() for a, b in zip(starts, stops)]
        assert got == [w for t in texts for w in words(t, pattern)]
        assert np.diff(first).tolist() == [len(words(t, pattern)) for t in texts]
    h = hash_spans(np.frombuffer(b"abc ABC abd", np.uint8), np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[1] != h[2]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


# quality


def test_quality_agrees_with_labels(tables):
    documents, _, labels = tables
    out = {r["doc_id"]: r for r in quality.classify(documents).collect()}
    known = labels.collect()
    good, bad = [out[r["doc_id"]]["keep"] for r in known if r["quality"] == 1], [out[r["doc_id"]]["keep"] for r in known if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert set(quality.reject(documents).columns) == set(documents.columns)


def test_em_finds_accuracies():
    rng, n = random.Random(3), 4000
    defect = len(quality.DEFECTS)
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.2
        rows.append(tuple([-1 if rng.random() < (0.4 if bad else 0.01) else 0 for _ in range(defect)] + [1 if rng.random() < (0.1 if bad else 0.9) else 0 for _ in range(2)] + [bad]))
    counts = Counter(r[:-1] for r in rows)
    patterns = np.array(list(counts))
    weights = np.array(list(counts.values()), float)
    good, rates = quality.em(patterns, weights)
    p = dict(zip(map(tuple, patterns.tolist()), good))
    assert sum((p[r[:-1]] < 0.5) == r[-1] for r in rows) / n > 0.95
    # with ten times the texts the start weighs less, and the rates of the simulation come out
    _, more = quality.em(patterns, weights * 10)
    assert np.abs(more[0, :defect] - 0.4).max() < 0.06 and (more[1, :defect] <= quality.MOST_FALSE).all() and abs(more[1, -1] - 0.9) < 0.05
    assert np.abs(more - rates).max() > 0


def test_em_step_against_plain_python():
    """The result is a fixed point of the two steps, written out per text."""
    rng = random.Random(5)
    k, defect = len(quality.LABELLERS), len(quality.DEFECTS)
    texts = [tuple((-1 if i < defect else 1) if rng.random() < 0.3 else 0 for i in range(k)) for _ in range(300)]
    counts = Counter(texts)
    patterns = np.array(list(counts))
    good, rates = quality.em(patterns, np.array(list(counts.values()), float), rounds=5000)
    p = dict(zip(map(tuple, patterns.tolist()), good))
    mass = [sum(1 - p[t] for t in texts), sum(p[t] for t in texts)]
    for c in (0, 1):
        for i in range(k):
            said = sum((p[t] if c else 1 - p[t]) for t in texts if t[i])
            want = (said + quality.PSEUDO_TEXTS * quality.EXPECTED[c, i]) / (mass[c] + quality.PSEUDO_TEXTS)
            assert abs(rates[c, i] - (min(want, quality.MOST_FALSE) if c and i < defect else want)) < 1e-6
    share = [(m + 1) / (sum(mass) + 2) for m in mass]
    for t in counts:
        odds = []
        for c in (0, 1):
            x = math.log(share[c])
            for i in range(k):
                x += math.log(rates[c, i]) if t[i] else math.log(1 - rates[c, i]) if i < defect else 0.0
            odds.append(x)
        assert abs(p[t] - 1 / (1 + math.exp(odds[0] - odds[1]))) < 1e-5


def test_labellers_against_plain_python(docs, tables):
    """Votes of single texts, each labeller written out."""
    rows = [(r["doc_id"], r["text"]) for r in tables[0].limit(300).collect()] + ODD + [(900, "a a a a a a a a a a a a"), (901, "x|y|z " * 12), (902, "!!! ??? ### " * 9), (903, "ABC DEF GHI JKL MNO."), (904, "one\ntwo\none\ntwo\none\ntwo\none"), (905, "Ordinary prose has words. It ends. " * 5)]
    for r in quality.label(docs(rows)).collect():
        data = (r["text"] or "").encode()
        words = [w for w in re.split(rb"[ \t-\r]+", data) if w]
        n, w = len(words), max(len(words), 1)
        lower = sum(97 <= b < 123 or b >= 128 for b in data)
        upper, digit = sum(65 <= b < 91 for b in data), sum(48 <= b < 58 for b in data)
        solid = max(1, sum(b not in (9, 10, 11, 12, 13, 32) for b in data))
        odd = [not (97 <= b < 123 or b >= 128 or 65 <= b < 91 or 48 <= b < 58 or b in (9, 10, 11, 12, 13, 32)) and chr(b) not in ".,;:'\"-()?|" for b in data]
        marks, runs = sum(odd), sum(odd[i] and i > 0 and data[i] == data[i - 1] for i in range(len(data)))
        low = [x.lower() for x in words]
        echo = sum((i > 0 and low[i] == low[i - 1]) or (i > 1 and low[i] == low[i - 2]) for i in range(n))
        lines = [x.lower() for x in re.split(rb"[\n\r]+", data) if x]
        cells, mean = data.count(b"|"), solid / w
        ended = sum(x[-1:] in (b".", b"?") for x in words)
        capital = upper / max(lower + upper, 1)
        plain = cells < 0.02 * w and echo < 0.1 * w
        want = [marks > 0.3 * w, capital > 0.5 and n >= 5, len(lines) >= 4 and 1 - len(set(lines)) / len(lines) > 0.5, runs > 0.2 * w, n >= 10 and (mean > 25 or mean < 2), n >= 10 and lower + upper < 0.5 * solid, n >= 10 and cells > 0.25 * w, n >= 10 and echo > 0.25 * w,
                plain and n >= 20 and 0.02 * w < ended < 0.4 * w, plain and n >= 5 and marks < 0.05 * w and capital < 0.2 and 3 < mean < 12]
        assert r["votes"] == "".join("0" if not x else "-" if i < 8 else "+" for i, x in enumerate(want)), (r["doc_id"], r["text"][:80])


def test_quality_odd_rows(docs):
    out = quality.classify(docs(ODD, {"keep": "'x'", "Score": "1", "votes": "2"})).collect()
    assert len(out) == len(ODD) and all(r["keep"] for r in out if not (r["text"] or "").strip())
    assert quality.classify(docs([])).collect() == [] and quality.reject(docs([])).columns == docs([]).columns
    df = docs(ODD, {"keep": "'x'"})
    assert quality.reject(df).columns == df.columns


# language


def test_language_held_out_accuracy(spark):
    p = load()[0]["op2_ppm_language"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in p if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in p)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_code_lengths_are_exact(docs):
    """The walk by arrays against prediction by partial matching written out."""
    rows = [(1, "abracadabra abra", "x"), (2, "abba baba", "x"), (3, "zyzzy zy", "y")]
    trees = language.learn(docs(rows), order=2, max_contexts=1000)
    seen = {"x": Counter(), "y": Counter()}
    for _, t, lang in rows:
        b = b"\xff\xff" + t.encode()
        for i in range(2, len(b)):
            for k in range(3):
                if 0xFF not in b[i - k : i]:
                    seen[lang][(b[i - k : i], b[i])] += 1

    kept = {c for c in {c for s in seen.values() for c, _ in s} if len(c) == 0 or sum(n for s in seen.values() for (d, _), n in s.items() if d == c) > 1}

    def cost(lang, context, byte):
        inside = {b: n for (c, b), n in seen[lang].items() if c == context} if context in kept else {}
        total, kinds = sum(inside.values()), len(inside)
        if byte in inside:
            return -math.log2(inside[byte] / (total + kinds))
        shorter = cost(lang, context[1:], byte) if context else 8.0
        return shorter - (math.log2(kinds / (total + kinds)) if kinds else 0)

    for text in ("abra", "zyq", "é abba"):
        b = text.encode()
        got = trees.lengths(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        for i, lang in enumerate(trees.langs):
            want = 0.0
            for j in range(len(b)):
                context = b[max(0, j - 2) : j]
                while context not in kept:
                    context = context[1:]
                want += cost(lang, context, b[j])
            assert got[i] == pytest.approx(want, rel=1e-5)


def test_language_odd_rows(docs):
    trees = language.learn(docs([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, "no language"), (4, None, "de")]))
    assert trees.langs == ["en", "fr"]
    out = language.predict(docs(ODD, {"score": "'s'"}), trees).collect()
    assert len(out) == len(ODD)
    for r in out:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letter and 0 <= r["score"] <= 1
    assert language.learn(docs([])) is None
    assert {r["lang_pred"] for r in language.predict(docs(ODD), None).collect()} == {"und"}
    assert language.predict(docs([]), trees).collect() == []


# licences


def brute_base(text):
    w, found = words(text), []
    for phrase, label in licences.BASE.items():
        q = [x.encode() for x in phrase.split()]
        found += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), sorted({x for _, x in found})


def test_base_phrases_match_brute_force(docs, tables):
    rng = random.Random(1)
    pool = "cc by general public license all rights reserved the x".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(200)] + ODD
    for df in (docs(rows, {"labels": "1", "spans": "2"}), tables[0]):
        for r in licences.scan(df).collect():
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(r["text"])
            assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert licences.scan(docs([])).collect() == []


def test_statistics_are_longest_matches():
    rng = random.Random(2)
    texts = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    automaton = licences.Automaton(texts)
    stream = [rng.randint(1, 4) for _ in range(400)]
    states, lengths = automaton.statistics(stream)
    for i in range(len(stream)):
        longest = max((n for n in range(1, 13) if n <= i + 1 and tuple(stream[i + 1 - n : i + 1]) in inside), default=0)
        assert lengths[i] == longest
        if longest:
            assert automaton.ends[states[i]] == {(t, e) for t, w in enumerate(texts) for e in range(longest, len(w) + 1) if w[e - longest : e] == stream[i + 1 - longest : i + 1]}


def test_changed_notice_is_found(docs):
    mit = licences.TEMPLATES["mit"][2].split()
    changed = " ".join(["foo"] * 5 + mit[:30] + ["really"] + mit[30:60] + mit[62:] + ["bar"])
    (r,) = licences.scan(docs([(1, changed)])).collect()
    (span,) = [s for s in r["spans"] if s["label"] == "mit"]
    assert span["word"] == 5 and 0.9 < span["cover"] <= 1 and r["labels"] == ["mit"]
    (r,) = licences.scan(docs([(1, " ".join(mit[:20]))])).collect()
    assert r["labels"] == [] and r["score"] < 0.8


def test_short_template_at_the_start_of_a_longer_one(docs):
    short = {"s": ["one two three"], "a": ["red green blue lake hill"], "b": ["red green blue lake hill bird fish wind rain tree house road"]}
    rows = [(1, 'Licensed under the Apache License, Version 2.0 (the "License"); see LICENSE'), (2, "red green blue lake hill bird fish"), (3, "x one two three four")]
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(docs(rows[:1])).collect() + licences.scan(docs(rows[1:]), templates=short).collect()}
    assert labels == {1: (["apache-2.0"], 1.0), 2: (["a"], 1.0), 3: (["s"], 1.0)}


def test_chains_against_all_subsets():
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(150):
        found = sorted({(rng.randrange(30), rng.randrange(25), rng.randint(1, 5)) for _ in range(rng.randint(1, 9))})
        best = 0
        for k in range(1, len(found) + 1):
            for c in combinations(found, k):
                if all(a[0] + a[2] <= b[0] <= a[0] + a[2] + licences.MAX_GAP and a[1] + a[2] <= b[1] for a, b in zip(c, c[1:])):
                    best = max(best, sum(n for _, _, n in c))
        assert licences.best_chain(found)[0] == best
        spans = licences.chains(found, 3)
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:])) and max((c for c, _, _ in spans), default=0) == (best if best >= 3 else 0)


def test_a_run_counts_once(docs):
    """Templates that repeat a run: one run of the text is not two of the template."""
    twice = {"t": ["a b c d x a b c d y"]}
    rows = [(1, "foo a b c d bar"), (2, "a b c d x a b c d y"), (3, "a b c d x a b c d y " * 3), (4, "a b c d a b c d")]
    out = {r["doc_id"]: r for r in licences.scan(docs(rows), base={}, templates=twice).collect()}
    assert [out[i]["labels"] for i in (1, 2, 3, 4)] == [[], ["t"], ["t"], ["t"]]
    assert [(s["word"], s["words"], s["cover"]) for s in out[3]["spans"]] == [(0, 10, 1.0), (10, 10, 1.0), (20, 10, 1.0)] and out[4]["spans"][0]["cover"] == 0.8


def test_matches_are_maximal_in_each_template():
    rng = random.Random(8)
    texts = {str(t): [" ".join(rng.choice("abc") for _ in range(rng.randint(2, 14)))] for t in range(7)}
    scanner = licences.Scanner({}, texts)
    for _ in range(60):
        stream = [rng.randint(1, 3) for _ in range(30)]
        matches, want = [], set()
        scanner.run(stream, 0, [], matches)
        for t, w in enumerate(scanner.texts):
            inside = {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
            longest = [max((n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in inside), default=0) for i in range(len(stream))] + [0]
            for i, n in enumerate(longest[:-1]):
                if n >= min(licences.MIN_RUN, len(w)) and longest[i + 1] <= n:
                    want |= {(t, i - n + 1, e - n, n) for e in range(n, len(w) + 1) if w[e - n : e] == stream[i - n + 1 : i + 1]}
        assert len(matches) == len(set(matches)) and set(matches) == want


# decontamination


def brute_contamination(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        q = words(t)
        k = min(13, len(q))
        for p in range(len(q) - k + 1) if q else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == q[p : p + k]:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def test_contamination_matches_brute_force(spark, docs):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 13, 14, 20])))) for i in range(12)] + [(50, None), (3, "a A a a a a a a a a a a a a a"), (60, "solo")]
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, f"x {t} y") for i, t in items if t] + ODD + [(200, "a " * 500), (201, "solo SOLO")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for chosen in (items, [x for x in items if len(words(x[1])) != 1]):
        bench = spark.createDataFrame(chosen, "item_id bigint, text string")
        for options in ({}, {"block_words": 40}):
            out = decontaminate.judge(decontaminate.find_matches(docs(rows), bench, **options)).collect()
            assert len(out) == len(rows)
            for r in out:
                n, hits, ids = brute_contamination(r["text"], chosen)
                assert (r["__dc_n_words"], r["__dc_n_hit"], r["__dc_item_ids"]) == (n, hits, ids), r
                assert r["__dc_contaminated"] == (hits > 0 and 20 * hits >= n)


def test_matches_are_longest(spark, docs):
    item = " ".join(f"w{i}" for i in range(40))
    text = "x " + " ".join(f"w{i}" for i in range(5, 30)) + " y"
    (r,) = decontaminate.find_matches(docs([(1, text)]), spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()
    assert [tuple(m) for m in r["__dc_matches"]] == [(9, 5, 1, 25)]


def test_decontaminate_keeps_columns_and_clean_rows(spark, docs):
    df = docs([(1, "a b c"), (2, "the quick fox"), (3, None)], {"n_words": "5", "contaminated": "true"})
    bench = spark.createDataFrame([(1, "quick fox")], "item_id bigint, text string")
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == 3 and decontaminate.decontaminate(df.limit(0), bench).count() == 0


# LM scoring


def test_unigram_matches_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(["The cat", "the DOG sat", "", None, "cat cat\tcat", "x"] * 6)] + ODD
    df = docs(rows, {"score": "1"})
    out = context_mixing.score(df, df.filter("doc_id % 3 <> 0")).collect()
    c = Counter(w for i, t in rows if i is not None and i % 3 for w in [*words(t, rb"[^\x20\x09-\x0D]+"), None])
    total, kinds = sum(c.values()), len(c)
    assert len(out) == len(rows) and "text" not in out[0].asDict()
    want = sorted((repr(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), total, round(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in [*w, None]), 6)) for i, t in rows for w in [words(t, rb"[^\x20\x09-\x0D]+")])
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)


def test_model_is_a_distribution_and_learns(docs):
    rows = [(i, "the cat sat on the mat. ") for i in range(50)]
    model = context_mixing.learn(context_mixing.count(docs(rows)))
    data = np.frombuffer(b"the ca", np.uint8)
    code = context_mixing.windows(data, np.array([0, 6]))[-1:]
    every = (code & ~np.uint32(0xFF)) | np.arange(256, dtype=np.uint32)
    assert np.exp2(-model.bits(every)).sum() == pytest.approx(1.0, abs=1e-6)
    cost = lambda t: context_mixing.Scorer(model)(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] / len(t)
    assert cost(b"the cat sat on the mat. ") < 1.2 < 3 < cost(b"zq!zq!zq!zq!zq!zq!zq!zq!")


def test_scores_against_the_model_written_out(docs):
    """Code lengths symbol by symbol and bit by bit, from slot counts that are counted here; frozen or not."""
    rows = [(i, t) for i, t in enumerate(["the cat sat.", "the mat", "a cat\nand the hat", "Caf\u00e9 the end"])]
    model = context_mixing.learn(context_mixing.count(docs(rows)))
    tables, counts = model.tables, {}

    def symbols(text):
        data = list((text or "").encode()) + [context_mixing.PAD]
        for i, b in enumerate(data):
            before = [data[i - k] if i >= k else context_mixing.PAD for k in (1, 2, 3)]
            start = max([j + 1 for j in range(i) if data[j] in (9, 10, 11, 12, 13, 32)], default=0)
            word = bytes(data[start:i])
            h = int(hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) >> 32 if word else int(hash_spans(np.zeros(1, np.uint8), np.array([0]), np.array([0]))[0]) >> 32
            yield b, before, h

    def slots(b, before, h, bit):
        so_far = (1 << bit) | (b >> (8 - bit))
        one = lambda x, k: int(context_mixing.mix64(np.array([x], np.uint64))[0]) >> (64 - tables.bits[k])
        keys = {2: before[0] | before[1] << 8, 3: before[0] | before[1] << 8 | before[2] << 16, 4: h}
        hashed = [int(tables.begin[k]) + (one(x | k << 40, k) ^ int(tables.step[k][so_far])) for k, x in keys.items()]
        return [so_far, int(tables.begin[1]) + (before[0] << 8 | so_far), *hashed], so_far, b >> (7 - bit) & 1

    for _, text in rows:
        for b, before, h in symbols(text):
            for bit in range(8):
                at, _, value = slots(b, before, h, bit)
                for a in at:
                    counts.setdefault(a, [0, 0])[value] += 1
    for _, text in [*rows, (9, "the dog sat"), (10, "")]:
        bits = 0.0
        for b, before, h in symbols(text):
            for bit in range(8):
                at, so_far, value = slots(b, before, h, bit)
                seen = [counts.get(a, [0, 0]) for a in at]
                level = [sum(sum(c) > x for x in context_mixing.CONFIDENCE) for c in seen[3:]]
                w = model.weights[bit * 25 + level[1] * 5 + level[0]]
                z = min(8.0, max(-8.0, float(w[-1]) + sum(float(w[k]) * math.log((c[1] + 0.4) / (c[0] + 0.4)) for k, c in enumerate(seen))))
                t = (z + 8) * (context_mixing.KNOTS - 1) / 16
                k = min(int(t), context_mixing.KNOTS - 2)
                curve = model.map[so_far]
                p = 0.5 * (curve[k] * (1 - t + k) + curve[k + 1] * (t - k)) + 0.5 / (1 + math.exp(-z))
                p = min(1 - 1e-6, max(1e-6, p))
                bits -= math.log2(p if value else 1 - p)
        data = np.frombuffer((text or "").encode(), np.uint8)
        assert context_mixing.Scorer(model)(data, np.array([0, len(data)]))[0] == pytest.approx(bits, rel=1e-4)


def test_common_words_keep_the_most_frequent():
    rng = np.random.default_rng(2)
    hashes, n = rng.integers(1, 1 << 63, 50_000, dtype=np.uint64), rng.integers(1, 1000, 50_000)
    table = context_mixing.CommonWords(hashes, n)
    found = table(hashes)
    assert ((found == n) | (found == 0)).all() and (found > 0).mean() > 0.99
    assert (table(rng.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64)) == 0).all()


def test_scores_do_not_depend_on_the_cache():
    rng = np.random.default_rng(1)
    tables = context_mixing.Tables(1 << 16)
    model = context_mixing.Model(tables, rng.integers(0, 9, tables.begin[-1]), rng.integers(0, 9, tables.begin[-1]))
    scorer, texts = context_mixing.Scorer(model), [bytes(rng.integers(32, 127, 3000, dtype=np.uint8)) for _ in range(4)]
    for t in texts + texts:
        data, rows = context_mixing.end_marked(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert scorer(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] == pytest.approx(model.bits(context_mixing.windows(data, rows)).sum(), rel=1e-5)


def test_scoring_without_training(docs):
    out = context_mixing.score(docs([(1, "ab"), (2, None)]), docs([])).orderBy("doc_id").collect()
    assert [r["train_tokens"] for r in out] == [0, 0] and [r["base_score"] for r in out] == [0, 0]
    assert [round(r["score"] / -math.log10(2)) for r in out] == [24, 8]
    assert context_mixing.score(docs([]), docs([])).collect() == []


def test_word_so_far_predicts_beyond_three_bytes():
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["xxabcdeQ", "yyabcdeR"]) for _ in range(40))
    counted = pa.Table.from_batches(context_mixing.count_all("text")(iter([pa.record_batch([pa.array([text() for _ in range(60)])], ["text"])])))
    seen = counted.filter(pa.compute.equal(counted.column("kind"), 1)).combine_chunks().to_batches()
    tables = context_mixing.Tables(sum(b.num_rows for b in seen))
    found = pa.Table.from_batches(context_mixing.count_slots(tables)(iter(seen)))
    zeros, ones = np.zeros(tables.begin[-1]), np.zeros(tables.begin[-1])
    np.add.at(zeros, found.column("slot").to_numpy(), found.column("zeros").to_numpy())
    np.add.at(ones, found.column("slot").to_numpy(), found.column("ones").to_numpy())
    scorer = context_mixing.Scorer(context_mixing.Model(tables, zeros, ones))
    cost = lambda t: scorer(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    assert cost(b"xxabcdeQ") + 1 < cost(b"xxabcdeR") and cost(b"yyabcdeR") + 1 < cost(b"yyabcdeQ")


# toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in load()[0]["op10_pu_toxicity"](spark, sf).collect()}
    known = [(r["toxic"], out[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    assert sum(t == p for t, p in known) >= 0.93 * len(known)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in out.values())


def test_pu_risk_ignores_zero_labels(docs):
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice("red green blue tree house road".split()) for _ in range(20))
    rows = [(i, clean() + (" vile" if i % 4 == 0 else ""), None, None) for i in range(400)]
    df = docs(rows).withColumn("toxic", F.expr("CASE WHEN doc_id % 8 = 0 THEN 1 WHEN doc_id % 8 IN (1, 2, 3) THEN 0 END"))
    out = toxicity.score(docs(rows), toxicity.learn(df)).collect()
    assert all((r["predicted"] == 1) == ("vile" in r["text"]) for r in out)


def test_pu_risk_against_finite_differences():
    from plumbline.llm import linear

    rng = np.random.default_rng(4)
    dense = rng.integers(0, 2, (40, 6)).astype(float)
    positive = np.arange(40) >= 28
    prior = 0.2
    first = np.concatenate([[0], np.cumsum(dense.sum(1).astype(int))])
    x = linear.Rows(first, np.concatenate([np.flatnonzero(r) for r in dense]), np.ones(first[-1]), 6)

    def risk(both):
        z = dense @ both[:-1] + both[-1]
        negative = np.logaddexp(0, z)
        rest = negative[~positive].mean() - prior * negative[positive].mean()
        return prior * np.logaddexp(0, -z[positive]).mean() + max(rest, 0.0), rest

    start = np.zeros(7)
    start[-1] = np.log(prior / (1 - prior))
    slope = np.array([(risk(start + e)[0] - risk(start - e)[0]) / 2e-6 for e in np.eye(7) * 1e-6])
    weights, intercept = linear.fit_nonnegative_pu(x, positive, prior, l2=0.0, rounds=1)
    moved = np.append(weights, intercept) - start
    known = np.abs(slope) > 1e-6
    assert known.sum() >= 5 and (np.sign(moved[known]) == -np.sign(slope[known])).all()
    weights, intercept = linear.fit_nonnegative_pu(x, positive, prior, l2=0.0)
    end, rest = risk(np.append(weights, intercept))
    assert end < risk(start)[0] and rest > -0.05  # the part that unlabelled rows leave does not run below zero


def test_toxicity_odd_rows(docs):
    df = docs(ODD, {"predicted": "'p'", "SCORE": "2"})
    model = toxicity.learn(docs(ODD).withColumn("toxic", F.lit(None).cast("int")))
    out = toxicity.score(df, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in out)
    assert toxicity.score(docs([]), model).collect() == []


# fair samples


def test_draws_have_the_exact_size_and_fair_shares(spark):
    rows = [(i, 1) for i in range(3000)] + [(10_000, 2000), (10_001, 1), (10_002, 0)]
    counted = spark.createDataFrame(rows, "h long, n long")
    draws = fair_draw(counted, "h", "n", 500)
    assert sum(draws.values()) == 500 and abs(draws[10_000] - 500 * 2000 / 5001) <= 1 and max(n for h, n in draws.items() if h != 10_000) == 1
    assert draws == fair_draw(counted.repartition(7), "h", "n", 500)
    assert fair_draw(counted, "h", "n", 6000) == {h: n for h, n in rows if n} and fair_draw(counted.limit(0), "h", "n", 5) == {}
    assert len(fair_draw(counted, "h", "n", 1)) == 1


def test_empty_texts_and_copies_do_not_crowd_out_the_sample(docs):
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice("red green blue tree house road lake hill bird fish wind rain".split()) for _ in range(6))
    rows = [(i, clean() + (" vile" if i % 20 == 0 else "")) for i in range(2000)] + [(3000 + i, [None, "", " ?"][i % 3]) for i in range(4000)] + [(9000 + i, "copy of one text") for i in range(2000)]
    df = docs(rows).withColumn("toxic", F.expr("CASE WHEN doc_id < 2000 AND doc_id % 40 = 0 THEN 1 WHEN doc_id % 40 IN (1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 0 END"))
    model = toxicity.learn(df, most_positive=50, most_unlabelled=400)
    out = toxicity.score(docs(rows), model).collect()
    assert all((r["predicted"] == 1) == ("vile" in (r["text"] or "")) for r in out)
    assert np.flatnonzero(model.weights).size == 1
    assert toxicity.learn(df, most_positive=1, most_unlabelled=5).intercept  # one positive stays


def test_language_with_few_long_texts_stays(docs):
    rows = [(i, "the cat sat on the mat " * 500, "en") for i in range(30)] + [(50 + i, f"le chat {i} noir " * 900, "fr") for i in range(5)]
    assert language.learn(docs(rows), sample_bytes=20).langs == ["en", "fr"]


def test_quality_sample_is_not_of_empty_texts(docs, monkeypatch):
    rng, sizes = random.Random(4), []
    prose = lambda: " ".join(rng.sample([f"bird{c}" for c in "abcdefghijklmnopqrstuvwxyz"], 24)) + "."
    rows = [(i, prose()) for i in range(300)] + [(400 + i, "".join(rng.choice("#$%&*@!") for _ in range(200)) + " x") for i in range(60)] + [(1000 + i, None) for i in range(3000)]
    fit = quality.fit_logistic
    monkeypatch.setattr(quality, "fit_logistic", lambda x, goal: sizes.append(len(goal)) or fit(x, goal))
    out = quality.classify(docs(rows), quality.learn(docs(rows), most_sample=100)).collect()
    assert all(r["keep"] == (r["doc_id"] < 400 or r["doc_id"] >= 1000) for r in out)
    assert sizes == [100]


def test_quality_sample_takes_one_python_process_a_task(spark):
    rows = [(f"word{i} the and of it is a text {i}. " * (1 + i % 3), i) for i in range(20)]
    sample = spark.createDataFrame(rows, "__ql_text string, __ql_digest long")
    out = quality.described(sample)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    votes = {r["__ql_digest"]: r["votes"] for r in quality.label(sample, "__ql_text").collect()}
    assert {r["digest"]: r["votes"] for r in out.collect()} == votes
