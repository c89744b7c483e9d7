"""Near-duplicates by odd sketches against the similarity of all pairs in plain Python."""

import random

import numpy as np
import pandas as pd
import pytest

from gridwash.llm import oddsketch


def plain_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i:i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} if words else set()


def plain(rows):
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and sets[i] and sets[j]:
                small, large = sorted((len(sets[i]), len(sets[j])))
                if 5 * small >= 4 * large and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        best = min(ids, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), best, doc == best))
    return sorted(out, key=str)


def changed(rnd, words, times):
    out = list(words)
    for at in rnd.sample(range(len(out)), times):
        out[at] = f"new{rnd.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    rows = []
    for size in (2, 3, 5, 9, 10, 11, 20, 21, 60, 200, 700):  # around the threshold at every size: a change takes two shingles
        for share in (0.04, 0.05, 0.055, 0.06, 0.07, 0.1):
            words = [f"w{rnd.randrange(10**9)}" for _ in range(size)]
            rows += [" ".join(words), changed(rnd, words, max(1, round(size * share)))]
    base = [f"b{i}" for i in range(150)]
    rows += [changed(rnd, base, 3) for _ in range(120)]  # all near each other
    other = [f"c{i}" for i in range(150)]
    rows += [changed(rnd, other, 9) for _ in range(80)]  # near the original, mostly not near each other
    rows += [" ".join(other)]
    line = " ".join(f"line{i}" for i in range(60))
    rows += [line + " " + " ".join(f"u{rnd.randrange(10**9)}" for _ in range(20)) for _ in range(60)]  # 0.6 or so
    chain = [f"k{i}" for i in range(100)]
    for step in range(30):  # each near the next one
        chain = changed(rnd, chain, 4).split()
        rows.append(" ".join(chain))
    rows += [line] * 20 + ["Two Words", "two \t words", "one", "ONE", "Ärger", "ärger", "", "  ", "", None, "a a a a", "a a", "A A A"]
    rnd.shuffle(rows)
    return [(i + 10, t) for i, t in enumerate(rows)] + [(None, "one"), (None, "x y"), (None, None), (11, rows[0])]


@pytest.mark.parametrize("block", [oddsketch.BLOCK, 16])
def test_components_are_those_of_all_pairs(spark, texts, block):
    docs = spark.createDataFrame([(*r, "s") for r in texts], "doc_id long, text string, component string").repartition(5)
    got = oddsketch.near_duplicates(docs, block=block)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(texts)


def test_no_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert oddsketch.near_duplicates(docs.limit(0)).collect() == []
    assert sorted(tuple(r) for r in oddsketch.near_duplicates(docs).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_no_similar_pair_is_ruled_out_and_estimates_are_near_the_truth():
    rng = np.random.default_rng(3)
    for size in (5, 40, 300, 800, 1_000, 1_200, 3_000, 40_000):
        for j in (0.5, 0.7, 0.8, 0.9):
            both, other = round(size * 2 * j / (1 + j)), rng.integers(max(1, size * 4 // 5), size + 1)
            close, passed = [], 0
            for _ in range(30):
                pool = np.unique(rng.integers(0, 2 ** 64, 2 * size + 10, dtype=np.uint64))
                rng.shuffle(pool)
                for a, b in ((pool[:size], pool[size - both:2 * size - both]), (pool[:size], pool[:other])):
                    a, b = np.sort(a), np.sort(b)
                    rows = pd.DataFrame([(len(x), *oddsketch.odd_sketches(x)) for x in (a, b)],
                                        columns=["n", "sampled", "whole", "part"])
                    found = oddsketch.Features.of(rows).distances(np.array([0]), np.array([1]))[0]
                    assert found < np.inf or not oddsketch.similar(a, b), (size, j)
                    if len(a) == len(b):
                        passed += found < np.inf
                        close.append(1 - found)
            assert j > 0.5 or passed == 0 or size < 20
            if j >= 0.8 and size >= 300 and passed > 20:
                assert abs(np.mean([c for c in close if c > 0]) - j) < 0.05, (size, j)


def test_more_texts_than_a_bitmap_tells(spark, texts, monkeypatch):
    monkeypatch.setattr(oddsketch, "FILTER_ROWS", 3)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted([tuple(r) for r in oddsketch.near_duplicates(docs).collect()], key=str) == plain(texts)


def test_bands_meet_as_they_should():
    assert oddsketch.band_shape(10 ** 5) == (35, 5) and oddsketch.band_shape(10 ** 10)[1] == 7
    rng = np.random.default_rng(1)
    bands, missed, chance = oddsketch.Bands(35, 5), 0, 0
    for _ in range(100):
        pool = np.unique(rng.integers(0, 2 ** 64, 300, dtype=np.uint64))
        rng.shuffle(pool)
        a, b, c = bands.keys(np.sort(pool[:90])), bands.keys(np.sort(pool[10:100])), bands.keys(np.sort(pool[150:]))
        missed += not (a == b).any()
        chance += (a == c).any()
    assert missed == 0 and chance == 0
