"""Fuzzy matching against a table of entries, by every pair in plain Python."""

import random

import numpy as np
import pytest
from conftest import plan, rows

from gridwash.functions.similarity import jaro_winkler, pair_scores
from gridwash.operators import vocabulary


def words(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeé r") for _ in range(rnd.randrange(1, 14))) for _ in range(n // 3)]

    def broken(w):
        w = list(w)
        for _ in range(rnd.randrange(1, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at + rnd.randrange(2)] = rnd.choice(["", "x", "ab", "é"])
        return "".join(w)

    return base, [broken(rnd.choice(base)) for _ in range(n - len(base))] + rnd.sample(base, n // 6) + ["", "zzz", "a" * 40]


def by_all_pairs(values, entries, threshold):
    out = {}
    for v in values:
        scored = [(-jaro_winkler(v.encode(), e.encode()), e) for e in entries]
        out[v] = min(scored)[1] if scored and -min(scored)[0] >= threshold and v else None
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9, 0.99])
def test_closest_entry_of_a_table(spark, threshold):
    entries, values = words(int(threshold * 100), 150)
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, *values[:40], None])], "i long, _value string")
    listed = spark.createDataFrame([(e,) for e in [*entries, *entries[:5], None, ""]], "e string")
    got = vocabulary.fuzzy_match(df, "_value", listed, threshold)
    assert got.columns == ["i", "_value", "matched"] and "CartesianProduct" not in plan(got)
    want = by_all_pairs(values, entries, threshold)
    assert sorted(rows(got)) == [(i, v, want.get(v)) for i, v in enumerate([*values, *values[:40], None])]


def test_no_pair_is_lost_and_few_meet_for_nothing(spark):
    rnd = random.Random(4)
    entries = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(400)]
    values = [e[:rnd.randrange(12)] + rnd.choice("xyz") + e[rnd.randrange(12):] for e in entries[:200]]
    known = spark.createDataFrame([(e, e) for e in entries], "entry string, place string")
    rarity = vocabulary._byte_order(known)
    known = known.withColumn("tokens", vocabulary._tokens(rarity)("entry"))
    asked = spark.createDataFrame([(v,) for v in values], "value string").withColumn("tokens", vocabulary._tokens(rarity)("value"))
    for score, most in ((0.97, 0.01), (0.9, 0.05)):
        met = [(r.value, r.entry) for r in vocabulary.candidates(asked, known, score).collect()]
        assert len(met) == len(set(met)) or len(set(values)) < len(values)
        assert {(v, e) for v in values for e in entries if jaro_winkler(v.encode(), e.encode()) >= score} <= set(met)
        assert len(set(met)) < most * len(values) * len(entries)


def test_order_decides_ties_and_empty_tables(spark):
    df = spark.createDataFrame([("abcx",), ("q",)], "v string")
    listed = spark.createDataFrame([("abcy", 2), ("abcz", 1)], "e string, nth long")
    assert sorted(rows(vocabulary.fuzzy_match(df, "v", listed, 0.7, order_by="nth"))) == [("abcx", "abcz"), ("q", None)]
    assert rows(vocabulary.fuzzy_match(df, "v", listed.select("e").limit(0))) == [("abcx", None), ("q", None)]
    assert rows(vocabulary.fuzzy_match(df.limit(0), "v", listed.select("e"))) == []
    with pytest.raises(ValueError):
        vocabulary.fuzzy_match(df, "v", listed.select("e"), 0)


def numbered(n):
    return [f"Supplier#{i:09d}" for i in range(n)], [f"Suplier {i:09d}" for i in range(n)]


def test_numbered_names_meet_few_others(spark):
    entries, values = numbered(200)
    known = spark.createDataFrame([(e, e) for e in entries], "entry string, place string")
    rarity = vocabulary._byte_order(known)
    known = known.withColumn("tokens", vocabulary._tokens(rarity)("entry"))
    asked = spark.createDataFrame([(v,) for v in values], "value string").withColumn("tokens", vocabulary._tokens(rarity)("value"))
    met = {(r.value, r.entry) for r in vocabulary.candidates(asked, known, 0.94).collect()}
    reached = {(v, e) for v in values for e in entries if jaro_winkler(v.encode(), e.encode()) >= 0.94}
    assert reached <= met and len(met) <= 6 * len(values)


def test_kinds_in_several_packs_and_parts(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "PACK", 2)
    monkeypatch.setattr(vocabulary, "BLOCK", 3)
    entries, values = numbered(130)
    entries, values = [*entries[::3], "Tupplier", "S"], [*values[:60], *values[100:], "supplier", "Sup", "x" * 90]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = vocabulary.fuzzy_match(df, "v", spark.createDataFrame([(e,) for e in entries], "e string"))
    assert dict(rows(got)) == by_all_pairs(values, entries, 0.7)


def test_scores_of_many_pairs_are_those_of_each():
    rnd = random.Random(5)
    texts = [*words(6, 120)[1], *("ab" * 30 + c for c in "cdé"), "x" * 80, "a", "é"]
    left, right = [t.encode() for t in texts], [t.encode() for t in reversed(texts)]
    at = np.array([(rnd.randrange(len(left)), rnd.randrange(len(right))) for _ in range(3000)] + [(i, len(left) - 1 - i) for i in range(len(left))])
    assert pair_scores(left, right, at[:, 0], at[:, 1]).tolist() == [jaro_winkler(left[i], right[j]) for i, j in at]
