"""Mixing, personal data, near-duplicates, encoding and lengths on small tables, against plain Python."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridwash.llm import bpe, lengths, mixing, pii, simhash
from gridwash.llm.components import components

SCHEMA = "doc_id long, text string, source string, words string, row string, id long, spans string"


def table(spark, rows, schema=SCHEMA):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "w", "r", 7, "s") for r in rows], schema)


# ---- mixing

def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at the limit, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, [s for s in names if sizes[s]]
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in open_:
            target[s] += unit * weight[s]
            over = target[s] - most * sizes[s]
            if over > 0:
                target[s] -= over
                left += over
        open_ = [s for s in open_ if target[s] < most * sizes[s]]
    return target


def test_mix_meets_targets_and_limits(spark):
    rnd = random.Random(3)
    rows = [(i, "x " * rnd.randint(0, 60), rnd.choice(["a", "b", "b", "b", "b", "é", None])) for i in range(600)]
    rows += [(9_000 + i, "word", "tiny") for i in range(3)] + [(9_100, None, "none"), (9_101, "  \n", "none")] + rows[:5]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.words
        taken[r.source] = taken.get(r.source, 0) + r.words * r.copies
    want = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_words == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_prefers_by_inclusion_odds(spark):
    rows = [(i, "x " * (400 if i % 2 else 5), "a") for i in range(2_000)] + [(5_000 + i, "y " * 300, "b") for i in range(1_000)]
    got = mixing.mix(table(spark, rows), weights=(1, 3)).filter("source = 'a'").groupBy("words").agg(
        F.avg("copies").alias("c")).collect()
    rate = {r.words: r.c for r in got}
    assert rate[400] > 1.2 * rate[5]


def test_mixed_repeats_rows_and_keeps_columns(spark):
    rows = [(i, "x y z", "a") for i in range(50)] + [(100 + i, "x y z", "b") for i in range(50)]
    docs = table(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    per = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    copies = {r.id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert per == copies
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_no_words_no_target(spark):
    got = mixing.mix(table(spark, [(1, None, None), (None, "", "a")])).collect()
    assert [(r.target, r.copies) for r in got] == [(0.0, 0), (0.0, 0)]


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def spans_of(spark, texts):
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)]).drop("spans")
    base = pii.find_pii(docs).select("doc_id", pii.listed(F.filter("spans", lambda s: s["kind"].isin(pii.base_kinds()))))
    return dict(map(tuple, base.collect()))


def test_base_spans_as_plain_patterns(spark):
    rnd = random.Random(5)
    parts = ["a@b.c", "@", ".", "d", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "é", "😀",
             "(", ")", "1.2.3.4", "%x", "+1 (203) 555-0101", "\n", "0", "b.co", "_", "00", "٣"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3_000)]
    texts += ["", None, "1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+" + "1-" * 20_000, "a@b" + ".c" * 20_000,
              "1 " * 30_000, "me@x.org, " * 400, "a@b.c%x@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "5 4111111111111111"]
    got = spans_of(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t or ""), repr(t)[:200]


def test_validators_and_context_add_spans(spark):
    texts = ["Pay to GB82 WEST 1234 5698 7654 32 now", "Pay to GB83 WEST 1234 5698 7654 32 now",
             "my SSN is 078-05-1120.", "part 078-05-1120."]
    found = pii.find_pii(table(spark, [(i, t, "s") for i, t in enumerate(texts)]).drop("spans"))
    kinds = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in found.collect()}
    assert kinds == {0: [("iban", "GB82 WEST 1234 5698 7654 32")], 1: [], 2: [("ssn", "078-05-1120")], 3: []}
    near = pii.find_pii(table(spark, [(1, "card 4111111111111111", "s"), (2, "x 4111111111111111", "s")]).drop("spans"))
    scores = {r.doc_id: r.spans[0].score for r in near.collect()}
    assert scores[1] > scores[2] >= pii.THRESHOLD


def test_masks(spark):
    docs = table(spark, [(1, "to é me@x.org or 1.2.3.4", "s"), (2, None, None), (3, "", "s"), (4, "a 4111 1111 1111 1111 z", "s")])
    got = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert got == {1: "to é [EMAIL] or [IP]", 2: None, 3: "", 4: "a [CARD] z"}
    assert pii.mask_pii(docs).columns == docs.columns and pii.mask_pii(docs.limit(0)).count() == 0


# ---- near-duplicates

def plain_fingerprint(text):
    import xxhash
    words = [w for w in re.split("[ \t-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    values = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_bit_by_bit():
    for t in ["", None, " \n", "One", "É a B c D e f g", "x " * 70_000, "ab\x1ccd e\xa0f g h i"]:
        assert simhash.fingerprint_of(t) & (1 << 64) - 1 == plain_fingerprint(t)


def near_fingerprints(count, centres, seed, most=5):
    rnd = random.Random(seed)
    middle = [rnd.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < count:
        out.add(rnd.choice(middle) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, most))))
    return sorted(out)


@pytest.mark.parametrize("max_meeting", [3, 50, 4096])
def test_links_are_complete_with_any_size_of_meetings(spark, max_meeting):
    fps = near_fingerprints(700, 12, max_meeting)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.v: r.label for r in components(simhash.links(rows, max_meeting=max_meeting)).collect()}
    order = sorted(range(len(signed)), key=lambda i: signed[i])
    want = plain_components([fps[i] for i in order])
    assert [found.get(signed[i], signed[i]) for i in order] == [signed[order[j]] for j in want]


def test_half_way_points_at_odd_and_even_distance(spark):
    fps = near_fingerprints(40, 3, 1, most=4)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    for distance in (2, 3, 4):
        found = {r.v: r.label for r in components(simhash.half_way_links(rows, distance)).collect()}
        want = plain_components([f & (1 << 64) - 1 for f in signed], distance)
        assert [found.get(f, f) for f in signed] == [signed[j] for j in want]


def test_pigeonring_never_drops_a_link():
    rnd = random.Random(9)
    near = np.array([sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(4_000)], dtype=np.uint64)
    far = np.array([rnd.getrandbits(64) for _ in range(4_000)], dtype=np.uint64)
    for parts in (5, 6, 7, 9):
        assert simhash.pigeonring(near, parts, 4).all()
        assert simhash.pigeonring(far, parts, 4).mean() < 0.05


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (1_000, 999), (999, 1_000)], "a long, b long")
    got = {r.v: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 999: 999, 1_000: 999}


def test_near_duplicate_groups_keep_the_smallest_id(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "a"), (3, long + " more", "b"), (9, long, None), (9, long, None), (7, "other words here today", "a"),
            (11, None, "a"), (12, "", "a"), (None, long, "a")]
    docs = table(spark, rows)
    got = {(r.id, r.component) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(r[1]) for r in rows]
    label = plain_components(fps)
    want = {(r[0], min(q[0] for q, b in zip(rows, label) if b == a and q[0] is not None)) for r, a in zip(rows, label)}
    assert got == want
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({b for _, b in want})
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0
    nameless = table(spark, [(None, "a b", "s"), (None, "a b", "s")])
    assert [r.component for r in simhash.near_duplicates(nameless).collect()] == [None, None]
    assert simhash.without_near_duplicates(nameless).count() == 1


# ---- encoding

@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


def odd_texts(count, seed):
    rnd = random.Random(seed)
    alphabet = "ab Z9\x1c\x1d\x85  　​\n\t'srtélé²½ⅷ一二😀़क्́﻿\x00"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(count)]


def test_encodes_and_decodes_as_the_library(spark, ranks, library):
    texts = odd_texts(400, 1) + ["", None, "x" * 5_000 + " y", "<|endoftext|> 's", "the the the " * 3_000, "a" * 999]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, "no id", None), (2**62 + 1, "large id", "s")]
    docs = table(spark, rows).repartition(5)
    for chunk in (40, 2_000_000):
        out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk_chars=chunk), ranks)
        got = sorted(((r.id, list(r.ids), bytes(r.decoded)) for r in out.collect()), key=str)
        want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=str)
        assert got == want
        both = bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk_chars=chunk, decoded=True)
        assert sorted(((r.id, list(r.ids), bytes(r.decoded)) for r in both.collect()), key=str) == want
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_one_long_word_takes_no_quadratic_time(ranks, library):
    word = "ab" * 100_000
    assert bpe.encode_word(word.encode(), ranks) == library.encode_ordinary(word)


def test_digest(spark):
    row = spark.createDataFrame([([5, 60],), ([],)], "ids array<int>").select(bpe.ids_digest("ids").alias("d")).collect()
    assert {r.d for r in row} == {hashlib.sha256(b"5,60").hexdigest(), hashlib.sha256(b"").hexdigest()}


# ---- lengths

def test_histogram_answers_every_limit(spark, ranks, library):
    texts = odd_texts(60, 2) + ["", None] + ["many words here " * n for n in (1, 50, 900)]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    hist = lengths.length_histogram(docs, ranks, public_tokenizers.PATTERN).cache()
    n = sorted(len(library.encode_ordinary(t or "")) for t in texts)
    for r in hist.collect():
        assert (r.docs, r.docs_from) == (n.count(r.n_tokens), sum(x >= r.n_tokens for x in n))
        assert r.tokens_from == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
    limits = [0, 1, 7, 100, 10_000]
    for r in lengths.at_limits(hist, limits).collect():
        kept = sum(min(x, r.max_tokens) for x in n)
        assert (r.truncated_tokens, r.tokens_lost) == (kept, sum(n) - kept)
        assert r.docs_over == sum(x > r.max_tokens for x in n)
    for r in lengths.quantiles(hist, [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == n[max(0, int(np.ceil(r.share * len(n))) - 1)]
    empty = lengths.histogram(spark.createDataFrame([], "n_tokens long"))
    assert empty.count() == 0 and lengths.at_limits(empty, [5]).first().truncated_tokens == 0


def test_very_many_spans_in_one_text(spark):
    text = " ".join(f"mail user{i}@host{i}.example.org \U0001F4A1 call +1 555 010 {i % 9000 + 1000} ok" for i in range(6_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 5_000 + " a@b.cd " + "y" * 3_000), (3, ""), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert [len(found[i]) for i in (1, 2, 3, 4)] == [12_000, 1, 0, 0]
    assert all(text[s.start:s.end] == s.value for s in found[1])
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert masked[1] == " ".join("mail [EMAIL] \U0001F4A1 call [PHONE] ok" for _ in range(6_000))
    assert masked[2] == "x" * 5_000 + " [EMAIL] " + "y" * 3_000 and masked[3] == "" and masked[4] is None
