"""Language, quality, page text, vector searches and the pipeline on small tables."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwash.llm import ann, html, langid, quality, topk, vectors
from gridwash.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


# ---- language

VOCABULARY = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b" ab", b"ca"]
PIECES = {p: i for i, p in enumerate(sorted(VOCABULARY))}


def all_segmentations(word, table):
    """Sum over every way to cut a word into pieces, of the product of their probabilities."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[last:i])
                last = i
        total += math.prod(table[PIECES[p]] if p in PIECES else 0.0 for p in parts)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    table = rng.random((len(PIECES) + 1, 2)) / 10
    table[-1] = 0
    words = ["abc", "cabab", "a", "bcabcab"]
    got = langid.word_scores(words, langid.Pieces(VOCABULARY), table)
    for w, row in zip(words, got):
        for lang in (0, 1):
            assert row[lang] == pytest.approx(math.log(all_segmentations(b" " + w.encode(), table[:, lang])))


def test_pieces_are_found_where_they_are():
    import public_tokenizers
    from gridwash.llm.bpe import load_ranks
    names = sorted(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    pieces, number = langid.Pieces(names), {p: i for i, p in enumerate(names)}
    rnd = random.Random(1)
    for n in (1, 2, 9, 48):
        parts = [bytes(rnd.choice(b"abcdefgh the\xc3\xa9\x00\xff") for _ in range(n)) for _ in range(60)]
        hashes = pieces.hashes(parts)
        for first, last in ((0, n), (n // 3, n), (0, max(1, n // 2))):
            found = pieces.find(hashes, first, last)
            for k, p in enumerate(parts):
                for end in range(first + 1, last + 1):
                    for size in range(1, found.shape[2] + 1):
                        want = number.get(p[end - size:end], len(names)) if size <= end else len(names)
                        assert found[k, end - first - 1, size - 1] == want


def log_passes(word, table):
    """Log sums over all segmentations up to and from each position, one number at a time."""
    def add(values):
        top = max(values, default=-math.inf)
        return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))

    n, log = len(word), {p: math.log(table[i]) for p, i in PIECES.items()}
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for end in range(1, n + 1):
        ahead[end] = add([ahead[end - len(p)] + v for p, v in log.items() if word[:end].endswith(p)])
    for start in range(n - 1, -1, -1):
        behind[start] = add([v + behind[start + len(p)] for p, v in log.items() if word.startswith(p, start)])
    return ahead, behind, log


@pytest.mark.parametrize("stretch", [4, 16, 4_096])
def test_long_words_are_whole(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    pieces = langid.Pieces(VOCABULARY)
    for size in (1, 7, 47, 48, 60, 2_000):  # 2,000 bytes are far below the smallest double
        table = rng.random((len(PIECES) + 1, 2)) / 1_000
        table[-1] = 0
        words = ["".join(rng.choice(list("abc"), size)) for _ in range(2)]
        got = langid.word_scores(words, pieces, table)
        uses = np.zeros((2, len(PIECES)))
        for word, piece, share in langid.segment_uses([langid.bytes_of(w) for w in words], pieces, np.array([0, 1]), table):
            np.add.at(uses, (word, piece), share)
        for k, w in enumerate(words):
            whole = b" " + w.encode()
            for lang in (0, 1):
                assert got[k, lang] == pytest.approx(log_passes(whole, table[:, lang])[0][-1], rel=1e-9)
            ahead, behind, log = log_passes(whole, table[:, k])
            for p, i in PIECES.items():
                want = sum(math.exp(ahead[at] + log[p] + behind[at + len(p)] - ahead[-1])
                           for at in range(len(whole)) if whole.startswith(p, at))
                assert uses[k, i] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_bytes_that_no_piece_has():
    pieces = langid.Pieces([b" ", b"a", b"b", b" a", b"ab"])
    table = np.full((6, 1), 0.01)
    table[-1] = 0
    assert np.isfinite(langid.word_scores(["abxab", "x" * 300], pieces, table)).all()
    shares = [s for _, _, s in langid.segment_uses([b" x"], pieces, np.array([0]), table)]
    assert all((s == 0).all() for s in shares)


def test_expected_uses_by_hand(spark):
    table = np.full((len(PIECES) + 1, 1), 0.01)
    table[-1] = 0
    counts = spark.createDataFrame([("x", "ab", 3)], "lang string, word string, n long")
    got = {r.piece: r.uses for r in langid.expected_uses(counts, ["x"], langid.Pieces(VOCABULARY), table).collect()}
    # " ab" in one piece, in two (" a"+"b", " "+"ab"), in three
    ways = {(b" ab",): 0.01, (b" a", b"b"): 1e-4, (b" ", b"ab"): 1e-4, (b" ", b"a", b"b"): 1e-6}
    for piece, i in PIECES.items():
        want = 3 * sum(p for w, p in ways.items() if piece in w) / sum(ways.values())
        assert got.get(i, 0.0) == pytest.approx(want)


def lang_docs(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aba abba ab", "p"), ("cac cacc ca", "q"), ("ab ba", "p"), ("cc ac", None)] * 5)]
    return spark.createDataFrame([(*r, "z", 1.0) for r in rows], "doc_id long, text string, lang string, row string, score double")


def test_language_of_odd_texts(spark):
    docs = lang_docs(spark)
    model = langid.train(langid.labelled_rows(docs, F.lit(True)), VOCABULARY)
    assert model.languages == ["p", "q"]
    odd = spark.createDataFrame([(1, "ABBA ab", "x"), (2, None, "x"), (3, "12 !?", "x"), (4, "", "x"), (5, "c" * 100_000, "x"),
                                 (6, "ca", "x"), (6, "ca", "x"), (None, "abab ca abab", "x")], "doc_id long, text string, row string")
    got = sorted(((r.row.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in langid.predict(odd, model).collect()), key=str)
    assert got == sorted([(1, "p", True), (2, "und", True), (3, "und", True), (4, "und", True), (5, "q", True), (6, "q", True),
                          (6, "q", True), (None, "p", True)], key=str)
    nothing = langid.train(langid.labelled_rows(docs.limit(0), F.lit(True)), VOCABULARY)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark):
    got = QUERIES["op9_langid"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    row = got.filter("held_out AND text RLIKE '\\\\p{L}'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"),
                                                            F.count("*").alias("n")).first()
    assert row.n > 20 and row.a > 0.95
    fold = got.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2))
    assert fold.count() == 0


# ---- quality

def test_ranking_learns_an_order():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, len(quality.FEATURES))), rng.normal(0, 1, (70, len(quality.FEATURES)))
    r = quality.fit(good, bad)
    s = [(x - r.mean) / r.spread @ r.weights for x in (good, bad)]
    assert (s[0][:, None] > s[1][None, :]).mean() > 0.95
    pairs = quality.pairs_of(good, bad)
    assert len(pairs) == 300 * quality.PARTNERS
    assert not quality.fit(good, bad[:0]).weights.any() and not quality.fit(good[:0], bad[:0]).weights.any()


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "f"), (2, "", "f"), (3, "word", "f"), (4, "x " * 100_000, "f"), (4, "x", "f"), (None, "éé!", "f")],
                                 "doc_id long, text string, features string")
    rows = quality.featured(docs)
    unlearned = quality.scored(rows, quality.learn(rows.withColumn("label", F.lit(1))))
    assert {(r.score, r.predicted) for r in unlearned.collect()} == {(0.5, 1)} and unlearned.count() == 6
    assert all(len(quality.features_of(t)) == len(quality.FEATURES) for t in ("", " ", "a", "\n\n", "1 2 3"))
    assert quality.featured(docs.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    got = (QUERIES["op6_quality"](spark, "/root/testdata/sf0.01")
           .join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas())
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()


# ---- pages

LINE = "The house of the family was on the edge of the town and they had lived in it for a very long time. "
ARTICLE = "<h1>A title</h1><p>" + LINE * 3 + "</p><p>Short one.</p><p>" + LINE * 4 + "</p>"
TEXT = "\n".join(["A title", (LINE * 3).strip(), "Short one.", (LINE * 4).strip()])


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>One.<p>Two &amp; three&nbsp;&#233;", "One.\nTwo & three é"),
    (f"<nav><a href=x>{LINE}</a></nav><article>{ARTICLE}</article><footer>{LINE * 3}</footer>", TEXT),
    (f"<header><p>{LINE * 3}</p></header><main>{ARTICLE}</main><aside>{LINE * 3}</aside>", TEXT),
    (f"<div class='cookie-notice'>{LINE * 3}</div><div id=content>{ARTICLE}</div>", TEXT),
    (f"<article>{ARTICLE}<div class=\"ad big\"><p>{LINE * 3}</p></div></article>", TEXT),
    (f"<article>{ARTICLE}</article><section id=comments><h2>Comments</h2><article class=c><p>{LINE * 4}</p></article></section>", TEXT),
    (f"<article>{ARTICLE}<form><label>Name</label><input><button>Send it</button></form></article>", TEXT),
    (f"<div class=ad>{LINE}<article>{ARTICLE}</article>", TEXT),
    (f"<article><script>var a = '</p>' + \"<p>{LINE}\";</script><style>p {{}}</style><!-- <p>{LINE}</p> -->{ARTICLE}</article>", TEXT),
    (f"<body><ul class='menu'><li><a href=1>One two</a><li><a href=2>Three</a></ul><div>{ARTICLE}</div></body>", TEXT),
    (f"<div><a href=1>{LINE}</a> <a href=2>{LINE}</a></div><div>{ARTICLE}</div>", TEXT),
    ("<article><p>That it.</p></article><footer>x y</footer>", "That it."),
    (f"<div class='page with-sidebar'><div class=post><header class=entry-header><h1>A title</h1></header>{ARTICLE[16:]}</div>"
     f"<div class='widget_area'>{LINE * 3}</div></div>", TEXT),
    (f"<article>{ARTICLE}</article><div class='reader-comments'><div class=post><p>{LINE * 4}</p></div></div>", TEXT),
    (f"<div id=adslot3><p>{LINE * 3}</p></div><div class='privacy-notice' role=alert>{LINE}</div><main>{ARTICLE}</main>", TEXT),
    ("<p>a<br>b\n  c</p><p> </p>", "a b c"),
    ("<p title=\"a > b\">x</p><p title='never closed>y</p>", "x\ny"),
    ("<p>1 < 2 and <3</p><!-- never closed <p>z</p>", "1 < 2 and <3"),
    ("<script>never closed <p>z</p>", ""),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


PARAGRAPH = "The house of the family was on the edge of the town and they had lived in it for a very long time, far from the mill."
FIGURES = "12,4 34,5 55,6 | 2019 2020 2021 | 4455 3321 998 | 12,4 34,5 55,6 | 2019 2020 2021 | 4455 3321 998 kWh"
OTHER = {
    "pl": "Dom rodziny stał na skraju miasta i mieszkali w nim przez bardzo długi czas, niedaleko rzeki płynącej w dolinie starego "
          "młyna. Latem dzieci bawiły się nad wodą, a dorośli pracowali w polu do późnego wieczora, kiedy słońce zachodziło.",
    "ja": "その家族の家は町のはずれにあり、彼らはとても長い間そこに住んでいました。古い水車のある谷を流れる川からも遠くありませんでした。夏になると"
          "子供たちは水辺で遊び、大人たちは夕方遅くまで畑で働いていました。",
}


def in_content(*blocks, tag="p"):
    return "<div class='content'>" + "".join(f"<{tag}>{b}</{tag}>" for b in blocks) + "</div>"


@pytest.mark.parametrize("blocks", [
    [PARAGRAPH] * 6, [PARAGRAPH] * 6 + [FIGURES], [FIGURES] + [PARAGRAPH] * 6, [PARAGRAPH, PARAGRAPH, FIGURES, PARAGRAPH, PARAGRAPH],
    [OTHER["pl"]] * 3, [OTHER["ja"]] * 3, [OTHER["pl"], "Krótko.", FIGURES, OTHER["pl"]], [PARAGRAPH], [FIGURES],
])
def test_no_article_vanishes(blocks):
    menu = "<div><a href=1>" + PARAGRAPH + "</a> <a href=2>" + PARAGRAPH + "</a></div>"
    assert html.main_text(in_content(*blocks)) == "\n".join(blocks)
    if len(blocks) > 1:
        assert html.main_text(menu + in_content(*blocks) + menu) == "\n".join(blocks)


def test_lists_and_tables_stay_with_their_article():
    items = [f"Reading number {i} taken at the well" for i in range(8)]
    page = in_content(PARAGRAPH, PARAGRAPH) + "<div><ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul><table><tr><td>" \
        + FIGURES + "</td></tr></table></div>" + in_content(PARAGRAPH, PARAGRAPH)
    assert html.main_text(page) == "\n".join([PARAGRAPH] * 2 + items + [FIGURES] + [PARAGRAPH] * 2)


def test_pages_of_any_size_and_columns(spark):
    rows = [(1, "u", f"<article>{'<p>' + LINE + '</p>'}</article>" * 1, 5), (1, "u", None, 5), (None, None, "<p>" * 30_000 + "x", None),
            (2, "u", "<article><p>" + LINE * 20_000 + "</p></article>", 6), (3, "u", '<a href="' * 3_000, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html.extract_text(pages).collect()
    assert sorted(len(r.text) for r in got) == sorted([len(LINE) - 1, 0, 1, len(LINE) * 20_000 - 1, len(got[4].text)])
    assert html.extract_text(pages).columns == ["page_id", "url", "n_chars", "text"]
    assert html.extract_text(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html.extract_text(pages.withColumn("text", F.lit("")))


def test_given_pages_give_their_articles(spark):
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op10_html"](spark, SMALL).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(re.sub("<[^>]*>", " ", x).replace("&amp;", "&").replace("&quot;", '"').split())
                  for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# ---- vectors

def vector_rows(count, dims, seed, whole=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    v = centres[rng.integers(0, 8, count)] + rng.normal(size=(count, dims)) * 0.4
    v[count // 2:count // 2 + count // 4] = v[0]  # a third of all are one vector
    return np.round(v * 4) / 4 if whole else v


def vector_table(spark, v, extra=()):
    rows = [(i, [float(x) for x in row], "w", 1) for i, row in enumerate(v)] + [(i, e, "w", 1) for i, e in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, rank int")


ODD = [(9_001, None), (9_002, []), (9_003, [float("nan")] + [1.0] * 7), (9_004, [None] + [1.0] * 7),
       (9_005, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]


def test_exact_top_k(spark):
    v = vector_rows(700, 8, 2, whole=True)
    for block in (64, 2_048):
        got = topk.top_k(vector_table(spark, v, ODD), F.col("vec_id") % 7 == 0, 5, block=block).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        w = np.floor(256 * v).astype(np.int64)
        assert sorted(found) == list(range(0, 700, 7))
        for q, rows in found.items():
            score = w @ w[q]
            order = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:5]
            assert rows == [(i, score[i]) for i in order]


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(50, 13)), rng.normal(size=(60, 13))
    for segments in (1, 2, 4, 13, 16):
        assert (topk.statistics(q, segments) @ topk.statistics(x, segments).T >= q @ x.T - 1e-9).all()


def test_top_k_of_few_or_huge_or_zero_vectors(spark):
    few = spark.createDataFrame([(0, [1e6, 0.0]), (50, [2e4, 1e4]), (3, [0.0, 0.0]), (4, [1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(few, F.col("vec_id") % 50 == 0, 5).collect()}
    both = 256 ** 2 * 10 ** 6 * 2 * 10 ** 4
    assert got == {(0, 50): both, (0, 3): 0, (50, 3): 0, (50, 0): both}
    assert topk.top_k(few.limit(0), F.lit(True), 5).count() == 0


def brute_nearest(v, q, k):
    d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
    return [(int(i), d[i]) for i in np.lexsort((np.arange(len(v)), d)) if i != q][:k]


def test_nearest_neighbours_recall_and_distances(spark):
    v = vector_rows(1_500, 8, 3)
    v[7] = 0.0
    got = ann.nearest(vector_table(spark, v, ODD), F.col("vec_id") % 20 == 0, 10, shard=400).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 1_500, 20):
        want = [x for x in brute_nearest(v, q, 11) if x[0] != 7][:10]
        hits += len(set(want) & set(found[q]))
        total += 10
        assert all(s == np.sqrt(((v[i] - v[q]) ** 2).sum()) for i, s in found[q])
        assert [s for _, s in found[q]] == sorted(s for _, s in found[q]) and all(i != q and i != 7 for i, _ in found[q])
    assert hits / total >= 0.9
    # Equal vectors: all at distance 0, the smallest ids.
    assert found[0] == [(i, 0.0) for i in range(750, 760)]


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e4, 1.0), (-1e7, 1.0), (0.0, 1e-25), (0.0, 1e20), (1e22, 1e20)])
def test_recall_wherever_vectors_lie(spark, shift, scale):
    """At the query's own settings: a number of vectors that one shard of 4,096 holds."""
    v = vector_rows(1_200, 16, 7) * scale + shift
    got = ann.nearest(vector_table(spark, v), F.col("vec_id") % 100 == 0, 10).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r.score)
    near = 0
    for q in range(0, 1_200, 100):
        d = np.sort(np.sqrt(((v - v[q]) ** 2).sum(axis=1))[np.arange(1_200) != q])
        assert len(by_query[q]) == 10
        near += sum(s <= d[9] for s in by_query[q])
    assert near >= 0.9 * 120


def test_recall_on_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(rows, F.col("vec_id") % 100 == 0, 10, shard=512).toPandas()
    table = rows.filter(F.size("embedding") > 0).toPandas()
    v, ids = np.array([list(x) for x in table.embedding], dtype=float), table.vec_id.to_numpy()
    hits = []
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        worst = np.sort(d[ids != q])[9]
        hits.append((part.score <= worst + 1e-12).sum() / 10)
    assert np.mean(hits) >= 0.9


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [0.0, 0.0]), (2, [4.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") % 100 == 0, 10).collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(few.limit(0), F.lit(True), 10).count() == 0


def test_blocks_hold_all_rows(spark):
    t = vector_table(spark, vector_rows(100, 3, 1)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).repartition(3)
    blocks = vectors.packed(t, 16).collect()
    ids = np.concatenate([vectors.unpacked(b.dims, b.ids, b.values)[0] for b in blocks])
    assert sorted(ids) == list(range(100)) and len({b.block for b in blocks}) == len(blocks)


# ---- pipeline

def stage_rows(spark, extra=False):
    words = [f"word{i}" for i in range(60)]
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.sample(words, 30)) + " the and of", "en", "a" if i % 3 else "b", 1) for i in range(30)]
    rows += [(50, None, "en", "a", 0), (51, "", None, None, 0), (52, "12 34", "en", "a", 5), (None, "some words of nobody", None, None, 1)]
    rows += [rows[3], (60, rows[4][1], "en", "c", 1), (61, "mail me@x.org " + " ".join(words), "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"fp": F.lit(1), "row": F.lit("r"), "copies": F.lit("c")}) if extra else df


@pytest.mark.parametrize("extra", [False, True])
def test_each_stage_takes_odd_rows(spark, extra):
    docs = stage_rows(spark, extra)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        out = stage(spark, docs, SMALL)
        if name != "byte_pairs":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.collect()


def test_stages_decide(spark):
    docs = stage_rows(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SMALL)
    assert {r.doc_id for r in kept.collect()} == {*range(30), None, 60, 61}
    single = stages["near_duplicates"](spark, kept, SMALL)
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == [*range(30), 61]
    masked = {r.doc_id: r for r in stages["personal_data"](spark, single, SMALL).collect()}
    assert masked[61].text.startswith("mail [EMAIL] ") and masked[61].n_chars == len(masked[61].text)
    coded = stages["byte_pairs"](spark, kept, SMALL).collect()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert len(coded) == kept.count() and all(r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in coded)


def test_pipeline_runs_over_documents(spark):
    out = corpus_pipeline.run(spark, SMALL)
    ids = pd.Series([r.doc_id for r in out.select("doc_id").collect()])
    assert len(ids) > 50 and ids.value_counts().max() <= 3
