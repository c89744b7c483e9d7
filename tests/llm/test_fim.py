"""Fill-in-middle against a plain version over whole texts."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from gridwash.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    drawn = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), out


def texts():
    rnd = random.Random(3)
    shared = " ".join(f"word{rnd.randrange(500)}" for _ in range(600))
    rows = [None, "", " ", "\n\t ", "one", " one", "one ", "ä", "日本語 テキスト 🎉 x", "a<P>b c d", "<S", "S> <", "x <M> y", "<" * 50,
            "a" * 30_000, " " * 20_000, "a " * 30_000, "\x0b\x0c\x1c\x85 　 a"]
    for _ in range(150):
        own = " ".join(rnd.choice(["ä", "日本", "w", "long" * 9, "🎉", "<S", "M>"]) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(400)))
        rows.append(own + rnd.choice(["", shared]) + rnd.choice(["", " ", own]))
    return rows


def test_forms_and_restored_texts(spark):
    rows = list(enumerate(texts())) + [(None, "a b c d e"), (5, "one"), (5, "one")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = fim.fill_in_middle(docs.repartition(3), rate=90, keep_columns=("text", "output", "n")).withColumn(
        "back", fim.restored()).collect()
    wanted = [(i, *plain(i, t, rate=90), t or "") for i, t in rows]
    key = lambda r: (str(r[0]), r[-1])
    assert sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key) == sorted(
        wanted, key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"} and {r.row.output for r in got} == {"x"}


def test_every_cut_of_a_text():
    chunks = fim.Chunks()
    for text in texts():
        units = UNIT.findall(text or "")
        for k in {0, 1, len(units) // 3, len(units) // 2, len(units)}:
            n, first, second = chunks.cut(text or "", k, len(units))
            assert (n, first, second) == (len(units), len("".join(units[:k])), len(text or ""))


def test_chunks_are_shared_and_memory_is_bounded():
    rnd = random.Random(1)
    shared = " ".join(f"word{rnd.randrange(10**6)}" for _ in range(5_000))
    chunks = fim.Chunks()
    for i in range(10):
        chunks.cut(f"{'start' * i} {shared} {i}", 1, 2)
    assert chunks.found > 0.8 * chunks.asked
    few = fim.Chunks(memory=3_000)
    for i in range(10):
        assert few.cut(f"{'start' * i} {shared} {i}", 100, 20) == chunks.cut(f"{'start' * i} {shared} {i}", 100, 20)
    assert few.held <= 3_000 + 2 * fim.CHUNK_MOST + 500


def test_spans_change_no_border(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 50_000).astype(np.uint8)
    whole = fim.chunk_borders(data, fim._mixed_bytes())
    monkeypatch.setattr(fim, "SPAN", 777)
    assert fim.chunk_borders(data, fim._mixed_bytes()) == whole
    assert whole[-1] == len(data) and max(np.diff(whole)) <= fim.CHUNK_MOST


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(docs).withColumn("t", fim.restored()).select(F.col("t")).collect() == []
