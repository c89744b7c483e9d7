"""Delimited text cut by many tasks, against Spark's reader of whole files."""

import csv
import random

import pytest
from conftest import SMALL, rows

from gridwash.sources import readers
from gridwash.sources.records import LineStates, QuoteRule, records

NASTY = ["", "plain", 'say ""so""', "two\nlines", "a,b;c", "\n", '""', "tab\there", "r\r\nn", "ü 日本", " x ", "x" * 200, "\n\n,\n", 'q"']


def cell(text):
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r;') else text


@pytest.fixture
def splits(spark):
    """Splits of a few bytes, so that records cross one border or many."""
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(folder, name, texts, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(end.join(texts).encode())


def same(spark, path, **kw):
    one, many = readers.read_csv(spark, path, parallel=False, **kw), readers.read_csv(spark, path, parallel=True, **kw)
    assert one.schema == many.schema
    assert sorted(rows(one), key=str) == sorted(rows(many), key=str)
    return many


def by_rule(folder):
    """The rows of all files by Python's reader, cut or filled to three cells; NULL and empty are one here."""
    out = []
    for file in sorted(folder.iterdir()):
        with open(file, newline="", encoding="utf-8") as text:
            body = [r for r in csv.reader(text) if r][1:]
        out += [tuple([*r, "", "", ""][:3]) for r in body]
    return sorted(out)


@pytest.mark.parametrize("size", [150, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_reader_of_whole_files(spark, splits, tmp_path, size, end):
    rnd = random.Random(size)
    for name in ("a.csv", "b.csv"):
        body = [f"{rnd.randrange(99)},{cell(rnd.choice(NASTY))},{cell(rnd.choice(NASTY))}" for _ in range(20)]
        written(tmp_path / "t", name, ['id,"first\nname",note', *body, "7,short", '8,"long, one",x,y,z', "", "9,,"], end)
    splits(size)
    # Spark's own reader of whole files takes the line break in the header for that of all lines.
    many = same(spark, str(tmp_path / "t")) if end == "\n" else readers.read_csv(spark, str(tmp_path / "t"), parallel=True)
    assert many.columns == ["id", "first\nname", "note"] and many.schema[0].dataType.simpleString() == "bigint"
    assert sorted(tuple("" if c is None else str(c) for c in r) for r in rows(many)) == by_rule(tmp_path / "t")
    assert records(spark, str(tmp_path / "t"), ",").select("split").distinct().count() > (1 if size < 1_000 else 0)


def test_quotes_inside_plain_cells_open_nothing(spark, splits, tmp_path):
    written(tmp_path / "t", "a.csv", ["k,size", '1,5" pipe', '2,"a ""b"" c"', '3,6" pipe', '4,"x\ny"', '5,"odd" end', "6,7\"8\"9"])
    for size in (30, 1_000):
        splits(size)
        assert same(spark, str(tmp_path / "t"), sep=",").count() == 6


def test_a_cell_over_many_splits_and_one_that_never_ends(spark, splits, tmp_path):
    written(tmp_path / "t", "a.csv", ["k,v", '1,"' + "line\n" * 300 + '"', "2,x", '3,"open', "4,y", "5,z"])
    splits(200)
    schema = readers._as_struct(spark, "k long, v string")
    got = {r.k: r.v for r in readers.read_csv(spark, str(tmp_path / "t"), schema, sep=",", parallel=True).collect()}
    assert len(got) == 3 and len(got[1]) == 1500 and got[2] == "x" and got[3].endswith("open\n4,y\n5,z")


def test_odd_files(spark, splits, tmp_path):
    written(tmp_path / "e", "a.csv", [""])
    written(tmp_path / "h", "a.csv", ["a,b"])
    written(tmp_path / "n", "a.csv", ["a,b", "a,b", "1,2"])
    written(tmp_path / "bom", "a.csv", ["﻿a,b", "1,2"])
    written(tmp_path / "names", "a.csv", ["a,A,,b", "1,2,3,4"])
    splits(1_000)
    assert readers.read_csv(spark, str(tmp_path / "e"), parallel=True).columns == []
    for name in ("h", "n", "bom", "names"):
        same(spark, str(tmp_path / name), sep=",")


def test_lenient_reading_finds_the_same_misfits(spark, splits, tmp_path):
    written(tmp_path / "t", "a.csv", ["k,v", '1,"a\nb"', "2", "x,y", '3,"c\n\nd",5'])
    splits(12)
    schema = readers._as_struct(spark, "k long, v string")
    one, many = [readers.read_csv_lenient(spark, str(tmp_path / "t"), schema, parallel=p) for p in (False, True)]
    assert sorted(rows(one[0]), key=str) == sorted(rows(many[0]), key=str)
    assert sorted(rows(one[1], "k", "v"), key=str) == sorted(rows(many[1], "k", "v"), key=str)


def test_documents_in_one_file_are_read_by_many_tasks(spark, splits, tmp_path):
    path = str(tmp_path / "docs")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.coalesce(1).write.options(**readers.DIALECT).csv(path, header=True)
    splits(40_000)
    many = same(spark, path)
    assert many.count() == docs.count()
    assert records(spark, path, ",").select("split").distinct().count() > 5


def test_large_files_are_cut_by_default(spark, splits, tmp_path):
    written(tmp_path / "t", "a.csv", ["k,v", *['1,"a\nb"'] * 50])
    splits(100)
    assert readers._cut_in_parallel(spark, str(tmp_path / "t"))
    splits(10_000)
    assert not readers._cut_in_parallel(spark, str(tmp_path / "t"))


def test_line_states():
    states = LineStates(QuoteRule("|"))
    both = {"a|b": (False, True), '"a|b': (True, False), 'a"|b': (False, False), '"a""b"|c': (False, False), '""': (False, True),
            '"': (True, False), '|"x"|"y': (True, True), 'a|"': (True, False), 'x"|"y"|z': (False, False), '""|"': (True, False), '1|"so ""said"" he, | and ""x': (True, False), '"""a""|"': (False, True)}
    for line, want in both.items():
        assert states.both(line) == want, line


@pytest.mark.parametrize("text,sep", [
    ('"last, first, middle";amount\n"a, b";1\n"c, d";2', ";"), ("a,b\n1,2", ","), ("a\tb,c\n1\t2\n3\t4,5", "\t"), ("a|b|c", "|"),
    ("a;b\n1,5;2,5\n3,5;4,5", ";"), ("only\n1", ","), ('"x;y;z\nmore;",b,c\n1,2,3', ","), ('"open, never closed;', ",")])
def test_delimiter_outside_quotes(spark, tmp_path, text, sep):
    (tmp_path / "x.csv").write_text(text)
    assert readers.sniff_delimiter(spark, str(tmp_path / "x.csv")) == sep
