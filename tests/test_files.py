import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridwash.session import new_path, shared_folder
from gridwash.sources import readers, writers
from gridwash.sources.ingest import ingest, sanitize_column_names
from gridwash.sources.triage import triage, triage_landing_zone


@pytest.fixture
def ab(spark):
    return spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "parquet"])
def test_round_trip(spark, ab, fmt):
    path = new_path(spark, fmt)
    writers.write_export(ab, path, fmt)
    back = readers.read_export(spark, path, "jsonl" if fmt == "json" else fmt)
    assert sorted(rows(back)) == [(1, "x"), (2, "y")] and back.dtypes == ab.dtypes


def test_unknown_formats(spark, ab):
    with pytest.raises(ValueError):
        writers.write_export(ab, "x", "xlsx")
    with pytest.raises(ValueError):
        readers.read_export(spark, "x.xlsx")


def test_json_array_file_and_delimiters(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": {"c": 2}},\n {"a": 3}]')
    assert sorted(rows(readers.read_export(spark, str(tmp_path / "a.json")), "a")) == [(1,), (3,)]
    (tmp_path / "s.csv").write_text("a;b\n1;x,y\n")
    assert rows(readers.read_csv(spark, str(tmp_path / "s.csv"))) == [(1, "x,y")]


def test_ragged_rows_are_padded_and_reported(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b,c\n1,x,2.5\n2,y\n3,z,1.5,extra\n")
    good, odd = readers.read_csv_lenient(spark, str(tmp_path / "r.csv"))
    assert sorted(rows(good)) == [(1, "x", 2.5), (2, "y", None), (3, "z", 1.5)]
    assert sorted(r[readers.RAW] for r in odd.collect()) == ["2,y", "3,z,1.5,extra"]


def test_garbage_gives_a_readable_error(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes(bytes(range(256)) * 4)
    with pytest.raises(readers.UnreadableFile, match="could not be read"):
        readers.read_csv_lenient(spark, str(tmp_path / "g.csv"))


def test_column_names():
    assert sanitize_column_names(["\x1fPrice\r", " Price", "\x07"]) == ["Price", "Price_1", "unnamed"]
    assert sanitize_column_names(["x", "X", "x_1", "x"]) == ["x", "X_2", "x_1", "x_3"]
    assert sanitize_column_names(["w" * 400]) == ["w" * 400]
    assert sanitize_column_names(["w" * 400, "w" * 9], max_length=9) == ["w" * 9, "w" * 9 + "_1"]


def test_headers_reach_ingest_as_they_stand(spark, tmp_path):
    (tmp_path / "h.csv").write_text('k,K,,"two\nlines",k\n1,2,3,4,5\n')
    done = ingest(spark, str(tmp_path / "h.csv"), new_path(spark, "in"))
    table = spark.read.parquet(done.path)
    assert table.columns == ["k", "K_1", "unnamed", "twolines", "k_2"] and rows(table) == [(1, 2, 3, 4, 5)]


TEXTS = ['say "hi", ok', "a\nb", "", " blanks ", 'ends with "', "\"", "a\r\nb", "tab\there", "\\", "a,b;c|d"]


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "parquet"])
def test_texts_survive_every_format(spark, fmt):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "n long, t string")
    path = f"{new_path(spark, 'texts')}.{fmt}"
    writers.write_export(table, path, fmt)
    assert sorted(rows(readers.read_export(spark, path).select("n", "t"))) == list(enumerate(TEXTS))
    if fmt != "parquet":
        parts = f"{new_path(spark, 'parts')}.{fmt}"
        writers.split_export(table, parts, ["n"], 4, fmt)
        back = readers.read_export(spark, parts)
        assert sorted(rows(back.select("n", "t"))) == list(enumerate(TEXTS))
        assert sorted(rows(back.groupBy("part").count())) == [(1, 4), (2, 4), (3, 2)]


def test_json_is_told_by_its_beginning(spark, tmp_path):
    cases = {"lines": '\n {"a": 1}\n{"a": 2}\n', "array": '\n\n[{"a": 1},\n{"a": 2}]', "pretty": '{\n"a": 1\n}',
             "short": '[{"a": 1}, {"a": 2}]'}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
        want = [(1,)] if name == "pretty" else [(1,), (2,)]
        assert sorted(rows(readers.read_export(spark, str(tmp_path / f"{name}.json")), "a")) == want


def test_ingest_counts_caps_and_refuses(spark, ab):
    done = ingest(spark, ab, new_path(spark, "in"))
    assert (done.row_count, done.column_count) == (2, 2)
    capped = ingest(spark, ab, new_path(spark, "in"), max_rows=1, order_by=["a"])
    assert rows(spark.read.parquet(capped.path)) == [(1, "x")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        ingest(spark, ab, done.path)
    wide = ab.select(*[F.lit(1).alias(f"c{i}") for i in range(501)])
    assert ingest(spark, wide, new_path(spark, "in")).column_count == 501
    with pytest.raises(ValueError, match="501 columns"):
        ingest(spark, wide, new_path(spark, "in"), max_columns=500)


def test_split_export(spark):
    path = new_path(spark, "parts")
    writers.split_export(spark.range(25).withColumnRenamed("id", "k"), path, ["k"], 10)
    got = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert sorted(rows(got.groupBy("part").agg(F.count("k"), F.min("k"), F.max("k")))) == [
        (1, 10, 0, 9), (2, 10, 10, 19), (3, 5, 20, 24)]


def test_triage(spark, tmp_path):
    files = {"plain.tsv": (b"k\tv\n1\t2\n", None), "t.PQ": (b"PAR1\x15\x04", None), "t.pq": (b"k,v\n", "content is not .pq"),
             "calc.json": (b"MZ\x00\x03", "Windows executable"), "job.csv": (b"#!perl", "script"),
             "lib.csv": (b"\x7fELF\x02", "Linux executable"), "a.xlsx": (b"PK\x03\x04" + b"sheet\n" * 9, None),
             "b.xlsx": (b"PK\x03\x04\n\n" + b"z" * 90_000 + b"xl/macros", "contains macros"),
             "c.XLSM": (b"PK\x03\x04", "macro-enabled workbook"), "d.xls": (b"\xd0\xcf\x11\xe0", None),
             "folder.v2/README": (b"text", None), "huge.csv": (b"k,v\n" + b"1,2\n" * 200_000, None)}
    (tmp_path / "folder.v2").mkdir()
    for name, (raw, _) in files.items():
        (tmp_path / name).write_bytes(raw)
    found = {r.path.split(str(tmp_path) + "/")[-1]: r for r in triage_landing_zone(spark, str(tmp_path)).collect()}
    assert {name: r.reason for name, r in found.items()} == {name: reason for name, (_, reason) in files.items()}
    assert found["folder.v2/README"].ext == "" and found["t.PQ"].ext == "pq"
    one = spark.createDataFrame([("s3://in.v2/x/README", bytearray(b"text"))], "path string, content binary")
    assert rows(triage(one)) == [("s3://in.v2/x/README", "", "ok", None)]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
