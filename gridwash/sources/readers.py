"""Reading exports: CSV, TSV, JSON, JSON lines, Parquet."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwash.functions.text import WHITE_SPACE
from gridwash.session import frozen
from gridwash.sources.records import records

DELIMITERS = [",", "\t", ";", "|"]
RAW = "_raw_line"
SNIFFED = 65_536  # characters of a line that are looked at
SNIFFED_LINES = 20
# One dialect for readers and writers: a quote inside a quoted cell is doubled, and such cells may hold line breaks.
DIALECT = {"quote": '"', "escape": '"'}


class UnreadableFile(ValueError):
    """A file that is no table even when read leniently; the text is fit to show to people."""


def _first_line(spark: SparkSession, path: str) -> str:
    """The beginning of the first line that is not blank."""
    line = F.substring("value", 1, SNIFFED)
    rows = spark.read.text(path).select(line.alias("line")).filter(F.trim("line") != "").limit(1).collect()
    return rows[0][0] if rows else ""


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The usual delimiter that the first lines have most evenly outside quoted cells: in the header, and as often in as
    many of the next lines as possible; between equals the more frequent one. A comma if the header has none of them."""
    lines = [r[0] for r in spark.read.text(path).select(F.substring("value", 1, SNIFFED)).filter(
        F.trim("value") != "").limit(SNIFFED_LINES).collect()]
    text = re.sub(r'"(?:[^"]|"")*(?:"|\Z)', "", "\n".join(lines))
    header, *others = text.split("\n")

    def evenness(sep: str) -> tuple:
        count = header.count(sep)
        return (count > 0, sum(line.count(sep) == count for line in others), count)

    return max(DELIMITERS, key=evenness)


def _widened(schema: T.StructType) -> T.StructType:
    """Inferred 32-bit integers become 64-bit, so a later export with larger numbers still fits."""
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType)
                         for f in schema.fields])


def _csv_reader(spark: SparkSession, sep: str, multi_line: bool, header: bool = True) -> DataFrameReader:
    return spark.read.options(**DIALECT).option("header", header).option("sep", sep).option("multiLine", multi_line)


def _csv_schema(spark: SparkSession, path: str, sep: str, sampling: float, multi_line: bool = True) -> T.StructType:
    inferred = (_csv_reader(spark, sep, multi_line).option("inferSchema", True)
                .option("samplingRatio", sampling).csv(path))
    return _widened(inferred.schema)


def _cut_in_parallel(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than what one task should read."""
    most = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return (most or 0) > spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


class _Records:
    """A folder or file of delimited text as records, one header per file."""

    def __init__(self, spark: SparkSession, path: str, sep: str, header: bool = True):
        self.spark, self.sep, self.header = spark, sep, header
        found = records(spark, path, sep)
        first = F.struct("split", "at")
        if header:
            heads = found.groupBy("path").agg(F.min(first).alias("place"), F.min_by("record", first).alias("record"))
            self.heads = frozen(heads, "csv-heads")
            top = self.heads.orderBy("path").select("record").first()
            self.head = top["record"] if top else None
            places = self.heads.select("path", F.col("place.split").alias("split"), F.col("place.at").alias("at"))
            found = found.join(places, ["path", "split", "at"], "left_anti")
        self.rows = found.select("record")

    def _reader(self, **options):
        reader = self.spark._jsparkSession.read()
        for name, value in {**DIALECT, "sep": self.sep, "multiLine": "true", **options}.items():
            reader = reader.option(name, value)
        return reader

    def _texts(self, rows: DataFrame):
        return rows._jdf.__getattr__("as")(self.spark._jvm.org.apache.spark.sql.Encoders.STRING())

    def schema(self, sampling: float = 1.0) -> T.StructType:
        """As Spark's reader infers it from a header and its rows."""
        if self.header and self.head is None:
            return T.StructType([])
        rows = self.rows
        if self.header:
            if rows.filter(F.col("record") == self.head).limit(1).count():  # the reader would take such rows for headers
                sampling, rows = 1.0, rows.limit(0)
            rows = self.spark.createDataFrame([(self.head,)], "record string").unionByName(rows)
        jdf = self._reader(header=str(self.header).lower(), inferSchema="true", samplingRatio=str(sampling)).csv(self._texts(rows))
        return _widened(T.StructType.fromJson(json.loads(jdf.schema().json())))

    def table(self, schema: T.StructType, **options: str) -> DataFrame:
        if not schema.fields:
            return self.spark.createDataFrame([], schema)
        names = {f.name: f"c{i}" for i, f in enumerate(schema.fields)}
        ddl = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in schema.fields)
        raw = {"columnNameOfCorruptRecord": names[RAW]} if RAW in names else {}
        cells = F.from_csv("record", ddl, {**DIALECT, "sep": self.sep, "multiLine": "true", **raw, **options})
        return self.rows.select(cells.alias("cells")).select("cells.*").toDF(*names)


def _as_struct(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str | None = None,
             sampling: float = 1.0, multi_line: bool = True, parallel: bool | None = None) -> DataFrame:
    """Delimited text with a header. A given schema saves the pass that infers one.

    Quoted cells may hold line breaks. Files that one task can read are each read by one; with ``parallel`` (by default where
    a file is larger than a split) many tasks cut each file into records, which are written to the shared folder first.
    ``multi_line=False`` splits files that are known to have no line breaks in cells, without that.
    """
    sep = sep or sniff_delimiter(spark, path)
    if multi_line and (_cut_in_parallel(spark, path) if parallel is None else parallel):
        found = _Records(spark, path, sep)
        return found.table(_as_struct(spark, schema) if schema else found.schema(sampling), nullValue="\x00")
    schema = schema or _csv_schema(spark, path, sep, sampling, multi_line)
    # A mark that no cell has stands for NULL, so that a quoted empty cell is an empty text and an unquoted one NULL.
    return _csv_reader(spark, sep, multi_line).option("nullValue", "\x00").schema(schema).csv(path)


def header_names(spark: SparkSession, path: str, sep: str | None = None) -> list[str]:
    """The header as it stands in the file; Spark renames repeated and blank names when it reads one."""
    first = _csv_reader(spark, sep or sniff_delimiter(spark, path), True, header=False).csv(path).first()
    return [c or "" for c in first] if first else []


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_csv_lenient(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     sep: str | None = None, header: bool = True, multi_line: bool = True,
                     parallel: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Every row, short ones padded with NULL, and separately the rows that did not fit, with their raw line.

    Spark finds misfits while it parses all columns, so read the second table whole or save it first. ``parallel`` is that of
    ``read_csv``.
    """
    line = _first_line(spark, path)
    if "\x00" in line or not line.strip():
        raise UnreadableFile("This file could not be read as a table. Saving it again as a standard CSV usually helps.")
    try:
        sep = sep or sniff_delimiter(spark, path)
        if multi_line and (_cut_in_parallel(spark, path) if parallel is None else parallel):
            found = _Records(spark, path, sep, header)
            marked = T.StructType([*(schema or found.schema()).fields, T.StructField(RAW, T.StringType())])
            df = found.table(marked, mode="PERMISSIVE")
            return df.drop(RAW), df.filter(F.col(RAW).isNotNull())
        schema = schema or _csv_schema(spark, path, sep, 1.0, multi_line)
        marked = T.StructType([*schema.fields, T.StructField(RAW, T.StringType())])
        df = (_csv_reader(spark, sep, multi_line, header).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", RAW).schema(marked).csv(path))
    except AnalysisException as exc:
        raise UnreadableFile("This file could not be read as a table.") from exc
    return df.drop(RAW), df.filter(F.col(RAW).isNotNull())


def json_by_lines(spark: SparkSession, path: str) -> bool:
    """Whether JSON text holds a record per line, by its first line that is not blank: an array, or a record that goes on in
    the next line, is read as a whole."""
    line = F.trim(F.col("value"), F.lit(WHITE_SPACE))
    whole = line.startswith("{") & F.try_parse_json(line).isNotNull()
    first = spark.read.text(path).select(line.alias("line"), whole.alias("whole")).filter("line <> ''").select("whole").first()
    return first is None or bool(first.whole)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              lines: bool | None = None) -> DataFrame:
    """Records of JSON text, one per line or whole files of an array or a record; by default as the text begins."""
    lines = json_by_lines(spark, path) if lines is None else lines
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_export(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by format, by default the one the file name ends in."""
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    readers = {"csv": read_csv, "tsv": read_tsv, "parquet": read_parquet, "pq": read_parquet,
               "jsonl": lambda s, p: read_json(s, p, lines=True), "json": read_json}
    if fmt not in readers:
        raise ValueError(f"unsupported format {fmt!r}; use one of {sorted(readers)}")
    return readers[fmt](spark, path)
