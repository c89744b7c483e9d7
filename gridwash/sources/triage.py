"""Which files of a landing folder may be ingested, by their leading bytes and name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwash.functions.text import extension

# Leading bytes by extension, signatures of programs, macro markers inside workbooks.
MAGIC = {"xlsx": b"PK\x03\x04", "xls": b"\xd0\xcf\x11\xe0", "parquet": b"PAR1", "pq": b"PAR1"}
PROGRAMS = {b"MZ": "Windows executable", b"\x7fELF": "Linux executable", b"#!": "script"}
HEAD_BYTES = 16
MACRO_MARKERS = [b"vbaProject.bin", b"xl/vbaProject", b"xl/macros"]


def triage(files: DataFrame) -> DataFrame:
    """``(path, content)`` to path, extension, verdict and reason; the first broken rule is the reason."""
    head = lambda raw: F.substring(F.col("content"), 1, len(raw)) == F.lit(bytearray(raw))
    ext = extension(F.col("path"))
    reason = F.lit(None).cast("string")
    macros = reduce(lambda a, b: a | b, [F.contains(F.col("content"), F.lit(bytearray(m))) for m in MACRO_MARKERS])
    rules = [((ext == e) & ~head(raw), f"content is not .{e}") for e, raw in MAGIC.items()]
    rules += [(head(raw), text) for raw, text in PROGRAMS.items()]
    rules += [(ext == "xlsm", "macro-enabled workbook"), (ext.isin("xlsx", "xls") & macros, "contains macros")]
    reason = F.coalesce(*[F.when(rule, F.lit(text)) for rule, text in rules])
    return (files.withColumn("ext", ext).withColumn("reason", reason)
                 .withColumn("verdict", F.when(F.col("reason").isNull(), "ok").otherwise("rejected"))
                 .select("path", "ext", "verdict", "reason"))


def triage_landing_zone(spark: SparkSession, folder: str) -> DataFrame:
    """Triage of every file below a folder, of any size.

    Files are judged by their leading bytes, which come from a scan that holds one line at a time; only workbooks, whose
    macros may be anywhere, are looked at as a whole. Empty files hold nothing to ingest and are not listed.
    """
    def files(glob: str | None = None) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)

    lines = (spark.read.option("recursiveFileLookup", True).text(folder)
             .filter("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"),
                     F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES).alias("head")))
    heads = lines.groupBy("path").agg(F.min_by("head", "at").alias("head"))
    macros = files("*.[xX][lL][sS]*").select("path", reduce(lambda a, b: a | b, [
        F.contains(F.col("content"), F.lit(bytearray(m))) for m in MACRO_MARKERS]).alias("macros")).filter("macros")
    # What the rules look at: the head, and a marker in its place for workbooks that have one anywhere.
    content = F.concat(F.coalesce("head", F.lit(b"")), F.when(F.col("macros"), F.lit(bytearray(MACRO_MARKERS[0])))
                       .otherwise(F.lit(b"")))
    return triage(files().select("path").join(heads, "path", "left").join(macros, "path", "left")
                  .select("path", content.alias("content")))
