"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the only separators of words where an operator counts words.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str) -> Column:
    """The text of a column, NULL as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def crc_fold(id_column: str, folds: int) -> Column:
    """Fold of a row by crc32 of its id as text; NULL ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % folds, F.lit(0))



def bounded_batches(spark: SparkSession, rows: int = 2_000, size: str = "8m") -> None:
    """Bound what Python workers get at once by bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
