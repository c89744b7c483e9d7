"""Writing results. Every writer runs in the executors, one file per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridwash.operators.ordering import number_parts
from gridwash.sources.readers import DIALECT


def _csv_options(sep: str = ",") -> dict:
    """The readers' dialect; cells keep the blanks at their ends."""
    return {**DIALECT, "header": True, "sep": sep, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    df.write.mode(mode).options(**_csv_options(sep)).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(df, path, mode, sep="\t")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; keys with NULL stay, so all records have the same keys."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_export(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    writers = {"csv": write_csv, "tsv": write_tsv, "json": write_json, "parquet": write_parquet}
    if fmt not in writers:
        raise ValueError(f"unsupported export format: {fmt}")
    writers[fmt](df, path, mode)


def split_export(df: DataFrame, path: str, order_by: Sequence[str], rows_per_part: int = 1_000_000,
                 fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Numbered folders ``part=1, part=2, …`` of exactly ``rows_per_part`` rows, order kept, header in each.

    A part has a fixed number of rows, so one task per part is a bounded task.
    """
    parts = number_parts(df, order_by, rows_per_part).repartition("part").sortWithinPartitions("part", *order_by)
    writer = parts.write.mode(mode).partitionBy("part")
    if fmt in ("csv", "tsv"):
        writer.options(**_csv_options("\t" if fmt == "tsv" else ",")).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
