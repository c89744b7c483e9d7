"""From an export to the immutable original table."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridwash.operators.ordering import cap_rows
from gridwash.sources.readers import header_names, read_export

_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")


def sanitize_column_name(name: str, max_length: int | None = None) -> str:
    return _CONTROL.sub("", name).strip()[:max_length] or "unnamed"


def sanitize_column_names(names: Sequence[str], max_length: int | None = None) -> list[str]:
    """Clean names, unique in any case: a repeated name gets the first suffix ``_1``, ``_2``… that no column has."""
    cleaned = [sanitize_column_name(n, max_length) for n in names]
    used, wished, out = set(), {n.lower() for n in cleaned}, []
    for name in cleaned:
        choices = (f"{name}_{i}" for i in itertools.count(1))
        if name.lower() in used:
            name = next(c for c in choices if c.lower() not in used and c.lower() not in wished)
        used.add(name.lower())
        out.append(name)
    return out


def sanitize_columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Clean the column names, or ``names`` where the file's own header is at hand."""
    return df.toDF(*sanitize_column_names(names or df.columns))


@dataclass(frozen=True)
class Ingested:
    path: str
    row_count: int
    column_count: int


def ingest(spark: SparkSession, source: str | DataFrame, path: str, fmt: str | None = None,
           max_rows: int | None = None, order_by: Sequence[str] | None = None,
           max_columns: int | None = None) -> Ingested:
    """Read, clean the names, cap, refuse tables wider than ``max_columns``, write once.

    Names are those of the file's header. Too many columns fail before any row is read. Rows are counted while they are
    written, so the source is scanned once.
    """
    names = None
    if isinstance(source, str):
        kind = (fmt or source.rsplit(".", 1)[-1]).lower()
        names = header_names(spark, source, "\t" if kind == "tsv" else None) if kind in ("csv", "tsv") else None
        source = read_export(spark, source, fmt)
    df = sanitize_columns(source, names)
    if max_columns is not None and len(df.columns) > max_columns:
        raise ValueError(f"{len(df.columns)} columns; at most {max_columns} are supported")
    if max_rows is not None:
        df = cap_rows(df, max_rows, order_by)
    seen = Observation("ingest")
    (df.observe(seen, F.count(F.lit(1)).alias("rows"))
       .write.mode("errorifexists").option("compression", "zstd").parquet(path))
    return Ingested(path, seen.get["rows"], len(df.columns))
