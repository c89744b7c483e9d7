"""Records of delimited text whose quoted cells may hold line breaks, cut by many tasks from one file.

Whether a line stands inside a quoted cell depends on everything before it. But all that a stretch of lines does to that is a
map of two states, and such maps can be put together: the lines of each split are folded into one map where they are, the maps
of a file are put together in order (one small row per split), and then every split knows how it begins and can be cut into
records. Only pieces of records that cross a border between splits are put together across tasks. The cells of a record are
left to Spark's own reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.session import frozen

PIECES = "path string, split long, at long, piece string, opens boolean, ends boolean"


@dataclass(frozen=True)
class QuoteRule:
    """How lines open and close quoted cells: a quote opens one at the start of a cell only; inside, two quotes are one."""
    sep: str

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        other = f"[^{re.escape(self.sep)}]"
        cell = rf'(?:"(?:[^"]++|"")*+"{other}*|(?!"){other}*)'
        # Whole cells up to the end of the line, or up to a quote that opens a cell and is not closed.
        outside = re.compile(rf'{cell}(?:{re.escape(self.sep)}{cell})*\Z', re.S)
        closing = re.compile(rf'(?:[^"]++|"")*+"{other}*(?:{re.escape(self.sep)}|\Z)', re.S)
        return outside, closing


class LineStates:
    """For each line whether it leaves the reader inside a quoted cell, from either state before it."""

    def __init__(self, rule: QuoteRule):
        self.outside, self.closing = rule.patterns()

    def after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        if inside:
            closed = self.closing.match(line)
            if closed is None:
                return True
            line = line[closed.end():]
            if not line:
                return False
        return self.outside.match(line) is None

    def both(self, line: str) -> tuple[bool, bool]:
        return self.after(line, False), self.after(line, True)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the split they are from, in the order of the file within each task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def _split_maps(lines: DataFrame, rule: QuoteRule) -> DataFrame:
    """``path, split, from_outside, from_inside``: whether the split ends inside a cell."""
    schema = "path string, split long, from_outside boolean, from_inside boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, done, now = LineStates(rule), {}, None
        for batch in batches:
            for path, split, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (path, split) != now:
                    now = (path, split)
                    done.setdefault(now, (False, True))
                if value is not None:
                    outside, inside = done[now]
                    both = states.both(value)
                    done[now] = (both[outside], both[inside])
        rows = [(*k, *v) for k, v in done.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["path", "split", "from_outside", "from_inside"])

    # Lines without quotes change nothing, but their split counts.
    quoted = F.when(F.col("value").contains('"'), F.col("value"))
    return lines.select("path", "split", quoted.alias("value")).mapInArrow(fold, schema)


def _starts(maps: DataFrame) -> dict[tuple[str, int], bool]:
    """Whether each split begins inside a quoted cell: the maps of a file put together in order.

    One short row per split comes to the driver, which holds the list of splits in any case.
    """
    out, path, inside = {}, None, False
    for row in maps.orderBy("path", "split").toLocalIterator():
        if row["path"] != path:
            path, inside = row["path"], False
        out[row["path"], row["split"]] = inside
        inside = row["from_inside"] if inside else row["from_outside"]
    return out


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``path, split, at, record`` for each record of each file, headers included: written once to the shared folder.

    ``split`` and ``at`` order the records of a file. A record has the text of the file, line breaks inside cells included,
    without the line break at its end. Lines without any character are no records. A quote that no other closes makes one
    record of the rest of its file, as Spark's reader does.
    """
    rule = QuoteRule(sep)
    starts = _starts(_split_maps(_lines(spark, path), rule))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, now, inside, held, at = LineStates(rule), None, False, [], 0
        out: list[tuple] = []

        def put(ends: bool) -> None:
            out.append((*now, at, "\n".join(held), at > 0 or not starts[now], ends))
            held.clear()

        def rows() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["path", "split", "at", "piece", "opens", "ends"])

        for batch in batches:
            for where, split, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (where, split) != now:
                    if held:  # the record ends in a later split
                        put(False)
                    now, at = (where, split), 0
                    if now not in starts:
                        raise RuntimeError(f"{where} was split in another way while it was read; read it again")
                    inside = starts[now]
                inside = states.after(value, inside)
                held.append(value)
                if not inside:
                    put(True)
                    at += 1
            if out:
                yield rows()
        if held:
            put(False)
            yield rows()

    pieces = frozen(_lines(spark, path).mapInArrow(cut, PIECES), "csv-pieces")
    whole = pieces.filter("opens AND ends").select("path", "split", "at", "piece")
    # At most two pieces of a split belong to records that cross its borders.
    parts = pieces.filter("NOT (opens AND ends)")
    nth = F.sum(F.col("opens").cast("long")).over(Window.partitionBy("path").orderBy("split", "at"))
    place = F.struct("split", "at")
    crossing = parts.withColumn("nth", nth).groupBy("path", "nth").agg(
        F.min(place).alias("first"), F.sort_array(F.collect_list(F.struct("split", "at", "piece"))).alias("pieces")).select(
        "path", "first.split", "first.at", F.array_join(F.transform("pieces", lambda x: x["piece"]), "\n").alias("piece"))
    record = F.regexp_replace(F.col("piece"), r"\r\z", "")
    opening = (F.col("split") == 0) & (F.col("at") == 0)
    record = F.when(opening, F.regexp_replace(record, "^\ufeff", "")).otherwise(record)
    return whole.unionByName(crossing).select("path", "split", "at", record.alias("record")).filter("record <> ''")
