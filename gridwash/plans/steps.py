"""Recorded steps and their replay.

A step is an operator name with plain arguments, so a chain can be stored as JSON and folded over any table. Most steps only
add to the plan, so Spark sees the chain at once and moves filters and column choices across step borders; those that must
look at the table first, such as fuzzy matching or empty columns, run jobs when they are applied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwash.operators import aggregates, cells, duplicates, nested, ordering, tidy, vocabulary
from gridwash.plans.guard import checked_query


@dataclass(frozen=True)
class Step:
    op: str
    args: dict[str, Any] = field(default_factory=dict)
    instruction: str = ""

    def to_json(self) -> str:
        return json.dumps({"op": self.op, "args": self.args, "instruction": self.instruction}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Step:
        raw = json.loads(text)
        return Step(raw["op"], raw.get("args", {}), raw.get("instruction", ""))


def sql_step(df: DataFrame, query: str) -> DataFrame:
    """One SELECT over ``data``, the result of the step before.

    Every mention of ``data`` means the current table, and besides it a query reads only its own subqueries, whatever the
    syntax: what the parser's tree has beyond that is refused (see ``guard``). Double quotes mark names. The caller's views
    and settings stay as they are: the table is bound under a name of its own, which is dropped once Spark has analysed
    the query.
    """
    spark = df.sparkSession
    text = checked_query(spark, query)
    view = f"step_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        return spark.sql(f"WITH data AS (SELECT * FROM {view}) (\n{text}\n)")
    finally:
        spark.catalog.dropTempView(view)


def _groupby(df: DataFrame, by: Sequence[str], aggs: Sequence[dict]) -> DataFrame:
    return aggregates.group_agg(df, by, aggs)


def _pivot(df: DataFrame, by: Sequence[str], on: str, values: Sequence, agg: str, prefix: str = "") -> DataFrame:
    return aggregates.pivot_table(df, by, on, values, F.expr(agg), prefix)


def _limit(df: DataFrame, n: int, sort: Sequence | None = None) -> DataFrame:
    order = [(s["col"], s.get("dir", "asc")) if isinstance(s, dict) else tuple(s) if isinstance(s, list) else s
             for s in sort or []]
    return ordering.cap_rows(df, n, order)


def _update(df: DataFrame, set: dict[str, Any], where: str | Sequence[str] | None = None) -> DataFrame:
    return cells.update_cells(df, set, where)


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "select": cells.select_columns,
    "drop_columns": cells.drop_columns,
    "rename": cells.rename_columns,
    "add_columns": cells.add_columns,
    "filter": cells.filter_rows,
    "filter_text": cells.filter_text,
    "dropna": cells.drop_null_rows,
    "fill_nulls": cells.fill_nulls,
    "update": _update,
    "concat": cells.concat_columns,
    "round": cells.round_columns,
    "cast": cells.cast_column,
    "normalize_case": cells.normalize_case,
    "standardize_dates": cells.standardize_dates,
    "parse_numbers": cells.parse_numbers,
    "clean_text": tidy.clean_text,
    "drop_empty_rows": tidy.drop_empty_rows,
    "drop_empty_columns": tidy.drop_empty_columns,
    "distinct": duplicates.distinct_rows,
    "distinct_on": duplicates.first_per_key,
    "keep_first": duplicates.keep_first,
    "groupby": _groupby,
    "pivot": _pivot,
    "sort": ordering.sort_rows,
    "limit": _limit,
    "flatten": nested.flatten_struct,
    "flatten_json_text": nested.flatten_json_text,
    "unwrap_array": nested.unwrap_array,
    "fuzzy_match": vocabulary.fuzzy_match,
    "sql": sql_step,
}

# Steps that look at one row at a time, so they mean the same on a stream or on a part of a table.
ROW_WISE = {
    "select", "drop_columns", "rename", "add_columns", "filter", "filter_text", "dropna", "fill_nulls", "update",
    "concat", "round", "cast", "normalize_case", "standardize_dates", "parse_numbers", "clean_text",
    "drop_empty_rows", "flatten", "fuzzy_match",
}


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    if step.op not in OPERATORS:
        raise ValueError(f"unknown step {step.op!r}")
    return OPERATORS[step.op](df, **step.args)


def replay(df: DataFrame, steps: Sequence[Step], up_to: int | None = None) -> DataFrame:
    """The table after the first ``up_to`` steps, all of them by default, none with 0."""
    if up_to is not None and not 0 <= up_to <= len(steps):
        raise ValueError(f"up_to must lie between 0 and {len(steps)}")
    for step in steps[:up_to]:
        df = apply_step(df, step)
    return df
