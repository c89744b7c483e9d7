"""Named chains: snapshot, append, check and apply, on one export or on many."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gridwash.operators.cells import quoted
from gridwash.operators.segments import row_numbers
from gridwash.operators.tidy import text_columns
from gridwash.plans.policy import PolicyError, check_sql, code_of
from gridwash.plans.steps import ROW_WISE, Step, apply_step, replay


class RecipeError(ValueError):
    """A recipe that cannot be built or does not fit the table."""


@dataclass(frozen=True)
class Recipe:
    name: str
    steps: tuple[Step, ...]
    required_columns: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        if not self.steps:
            raise RecipeError("a recipe needs at least one step")

    @staticmethod
    def of(name: str, source: DataFrame, steps: Sequence[Step]) -> Recipe:
        return Recipe(name, tuple(steps), tuple((f.name, f.dataType.simpleString()) for f in source.schema.fields))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "steps": [json.loads(s.to_json()) for s in self.steps],
                           "required_columns": [list(c) for c in self.required_columns]})

    @staticmethod
    def from_json(text: str) -> Recipe:
        raw = json.loads(text)
        return Recipe(raw["name"], tuple(Step(s["op"], s.get("args", {}), s.get("instruction", ""))
                                         for s in raw["steps"]),
                      tuple(tuple(c) for c in raw.get("required_columns", [])))

    @staticmethod
    def from_rows(name: str, rows: Sequence, required_columns: Sequence[tuple[str, str]] = ()) -> Recipe:
        """From stored rows of ``step_number, instruction, sql_query``, in any order; every step is a SQL step."""
        ordered = sorted((r.asDict() if isinstance(r, Row) else dict(r) for r in rows), key=lambda r: r["step_number"])
        return Recipe(name, tuple(Step("sql", {"query": r["sql_query"]}, (r.get("instruction") or "").strip())
                                  for r in ordered), tuple(required_columns)).validated()

    def missing_in(self, target: DataFrame) -> list[str]:
        """Source columns the target lacks, ignoring case, in source order."""
        have = {c.lower() for c in target.columns}
        return [name for name, _ in self.required_columns if name.lower() not in have]

    def validated(self) -> Recipe:
        """Check every SQL step against the rules of today."""
        for i, step in enumerate(self.steps, 1):
            if step.op == "sql":
                try:
                    check_sql(step.args["query"])
                except PolicyError as exc:
                    raise RecipeError(f"step {i} of {self.name} is not allowed: {exc}") from exc
        return self


def apply_recipe(recipe: Recipe, target: DataFrame, existing: Sequence[Step] = ()) -> DataFrame:
    """Existing steps, then the recipe's, as one plan.

    Spark analyses the plan here, so a table that does not fit fails before any job runs.
    """
    recipe.validated()
    try:
        return replay(target, [*existing, *recipe.steps])
    except AnalysisException as exc:
        lacking = recipe.missing_in(target)
        hint = f"; the table lacks {', '.join(lacking)}" if lacking else ""
        raise RecipeError(f"recipe {recipe.name} does not fit this table{hint}") from exc


def apply_recipe_many(recipe: Recipe, exports: DataFrame, export_column: str) -> DataFrame:
    """One recipe over many exports read as one table, with the result of each export as if it were alone.

    Row-wise steps need nothing; grouping, distinct and keep-first steps carry the export along as a further key. From the
    first step on that looks at other rows in any other way (SQL, windows, limits, pivots and what finds its columns in the
    data), the exports go on one by one: their names come to the driver, and the plan has one branch for each.
    """
    df, steps = exports, list(recipe.validated().steps)
    while steps:
        step = _with_export(df, steps[0], export_column)
        if step is None:
            return _one_by_one(df, steps, export_column)
        df = apply_step(df, step)
        steps.pop(0)
    return df


def _with_export(df: DataFrame, step: Step, export: str) -> Step | None:
    """The step as it means the same on all exports together, None if there is no such form."""
    others = [c for c in df.columns if c != export]
    args = step.args
    if step.op == "groupby":
        return Step("groupby", {**args, "by": [export, *args["by"]]})
    if step.op in ("distinct_on", "keep_first"):
        return Step(step.op, {**args, "keys": [export, *args["keys"]]}) if args.get("keys") else None
    if step.op == "select":
        return Step("select", {"columns": [export, *args["columns"]]})
    if step.op in ("drop_empty_rows", "dropna"):
        return Step(step.op, {"columns": list(args.get("columns") or others)})
    if step.op == "clean_text":
        return Step(step.op, {**args, "columns": list(args.get("columns") or [c for c in text_columns(df) if c != export])})
    if step.op in ("add_columns", "filter", "update"):
        found = [item["expr"] for item in args["columns"]] if step.op == "add_columns" else args.get("where") or []
        return step if _looks_at_one_row([found] if isinstance(found, str) else found) else None
    return step if step.op in ROW_WISE or step.op in ("distinct", "sort") else None


def _looks_at_one_row(expressions: Sequence[str]) -> bool:
    """No window, aggregate or subquery; anything that could be one counts as one."""
    code = " ".join(code_of(e) for e in expressions)
    return not re.search(r"(?i)\bover\b|\bselect\b|\b(?:sum|avg|mean|min|max|count|first|last|median|mode|stddev|variance|"
                         r"percentile|approx|collect|any|every|some|bool|rank|row_number|lag|lead|ntile)\w*\s*\(", code)


def _one_by_one(df: DataFrame, steps: Sequence[Step], export: str) -> DataFrame:
    """The remaining steps on each export alone, put together by name with the export as first column."""
    others = [c for c in df.columns if c != export]
    names = sorted((r[0] for r in df.select(quoted(export)).distinct().collect()), key=lambda n: (n is None, str(n)))
    parts = [replay(df.filter(quoted(export).eqNullSafe(F.lit(n))).select(*map(quoted, others)), steps)
             .select(F.lit(n).cast(df.schema[export].dataType).alias(export), "*") for n in names]
    if not parts:
        return replay(df.select(*map(quoted, others)), steps).select(F.lit(None).cast(df.schema[export].dataType).alias(export), "*")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def snapshot_steps(steps: DataFrame, chain: str = "file_id") -> DataFrame:
    """Stored chain rows to recipe rows: ordered, renumbered from 1, instruction trimmed, three fields kept."""
    numbered = row_numbers(steps, [chain], ["step_number"], "_n")
    return numbered.select(chain, F.col("_n").alias("step_number"),
                           F.trim(F.coalesce("instruction", F.lit(""))).alias("instruction"), "sql_query")


def require_steps(chains: DataFrame, steps: DataFrame, chain: str = "file_id") -> DataFrame:
    """Chains that have no step and so cannot be saved."""
    return chains.join(steps.select(chain).distinct(), chain, "left_anti")


def renumber_after(recipe_steps: DataFrame, existing: DataFrame, chain: str = "file_id") -> DataFrame:
    """Recipe rows renumbered to follow the steps the target already has."""
    have = existing.groupBy(F.col(chain).alias("_c")).agg(F.count(F.lit(1)).alias("_have"))
    joined = recipe_steps.join(have, recipe_steps[chain] == have["_c"], "left").drop("_c")
    return (joined.withColumn("step_number", F.col("step_number") + F.coalesce("_have", F.lit(0))).drop("_have"))
