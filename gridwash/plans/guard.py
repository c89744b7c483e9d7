"""What a query reads, told from the tree that Spark's parser makes of it, and a scan of stored queries by the same rule.

A query passes when every relation in its tree is ``data`` or one of its own named subqueries where that name holds, and when
every node is one that only works on such relations. What is not known to be harmless is refused: names that are computed,
table functions, versions of a table, options, streams, commands, scripts. The whole tree is walked, plans inside expressions
and window definitions included.
"""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwash.operators.naming import unused
from gridwash.plans import policy
from gridwash.session import frozen, new_path

OTHER_TABLE = "reads another table"
NOT_QUERY = "not a query"
TABLE = "data"

# Nodes of a parsed query that read nothing themselves.
HARMLESS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "Repartition", "RepartitionByExpression",
    "ResolvedInlineTable", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint",
    "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "Unpivot", "WithWindowDefinition", "PipeExpression",
    "UnresolvedOrdinal", "UnresolvedGroupByAll",
}
NAMES = {  # what to call nodes that are refused
    "PlanWithUnresolvedIdentifier": "IDENTIFIER", "ExpressionWithUnresolvedIdentifier": "IDENTIFIER",
    "RelationTimeTravel": "AS OF", "ScriptTransformation": "TRANSFORM",
}
CALLS = re.compile(r"read_\w+|\w+_scan|glob|sniff_csv|reflect|java_method|try_reflect", re.I)


class _Tree:
    """One walk over one parsed query; raises PolicyError at the first thing that is refused."""

    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway
        self.exact = spark.conf.get("spark.sql.caseSensitive") == "true"

    def is_a(self, thing: JavaObject, name: str) -> bool:
        return is_instance_of(self.gateway, thing, name)

    def items(self, values: JavaObject):
        while values.hasNext():
            yield values.next()

    def name(self, text: str) -> str:
        return text if self.exact else text.lower()

    def visit(self, thing, scope: frozenset[str]) -> None:
        if not isinstance(thing, JavaObject):
            return
        if self.is_a(thing, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
            self.plan(thing, scope)
        elif self.is_a(thing, "org.apache.spark.sql.catalyst.expressions.Expression"):
            self.expression(thing, scope)
        elif self.is_a(thing, "scala.collection.Iterable"):
            for item in self.items(thing.iterator()):
                self.visit(item, scope)
        elif self.is_a(thing, "scala.Product") and not self.is_a(thing, "org.apache.spark.sql.types.DataType"):
            for item in self.items(thing.productIterator()):
                self.visit(item, scope)

    def inside(self, node: JavaObject, scope: frozenset[str]) -> None:
        for item in self.items(node.productIterator()):
            self.visit(item, scope)

    def plan(self, node: JavaObject, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind == "UnresolvedWith":
            for named in self.items(node.cteRelations().iterator()):
                own = self.name(named._1())
                self.visit(named._2(), scope | {own} if node.allowRecursion() else scope)
                scope = scope | {own}  # later subqueries and the query itself see it
            self.visit(node.child(), scope)
        elif kind == "UnresolvedRelation":
            parts = list(self.items(node.multipartIdentifier().iterator()))
            plain = len(parts) == 1 and node.options().isEmpty() and not node.isStreaming()
            if not plain or self.name(parts[0]) not in scope:
                raise policy.PolicyError(OTHER_TABLE, ".".join(parts))
        elif kind == "UnresolvedTableValuedFunction":
            raise policy.PolicyError(OTHER_TABLE, ".".join(self.items(node.name().iterator())))
        elif kind not in HARMLESS:
            raise policy.PolicyError(OTHER_TABLE, NAMES.get(kind, kind))
        else:
            self.inside(node, scope)

    def expression(self, node: JavaObject, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind in NAMES:
            raise policy.PolicyError(OTHER_TABLE, NAMES[kind])
        if kind == "UnresolvedFunction":
            called = list(self.items(node.nameParts().iterator()))
            if CALLS.fullmatch(called[-1]):  # a name in back quotes is hidden from the rules on the text
                raise policy.PolicyError(policy.BLOCKED_CALL, called[-1].upper())
        if kind not in ("Literal", "UnresolvedAttribute", "UnresolvedStar"):
            self.inside(node, scope)


def check_tables(spark: SparkSession, text: str) -> None:
    """Raises PolicyError unless a query, whose names are in back quotes, reads ``data`` and its own subqueries alone."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as exc:
        raise policy.PolicyError(NOT_QUERY, str(exc).strip().splitlines()[0]) from None
    _Tree(spark).visit(tree, frozenset([TABLE]))


def checked_query(spark: SparkSession, sql: str | None) -> str:
    """The text of a SQL step as it may run, or PolicyError with the first rule it breaks."""
    text = policy.names_in_backticks(policy.check_sql(sql))
    check_tables(spark, text)
    return text


# Literals decide nothing about what is read, so texts that differ in them alone have one shape, which is parsed once.
_NAME = r'''"(?:[^"]|"")*+"|`(?:[^`]|``)*+`'''
_LITERAL = r"[rR](')[^']*+'|(')(?:[^'\\]++|\\.|'')*+'"
_COMMENT = r"--[^\r\n]*+|/\*(?!\+)(?s:.*?)\*/"
_NUMBER = r"(?<![\w.])[0-9]*([0-9])(?![\w.])"
SHAPES_AT_ONCE = 1_000


def shape(cleaned: Column) -> Column:
    """The text with every literal empty, whole numbers cut to their last digit, and no comments."""
    bare = F.regexp_replace(cleaned, f"({_NAME})|{_LITERAL}|{_COMMENT}", "$1$2$2$3$3 ")
    return F.regexp_replace(bare, f"({_NAME})|{_NUMBER}", "$1$2")


def policy_scan(df: DataFrame, sql_column: str) -> DataFrame:
    """Cleaned text, verdict ('ok' or the first broken rule) and what broke it, per row, as a step with it would be judged.

    The rules on the text run where the rows are. Parsing takes the driver, which alone has Spark's parser: of the texts that
    pass, each distinct shape goes there once, a partition at a time, and its verdict is written to the shared folder and
    joined back. Stored steps come from few patterns; the shapes of arbitrary texts are as many as the texts.
    """
    judged = frozen(policy.text_scan(df, sql_column), "judged")  # the patterns run once, and not again in what follows
    key, kind, hit = unused([*judged.columns], "shape", "shape_verdict", "shape_blocked")
    shaped = judged.withColumn(key, F.when(F.col("verdict") == "ok", shape(F.col("cleaned_sql"))))
    verdicts = _shape_verdicts(shaped.filter(F.col(key).isNotNull()).select(F.col(key).alias("shape")).distinct())
    found = shaped.join(verdicts.toDF(key, kind, hit), key, "left")
    kept = [F.col(f"`{c}`") for c in judged.columns[:-2]]
    return found.select(*kept, F.coalesce(F.col(kind), F.col("verdict")).alias("verdict"),
                        F.coalesce(F.col(hit), F.col("blocked_keyword")).alias("blocked_keyword"))


def _shape_verdicts(shapes: DataFrame) -> DataFrame:
    """``shape, verdict, blocked`` for the shapes that may not run."""
    spark, schema = shapes.sparkSession, "shape string, verdict string, blocked string"
    path = new_path(spark, "shape-verdicts")
    spark.createDataFrame([], schema).write.parquet(path)
    refused: list[tuple] = []

    def put() -> None:
        if refused:
            spark.createDataFrame(refused, schema).coalesce(1).write.mode("append").parquet(path)
            refused.clear()

    for row in frozen(shapes, "shapes").toLocalIterator():
        try:
            check_tables(spark, policy.names_in_backticks(row["shape"]))
        except policy.PolicyError as exc:
            refused.append((row["shape"], exc.verdict, None if exc.verdict == NOT_QUERY else exc.blocked))
        if len(refused) >= SHAPES_AT_ONCE:
            put()
    put()
    return spark.read.schema(schema).parquet(path)
