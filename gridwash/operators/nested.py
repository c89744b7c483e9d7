"""Nested records and JSON text to flat columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwash.operators.cells import quoted
from gridwash.operators.naming import unused
from gridwash.session import frozen

# Keys, those of inner objects included, that become columns without being asked for.
MOST_KEYS = 10_000


def _leaves(schema: T.StructType, base: str = "", path: str = "") -> list[tuple[str, str, T.DataType]]:
    """(dotted name, column path, type) of every leaf, depth first."""
    out = []
    for field in schema.fields:
        name = f"{base}.{field.name}" if base else field.name
        where = (f"{path}." if path else "") + "`" + field.name.replace("`", "``") + "`"
        if isinstance(field.dataType, T.StructType):
            out += _leaves(field.dataType, name, where)
        else:
            out.append((name, where, field.dataType))
    return out


def _leaf(where: str, kind: T.DataType, arrays_as_json: bool) -> Column:
    cell = F.col(where)
    return F.to_json(cell) if arrays_as_json and isinstance(kind, (T.ArrayType, T.MapType)) else cell


def flatten_struct(df: DataFrame, arrays_as_json: bool = True) -> DataFrame:
    """Nested records to ``a.b.c`` columns at any depth; arrays stay as JSON text."""
    return df.select(*[_leaf(w, k, arrays_as_json).alias(n) for n, w, k in _leaves(df.schema)])


def _text_leaves(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _text_leaves(f.dataType)) for f in kind.fields])
    return T.StringType()


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """``path array<string>, kind, rows``: each key at any depth of the objects in a JSON text column, the kind of its values
    (OBJECT, ARRAY, STRING, BIGINT, VOID …) and how many objects have it, as a table of any length.

    One level of the documents is taken apart after the other; only whether there is a further one comes to the driver. Text
    that is no JSON, and documents that are no objects, have no keys.
    """
    level = df.select(F.array().cast("array<string>").alias("path"), quoted(column).cast("string").alias("doc"))
    levels = []
    while True:
        cells = level.select("path", F.explode(F.try_variant_get(F.try_parse_json("doc"), "$", "map<string,variant>"))
                             .alias("key", "value"))
        kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("kind")
        found = cells.select(F.concat("path", F.array("key")).alias("path"), kind, "value")
        levels.append(found.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("rows")))
        level = frozen(found.filter("kind = 'OBJECT'").select("path", F.to_json("value").alias("doc")), "json-level")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)


def json_text_schema(df: DataFrame, column: str, most_keys: int = MOST_KEYS) -> T.StructType:
    """Union of the keys in a JSON text column, every leaf read as text.

    Spark merges the shapes in the executors; only the merged shape comes back. It is as long as there are keys, so keys are
    counted first, as far as the limit: data in the place of keys, such as one key per user, is refused. ``json_keys`` lists
    any number of them, and a ``map<string,string>`` reads them.
    """
    if json_keys(df, column).select("path").distinct().limit(most_keys + 1).count() > most_keys:
        raise ValueError(f"{column} has more than {most_keys} keys; give a schema, or read it as a map")
    shape = df.agg(F.schema_of_variant_agg(F.try_parse_json(quoted(column)))).first()[0] or "VOID"
    if not shape.startswith("OBJECT<"):
        raise ValueError(f"{column} does not hold JSON objects of one kind (found {shape[:80]})")
    ddl = re.sub(r"`(?:[^`]|``)*`|(?:^|(?<=: )|(?<=ARRAY<))(?:OBJECT(?=<)|VOID|VARIANT)",
                 lambda m: m[0] if m[0].startswith("`") else "STRUCT" if m[0] == "OBJECT" else "STRING", shape)
    return _text_leaves(T.StructType.fromDDL(f"doc {ddl}")["doc"].dataType)


def flatten_json_text(df: DataFrame, column: str, schema: T.StructType | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """JSON text to text columns ``<column>.<path>``; a missing or null key gives empty text."""
    schema = schema or json_text_schema(df, column, most_keys)
    doc = unused(df, "_doc")[0]
    parsed = df.withColumn(doc, F.from_json(quoted(column), schema))
    others = [quoted(c) for c in df.columns if c != column]
    flat = [F.coalesce(F.col(w), F.lit("")).alias(n)
            for n, w, _ in _leaves(T.StructType([T.StructField(doc, schema)]))]
    renamed = [c.alias(f"{column}.{n.removeprefix(doc + '.')}") for c, (n, _, _) in
               zip(flat, _leaves(T.StructType([T.StructField(doc, schema)])))]
    return parsed.select(*others, *renamed)


def unwrap_array(df: DataFrame) -> DataFrame:
    """``{"items": [...]}`` to one row per element; a record with NULL or no elements stays one row of NULLs.

    The first array field is taken. Elements that are no records become column ``value``.
    """
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not arrays:
        return df
    items = df.select(F.explode_outer(quoted(arrays[0].name)).alias("value"))
    if isinstance(arrays[0].dataType.elementType, T.StructType):
        return items.select("value.*")
    return items.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
