"""Tell clarifications, insights and SQL apart in model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwash.functions.text import trim_ws

_EMPTY_VALUES = ["", "false", "0", "0.0", "-0.0", "[]", "{}"]


def _truthy(doc: Column, field: str) -> Column:
    """Present and neither null, false, zero, empty text, empty list nor empty object."""
    cell = F.try_variant_get(doc, f"$.{field}", "variant")
    kind = F.schema_of_variant(cell)
    text = F.to_json(cell)
    is_text = kind == "STRING"
    empty = (kind == "VOID") | F.when(is_text, text == '""').otherwise(text.isin(_EMPTY_VALUES))
    return F.coalesce(cell.isNotNull() & ~empty, F.lit(False))


def classify_reply(c: Column) -> Column:
    """'clarification', 'insight' or 'sql'; broken JSON counts as SQL."""
    body = trim_ws(c)
    doc = F.try_parse_json(F.when(body.startswith("{") & body.endswith("}"), body))
    return (F.when(_truthy(doc, "needs_clarification"), "clarification")
             .when(_truthy(doc, "insight"), "insight")
             .otherwise("sql"))
