"""Names for helper columns that no table has yet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def unused(taken: DataFrame | Iterable[str], *stems: str) -> list[str]:
    """One name per stem that differs, in any case, from every name taken and from each other."""
    names = {n.lower() for n in (taken.columns if isinstance(taken, DataFrame) else taken)}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in names:
            name += "_"
        names.add(name.lower())
        out.append(name)
    return out
