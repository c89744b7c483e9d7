"""Lookups, ownership, orphans and set operations between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwash.operators.cells import quoted
from gridwash.operators.naming import unused
from gridwash.operators.segments import join_same
from gridwash.session import frozen

# A key with more than this share of the rows is hot, so there are at most 1/share hot keys.
HOT_SHARE = 0.001


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, at_least: int = 1_000_000) -> DataFrame:
    """Keys that hold more than a given share of all rows; never more than 1/share of them."""
    n = unused(keys, "_n")[0]
    counts = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias(n))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return counts.filter(F.col(n) > F.greatest(F.lit(at_least), total.scalar() * share)).drop(n)


def lookup_join(facts: DataFrame, lookup: DataFrame, left_on: str, right_on: str, how: str = "inner",
                split_hot: bool = False, hot_rows: int = 1_000_000) -> DataFrame:
    """Attach the one matching lookup row to each fact; misses are dropped or kept by ``how``.

    Spark picks the join by measured size and splits skewed partitions at run time. ``split_hot`` takes hot keys out of the
    shuffle instead: their lookup rows are sent to the facts where they are counted to be no more than the keys, of which
    there are at most 1/HOT_SHARE; a lookup with several rows for a hot key is joined as Spark sees fit. A key needs
    ``hot_rows`` rows to be worth it.
    """
    def joined(f: DataFrame, side: DataFrame, kind: str) -> DataFrame:
        return f.join(side, f[left_on] == side[right_on], kind)

    if not split_hot:
        return joined(facts, lookup, how)
    kind = how.lower().replace("_", "").removesuffix("outer")
    key = unused([*facts.columns, *lookup.columns], "_hot")[0]
    hot = frozen(hot_keys(facts.filter(quoted(left_on).isNotNull()), [left_on], at_least=hot_rows)
                 .select(quoted(left_on).alias(key)), "hot-keys")
    few = F.broadcast(hot)
    hot_lookup = lookup.join(few, quoted(right_on) == F.col(key), "left_semi")
    if hot_lookup.limit(int(1 / HOT_SHARE) + 1).count() <= hot.count():
        hot_lookup = F.broadcast(hot_lookup)
    # Every hot key has facts, so the lookup rows that no fact matches are all with the cold ones.
    within = {"right": "inner", "full": "left"}.get(kind, how)
    cold = joined(facts.join(few, quoted(left_on) == F.col(key), "left_anti"),
                  lookup.join(few, quoted(right_on) == F.col(key), "left_anti"), how)
    return cold.union(joined(facts.join(few, quoted(left_on) == F.col(key), "left_semi"), hot_lookup, within))


def first_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
                at: str, name: str) -> DataFrame:
    """Each parent with the earliest time of its children, NULL without any.

    Children are reduced to one row per key before the join.
    """
    key = unused([*parents.columns, name], "_k")[0]
    first = children.groupBy(quoted(child_key).alias(key)).agg(F.min(at).alias(name))
    return parents.join(first, parents[parent_key] == first[key], "left").drop(key)


def owned_rows(df: DataFrame, owner: str, user) -> DataFrame:
    return df.filter(quoted(owner) == F.lit(user))


def owned_through(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str,
                  owned: Column) -> DataFrame:
    """Child rows whose parent is owned."""
    mine = parents.filter(owned).select(quoted(parent_key).alias("_k"))
    return children.join(mine, children[child_key] == mine["_k"], "left_semi")


def orphans(stored: DataFrame, referring: DataFrame, stored_key: str, referring_key: str) -> DataFrame:
    """Stored rows that no referring row points to."""
    used = referring.select(quoted(referring_key).alias("_k")).distinct()
    return stored.join(used, stored[stored_key] == used["_k"], "left_anti")


def union_keys(*parts: DataFrame) -> DataFrame:
    """Distinct union by position."""
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def missing_columns(required: DataFrame, target: DataFrame) -> DataFrame:
    """Names in ``required(name, position)`` that ``target(name)`` lacks, ignoring case."""
    have = target.select(F.lower("name").alias("_k")).distinct()
    return required.join(have, F.lower(required["name"]) == have["_k"], "left_anti")


def cascade_preview(parents: DataFrame, parent_key: str, doomed: Column,
                    children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """How many rows a deletion of the doomed parents would take along, per table."""
    gone = parents.filter(doomed).select(quoted(parent_key).alias("_k"))
    out = gone.agg(F.lit("parents").alias("table_name"), F.count(F.lit(1)).alias("rows_removed"))
    for table, (child, key) in children.items():
        hit = child.join(gone.distinct(), child[key] == F.col("_k"), "left_semi")
        out = out.unionByName(hit.agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("rows_removed")))
    return out


def same_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal key names with NULL equal to NULL."""
    return join_same(left, right, keys, how)
