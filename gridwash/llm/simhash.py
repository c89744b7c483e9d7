"""Near-duplicates by SimHash fingerprints, exact, with pigeonring filtering of candidates.

1. A text becomes a 64-bit fingerprint of its word shingles. Equal fingerprints are one vertex from here on, so a group of
   exact copies of any size costs one row.
2. Fingerprints are cut into ``distance + c`` segments. Two within ``distance`` bits agree on at least ``c`` whole segments,
   so rows meet under each choice of ``c`` segments. ``c`` follows from the number of fingerprints, at every size alike.
3. Pairs that meet must pass the pigeonring condition: from some segment on, going round the ring, each chain of 1, 2, 3 ...
   consecutive segments has at most its proportional share of differing bits. Survivors get the full Hamming check.
4. Pairs are never emitted: a meeting point reports one row per linked member (its smallest reachable member).
   Meeting points with more than ``max_meeting`` members are not compared pair by pair at all. Their members go to
   half-way points instead: two fingerprints within ``distance`` bits share a point that is at most half as far from each,
   and all that share such a point, having at most half the distance to it, are linked for certain. That is exact and
   linear in the members, whatever their number.
5. Links become components by label propagation over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from gridwash.llm.common import bounded_batches, text_of
from gridwash.llm.components import components
from gridwash.session import frozen

SHINGLE = 4
DISTANCE = 4
SEED = 42
MAX_MEETING = 4096
CHANCE_MEETINGS = 1 / 8  # unrelated fingerprints that one may meet by chance under one choice of segments, about


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> list[int]:
    """Hashes of all runs of so many words; a shorter text is one run, one without words has none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: ASCII letters and white space only
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, seed)]
    after = np.cumsum([len(w) + 1 for w in found])
    starts, ends = [0, *after[:-1].tolist()], (after - 1).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:])]


def fingerprint_of(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    hashes = shingle_hashes(text, words, seed)
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype=np.uint64)
    for at in range(0, len(packed), 65_536):  # a very long text in parts, 4 MB of bits each
        bits = np.unpackbits(packed[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(packed), bitorder="little").view(np.int64)[0])


@pandas_udf(LongType())
def _fingerprint(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, words in batches:
        yield pd.Series([fingerprint_of(t, k) for t, k in zip(texts, words)], dtype="int64")


def fingerprint(text: Column, words: int = SHINGLE) -> Column:
    return _fingerprint(text, F.lit(words))


def segments(parts: int) -> list[int]:
    """Bit masks of ``parts`` consecutive segments of 64 bits."""
    borders = [64 * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(borders, borders[1:])]


def exact_segments(rows: int, distance: int) -> int:
    """How many segments must agree, so that few unrelated fingerprints out of ``rows`` meet by chance."""
    exact = 1
    while exact < 12 and rows > CHANCE_MEETINGS * 2.0 ** (64 * exact / (distance + exact)):
        exact += 1
    return exact


def pigeonring(differing: np.ndarray, parts: int, distance: int) -> np.ndarray:
    """Which XORs of two fingerprints have a segment from where all chains keep within their proportional budgets."""
    counts = [np.bitwise_count(differing & np.uint64(m)) for m in segments(parts)]
    passed = np.zeros(len(differing), dtype=bool)
    for start in range(parts):
        alive = np.flatnonzero(~passed)
        total = np.zeros(len(alive), dtype=np.int64)
        for length in range(1, parts + 1):
            total = total + counts[(start + length - 1) % parts][alive]
            keep = total <= length * distance // parts
            alive, total = alive[keep], total[keep]
            if not len(alive):
                break
        passed[alive] = True
    return passed


def linked_within(members: np.ndarray, parts: int, distance: int) -> np.ndarray:
    """For each of some fingerprints the index of the smallest one it is linked with, directly or over others.

    Links are all pairs within ``distance`` bits; pairs are looked at in blocks of rows, so memory is bounded.
    """
    bits, n = members.view(np.uint64), len(members)
    label = np.arange(n)
    block = max(1, 262_144 // n)
    for low in range(0, n, block):
        left, right = np.nonzero(np.arange(low, min(n, low + block))[:, None] < np.arange(n)[None, :])
        left = left + low
        differing = bits[left] ^ bits[right]
        near = np.flatnonzero(pigeonring(differing, parts, distance))
        near = near[np.bitwise_count(differing[near]) <= distance]
        a, b = left[near], right[near]
        while len(a):  # the larger root of each link takes over the smaller one
            ra, rb = label[a], label[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label = further
    return label


def _meetings(parts: int, exact: int) -> Column:
    """All keys under which a fingerprint ``fp`` meets others."""
    masks = segments(parts)
    signed = [sum(c) - (1 << 64 if sum(c) >= 1 << 63 else 0) for c in combinations(masks, exact)]
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                     for i, m in enumerate(signed)])


def links(fingerprints: DataFrame, distance: int = DISTANCE, max_meeting: int = MAX_MEETING) -> DataFrame:
    """Edges ``a, b`` with the same components as the graph of all pairs of distinct ``fp`` within ``distance`` bits."""
    exact = exact_segments(fingerprints.count(), distance)
    parts = distance + exact
    keyed = fingerprints.select("fp", F.explode(_meetings(parts, exact)).alias("at")).select("at.choice", "at.bits", "fp")
    # Meeting points of a large part of all rows are told from a 64th of them, and their rows take the other exact way
    # without ever coming together; the stream below notices every one that this misses.
    sampled = keyed.filter(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0).groupBy("choice", "bits").agg(
        F.count(F.lit(1)).alias("members"))
    huge = frozen(sampled.filter(F.col("members") > max(2, max_meeting // 32)).select("choice", "bits"), "meetings")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, crowded = np.empty((0, 3), dtype=np.int64), False
        for batch in batches:
            rows = np.concatenate([held, batch[["choice", "bits", "fp"]].to_numpy(np.int64)])
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            if crowded:  # goes on from the batch before, which kept one row of it
                end = cuts[0] if len(cuts) else len(rows)
                yield _themselves(rows[1:end])
                if not len(cuts):
                    held = rows[:1]
                    continue
                rows, cuts = rows[end:], cuts[1:] - end
                crowded = False
            last = cuts[-1] if len(cuts) else 0
            yield from _forest(rows[:last], cuts[:-1], parts, distance, max_meeting)
            held = rows[last:]
            if len(held) > max_meeting:
                yield _themselves(held)
                held, crowded = held[:1], True
        if not crowded:
            yield from _forest(held, np.empty(0, dtype=np.int64), parts, distance, max_meeting)

    bounded_batches(fingerprints.sparkSession, rows=10_000)
    split = huge.limit(1).count() > 0
    usual = keyed.join(huge, ["choice", "bits"], "left_anti") if split else keyed
    found = usual.repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInPandas(
        compared, "a long, b long")
    found = frozen(found, "links")
    members = found.filter("a = b").select(F.col("a").alias("fp"))
    if split:
        members = members.unionByName(keyed.join(huge, ["choice", "bits"], "left_semi").select("fp"))
    members = frozen(members.distinct(), "crowded")
    direct = found.filter("a <> b")
    if members.limit(1).count():
        direct = direct.unionByName(half_way_links(members, distance))
    return direct


def _themselves(rows: np.ndarray) -> pd.DataFrame:
    """Marks members of a crowded meeting point as edges to themselves."""
    return pd.DataFrame({"a": rows[:, 2], "b": rows[:, 2]})


def _forest(rows: np.ndarray, cuts: np.ndarray, parts: int, distance: int, most: int) -> Iterator[pd.DataFrame]:
    """One row per linked member of each run of equal keys: the smallest one it reaches, and itself."""
    if not len(rows):
        return
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    sizes = np.diff(np.concatenate([starts, [len(rows)]]))
    pairs = starts[sizes == 2]  # nearly all meetings are of two, so these are looked at together
    left, right = rows[pairs, 2], rows[pairs + 1, 2]
    differing = left.view(np.uint64) ^ right.view(np.uint64)
    near = np.flatnonzero(pigeonring(differing, parts, distance))
    near = near[np.bitwise_count(differing[near]) <= distance]
    a, b = [np.minimum(left, right)[near]], [np.maximum(left, right)[near]]
    for low, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        members = np.sort(rows[low:low + size, 2])
        if size > most:
            a.append(members)
            b.append(members)
            continue
        label = linked_within(members, parts, distance)
        moved = np.flatnonzero(label != np.arange(size))
        a.append(members[label[moved]])
        b.append(members[moved])
    yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def half_way_links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Exact links of all pairs within ``distance`` bits by meeting at half-way points; linear in the rows.

    Each row goes to all points within half the distance, rounded up (2,081 at distance 4). Two fingerprints are within
    the distance exactly if some point is within the half, rounded down, from one and within the half, rounded up, from
    the other, so everything at a point is linked with everything close to it.
    """
    near, far = distance // 2, distance - distance // 2
    at = fingerprints.select("fp", F.col("fp").alias("point"), F.lit(-1).alias("last"), F.lit(0).alias("flips"))
    for _ in range(far):  # flip one more bit, higher than the last, or stop (64)
        more = F.when(F.col("last") < 63, F.sequence(F.col("last") + 1, F.lit(63))).otherwise(F.array().cast("array<int>"))
        at = at.select("fp", "point", "flips", F.explode(F.concat(F.array(F.lit(64)), more)).alias("last"))
        at = at.select("fp", F.when(F.col("last") < 64, F.col("point").bitwiseXOR(F.expr("shiftleft(1L, last)")))
                       .otherwise(F.col("point")).alias("point"), "last",
                       (F.col("flips") + (F.col("last") < 64).cast("int")).alias("flips"))
    close = F.min(F.when(F.col("flips") <= near, F.col("fp"))).over(Window.partitionBy("point"))
    return (at.select(close.alias("a"), F.col("fp").alias("b")).filter("a IS NOT NULL AND a <> b").distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE,
                    distance: int = DISTANCE, max_meeting: int = MAX_MEETING,
                    keep_columns: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``id, fp, component`` for every row (+ ``row``, a struct of ``keep_columns`` with any names).

    ``component`` is the smallest id of the rows that are linked with this one, over any number of links, itself
    included. NULL and empty texts have fingerprint 0 and are linked like any other. A NULL id never names a component
    unless the component has no other. Repeated rows share a component. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep_columns]).alias("row")] if keep_columns else []
    rows = frozen(docs.select(F.col(f"`{id_column}`").alias("id"), fingerprint(text_of(text_column), words).alias("fp"), *kept),
                  "fingerprints")
    distinct = frozen(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = components(links(distinct.select("fp"), distance, max_meeting))
    named = (distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left")
             .withColumn("label", F.coalesce("label", "fp")))
    smallest = named.groupBy("label").agg(F.min("first").alias("component"))
    by_fp = frozen(named.join(smallest, "label").select("fp", "component", "label"), "components")
    return rows.join(by_fp, "fp")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """One row of each component, the one with the smallest id, with the columns of ``docs``.

    Rows are found again by hashes of id and text, so whole rows move once, and only when it is known which of them stay.
    """
    text, id_ = text_of(text_column), F.col(f"`{id_column}`")
    key = {"k": F.xxhash64(id_), "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("again"), text)}
    keyed = [c.alias(name) for name, c in key.items()]
    found = near_duplicates(docs.select(id_.alias("id"), text.alias("text"), *keyed), "id", "text", keep_columns=list(key),
                            **settings)
    first = F.min(F.struct(F.col("id").isNull(), "id", "fp", "row")).alias("first")
    kept = frozen(found.groupBy("label").agg(first).select("first.row.*"), "kept")
    # Spark keeps the first row of each key in every map task already, so a row repeated any number of times costs one per task.
    order = Window.partitionBy(*key).orderBy(F.lit(1))
    rows = docs.select(*keyed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    single = rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return single.join(kept, list(key), "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
