"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands, odd sketches, and a check on full sets.

1. A text becomes the set of its word shingles. Texts with equal sets are one vertex (128 bits of the sorted set), so a group
   of copies of any size costs one row from here on.
2. Vertices meet under bands of ``rows`` MinHash values. There are so many bands that two sets at the threshold miss each
   other in all of them with a chance of at most ``miss``, and so many rows that unrelated texts seldom meet.
3. A second MinHash sample is folded into an odd sketch: each value flips one of 1,024 bits. The bits that differ between two
   sketches tell how many values differ, and with the sizes of both sets whether their similarity can reach the threshold.
   Up to 1,024 shingles the sample is the set itself: bits that differ are never more than values that differ, so no pair is
   lost. Larger sets are sampled by the smallest value of each of 1,024 bins, and 4.5 deviations of sampling and folding are
   allowed for. Sets near the border have both sketches, so that two of similar sizes can always be compared.
4. Where vertices meet, the sketches give a forest of the most similar pairs, so a group of near copies costs one pair per
   member. Meeting points of more than ``block`` members are split into blocks at random, in each band anew. The pairs of the
   forest are confirmed on the full sets of both texts, and confirmed ones become components.
5. What the forest has missed lies between different components. Meeting points with members of several components are looked
   at once more, and every pair between different ones that the sketches allow and nobody has checked is confirmed as well.
   In a split meeting point, members outside its main component visit all its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from gridwash.llm.common import bounded_batches, text_of
from gridwash.llm.components import components
from gridwash.llm.simhash import shingle_hashes
from gridwash.session import frozen

WORDS = 2
SIMILAR = (4, 5)  # similarity of 0.8 as a fraction, so that comparing is exact
MISS = 1e-6  # chance that a pair at the threshold shares no band
BACKGROUND = 0.02  # similarity of texts that have nothing to do with each other, about
LEAST_ROWS = 5
BITS = 1_024  # of an odd sketch, and bins of its sample
WHOLE = 1_024  # shingles up to which a set is its own sample
FILTER_ROWS = 1 << 22  # texts that a bitmap of 4 MB can tell from others; with more, all texts are dealt out
DEVIATIONS = 4.5
BLOCK = 4_096
STEP = 1_024  # shingles that are hashed at once

SKETCHED = "s1 long, s2 long, n long, sampled int, whole binary, part binary, bands array<long>"


# ---- one text

def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text, ascending; empty without words."""
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets reach the threshold; empty sets reach it with nothing."""
    part, whole = SIMILAR
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b) and whole * shared >= part * (len(a) + len(b) - shared))


def band_shape(texts: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows per band: unrelated texts meet about once at most, and pairs at the threshold all but certainly."""
    part, whole = SIMILAR
    rows = LEAST_ROWS
    while True:
        bands = math.ceil(math.log(miss) / math.log(1 - (part / whole) ** rows))
        if bands * BACKGROUND ** rows * texts <= 1:
            return bands, rows
        rows += 1


class Bands:
    """MinHash values of 32 bits, and 64-bit keys of bands of them."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(42)
        self.bands, self.rows = bands, rows
        self.low, self.high = (rng.integers(0, 2 ** 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
                               for _ in range(2))

    def values(self, found: np.ndarray) -> np.ndarray:
        halves = found.view(np.uint32).reshape(-1, 2)
        least = np.full(len(self.low), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(halves), STEP):
            part = halves[at:at + STEP]
            x = self.low[:, None] * part[None, :, 0] + self.high[:, None] * part[None, :, 1]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(12)
            np.minimum(least, x.min(axis=1), out=least)
        return least

    def keys(self, found: np.ndarray) -> np.ndarray:
        values = self.values(found).reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(self.rows):
            key = (key ^ values[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


def parities(sample: np.ndarray) -> bytes:
    """What the values of a sample leave on the bits, each flipping one."""
    x = sample * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    flips = np.bincount((x >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits(flips & 1, bitorder="little").tobytes()


def odd_sketches(found: np.ndarray) -> tuple[int, bytes, bytes]:
    """Size of the sample by bins, the sketch of the whole set and that of the sample; empty where a set needs none."""
    part, whole = SIMILAR
    bins = found >> np.uint64(64 - BITS.bit_length() + 1)
    sample = found[np.flatnonzero(np.diff(bins, prepend=np.uint64(BITS)))]  # ascending: the first of a bin is its smallest
    return (len(sample), parities(found) if len(found) * part <= WHOLE * whole else b"",
            parities(sample) if len(found) * whole > WHOLE * part else b"")


# ---- pairs of sketches

class Features:
    """Sizes and sketches of some vertices."""

    def __init__(self, n: np.ndarray, sampled: np.ndarray, whole: np.ndarray, part: np.ndarray):
        self.n, self.sampled, self.whole, self.part = n, sampled, whole, part

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Features:
        blank = bytes(BITS // 8)
        bits = [np.frombuffer(b"".join(x or blank for x in rows[c]), dtype=np.uint64).reshape(len(rows), -1)
                for c in ("whole", "part")]
        return cls(rows["n"].to_numpy(np.int64), rows["sampled"].to_numpy(np.float64), *bits)

    def __getitem__(self, some: slice) -> Features:
        return Features(self.n[some], self.sampled[some], self.whole[some], self.part[some])

    def __len__(self) -> int:
        return len(self.n)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows one less their estimated similarity, infinite where the threshold is out of reach."""
        part, whole = SIMILAR
        na, nb = self.n[a], self.n[b]
        out = np.full(len(a), np.inf)
        fits = np.minimum(na, nb) * whole >= np.maximum(na, nb) * part
        plain = np.flatnonzero(fits & (np.maximum(na, nb) * part <= WHOLE * whole))
        flipped = np.bitwise_count(self.whole[a[plain]] ^ self.whole[b[plain]]).sum(axis=1, dtype=np.int64)
        near = flipped * (whole + part) <= (na[plain] + nb[plain]) * (whole - part)
        out[plain[near]] = 2 * flipped[near] / (na[plain] + nb[plain] + flipped)[near]
        rest = np.flatnonzero(fits & (np.maximum(na, nb) * part > WHOLE * whole))
        if len(rest):
            flipped = np.bitwise_count(self.part[a[rest]] ^ self.part[b[rest]]).sum(axis=1, dtype=np.int64)
            out[rest] = sampled_distance(na[rest], nb[rest], self.sampled[a[rest]], self.sampled[b[rest]], flipped)
        return out


def sampled_distance(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, flipped: np.ndarray) -> np.ndarray:
    """One less the estimated similarity of two samples, infinite beyond what chance allows at the threshold."""
    part, whole = SIMILAR
    j, union = part / whole, (na + nb) * whole / (whole + part)  # of both sets, at the threshold
    taken = BITS * -np.expm1(-union / BITS)  # bins with a value
    expected = np.maximum(sa + sb - 2 * j * taken, 0)
    sampling = 4 * j * (1 - j) * taken * np.maximum(1 - taken / union, 0)
    kept = (1 - 2 / BITS) ** expected
    folding = BITS / 4 + BITS * (BITS - 1) / 4 * (1 - 4 / BITS) ** expected - (BITS * kept) ** 2 / 4
    spread = np.sqrt(sampling + np.maximum(folding, 0) / kept ** 2)
    differing = -BITS / 2 * np.log1p(-np.minimum(2 * flipped / BITS, 1 - 1e-9))
    return np.where(differing <= expected + DEVIATIONS * spread + 1, differing / (sa + sb), np.inf)


def forest(some: Features) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows: a forest over all allowed pairs, with the most similar ones taken first."""
    size = len(some)
    near, source = np.full(size, np.inf), np.zeros(size, dtype=np.int64)
    left, right, free, at = [], [], np.ones(size, dtype=bool), 0
    for _ in range(size - 1):
        free[at] = False
        others = np.flatnonzero(free)
        found = some.distances(np.full(len(others), at), others)
        closer = found < near[others]
        near[others[closer]], source[others[closer]] = found[closer], at
        at = others[np.argmin(near[others])]
        if near[at] < np.inf:
            left.append(source[at])
            right.append(at)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def between(some: Features, label: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All allowed pairs of rows with different labels, of which at most one only visits."""
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    names, counts = np.unique(label, return_counts=True)
    main, at = label == names[np.argmax(counts)], np.arange(len(some))
    for row in np.flatnonzero(~main):
        other = np.flatnonzero((label != label[row]) & (main | (at > row)) & ~(visits & visits[row]))
        found = other[some.distances(np.full(len(other), row), other) < np.inf]
        left.append(np.full(len(found), row))
        right.append(found)
    return np.concatenate(left), np.concatenate(right)


# ---- tables

def sketched(texts: DataFrame, shape: tuple[int, int], words: int = WORDS) -> DataFrame:
    """Each row with what is known of its set beside it; NULL for a text without words."""
    names = [f.split()[0] for f in SKETCHED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        bands = Bands(*shape)
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = shingle_set(text, words)
                if not len(found):
                    out.append((None, None, 0, 0, None, None, None))
                    continue
                whole = xxhash.xxh3_128_intdigest(found.tobytes())
                ones = np.array([whole >> 64, whole & (2 ** 64 - 1)], dtype=np.uint64).view(np.int64).tolist()
                out.append((*ones, len(found), *odd_sketches(found), bands.keys(found)))
            known = pd.DataFrame(out, columns=names).astype({"s1": "Int64", "s2": "Int64"})
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), known], axis=1)

    kept = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != "text")
    return texts.mapInPandas(run, f"{kept}, {SKETCHED}")


def _blocks(rows: DataFrame, compare) -> DataFrame:
    """``a, b`` from all blocks of ``key, chunk``, whose rows come as a sorted stream and are held one block at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            at = rows[["key", "chunk"]].to_numpy(np.int64)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            if last:
                yield compare(rows.iloc[:last].reset_index(drop=True), cuts[:-1])
            held = rows.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield compare(held, np.empty(0, dtype=np.int64))

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "v").mapInPandas(run, "a long, b long")


def _pairs(rows: pd.DataFrame, cuts: np.ndarray, choose) -> pd.DataFrame:
    """Pairs of all blocks of a batch: blocks of two at once, others by ``choose(begin, end)``."""
    v, some = rows["v"].to_numpy(np.int64), Features.of(rows)
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    ends = np.concatenate([cuts, [len(rows)]]).astype(np.int64)
    two = starts[ends - starts == 2]
    near = two[some.distances(two, two + 1) < np.inf]
    left, right = [near], [near + 1]
    for low, high in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        a, b = choose(some[low:high], low, high)
        left.append(a + low)
        right.append(b + low)
    a, b = v[np.concatenate(left)], v[np.concatenate(right)]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def forest_pairs(members: DataFrame, features: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of a forest in every block of the meeting points ``key, v, m``."""
    chunk = F.when(F.col("m") > block, F.pmod(F.xxhash64("v", "key"), F.ceil(F.col("m") / block))).otherwise(0).cast("int")

    def compare(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        return _pairs(rows, cuts, lambda some, low, high: forest(some)).drop_duplicates()

    return _blocks(members.select("key", "v", chunk.alias("chunk")).join(features, "v"), compare).distinct()


def other_pairs(members: DataFrame, features: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """All allowed pairs between different components that meet."""
    label = F.coalesce("label", "v").alias("label")
    named = members.join(labels, "v", "left").select("key", "v", "m", label)
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    named = frozen(named.join(mixed.select("key"), "key"), "mixed-meetings")
    few = named.filter(F.col("m") <= block).select("key", F.lit(0).alias("chunk"), "v", "label", F.lit(False).alias("visits"))
    many = named.filter(F.col("m") > block)
    main = many.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(
        F.max_by("label", F.struct("rows", "label")).alias("main"))
    chunks = F.ceil(F.col("m") / block).cast("int")
    placed = many.join(main, "key").withColumn("home", F.pmod(F.xxhash64("v", "key"), chunks).cast("int"))
    visited = F.when(F.col("label") == F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), chunks - 1))
    placed = placed.select("key", F.explode(visited).alias("chunk"), "v", "label", "home").select(
        "key", "chunk", "v", "label", (F.col("chunk") != F.col("home")).alias("visits"))

    def compare(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        own, visits = rows["label"].to_numpy(np.int64), rows["visits"].to_numpy(bool)
        return _pairs(rows, cuts, lambda some, low, high: between(
            some, own[low:high], visits[low:high])).drop_duplicates()

    return _blocks(few.unionByName(placed).join(features, "v"), compare).distinct()


@pandas_udf(BooleanType())
def _confirmed(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    last, of_last = None, None
    for left, right, words in pairs:
        found = []
        for x, y, k in zip(left, right, words):
            if of_last is None or x != last:
                last, of_last = x, shingle_set(x, k)
            found.append(similar(of_last, shingle_set(y, k)))
        yield pd.Series(found, dtype=bool)


def _among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that may be wanted, by one bit of a bitmap for each ``t1``, where the wanted ones are few enough for one."""
    count = wanted.count()
    if count > FILTER_ROWS:
        return texts
    bits = 1 << max(10, (8 * count).bit_length())
    at = F.col("t1").bitwiseAND(F.lit(bits - 1))
    words = wanted.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int((t1 & {bits - 1}L) & 63L))")).alias("bits")).collect()  # 4 MB at most
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    for row in words:
        bitmap[row["word"]] = row["bits"]

    @pandas_udf(BooleanType())
    def marked(t1: pd.Series) -> pd.Series:
        at = t1.to_numpy(np.int64) & (bits - 1)
        return pd.Series((bitmap[at >> 6] >> (at & 63)) & 1 == 1)

    return texts.filter(marked("t1"))


def confirm(pairs: DataFrame, vertices: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar. Only texts that are in a pair are kept, once each."""
    ends = frozen(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(
        vertices.select("v", "t1", "t2"), "v"), "ends")
    # Copies of a text go in the map tasks already, by the limit on the row number.
    one = Window.partitionBy("t1", "t2").orderBy(F.length("text"))
    single = _among(texts, ends).withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    needed = frozen(single.join(ends, ["t1", "t2"]).select("v", "text"), "candidate-texts")
    both = (pairs.join(needed.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
            .join(needed.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a"))
    return both.filter(_confirmed("text_a", "text_b", F.lit(words))).select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``id, n_shingles, component, kept`` for every row.

    Sets of ``words``-word shingles with a Jaccard similarity of 0.8 or more are linked; ``component`` is the smallest id that
    is reachable over links, the row's own included, and ``kept`` says that it is the row's own. Words are lower-cased in
    ASCII and cut at ASCII white space; a text with fewer words is one shingle. Texts without words and NULL texts have an
    empty set and are linked with nothing, not with each other either. A NULL id names a component only if it has no other.
    Repeated rows share a component. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    text = text_of(text_column)
    # 128 bits that tell one text from another without Python, to find it again.
    t = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("again"), text).alias("t2")]
    shape = band_shape(docs.count(), miss)
    rows = frozen(sketched(docs.select(F.col(f"`{id_column}`").alias("id"), *t, text.alias("text")), shape, words),
                  "sketched")
    vertices = frozen(rows.filter("s1 IS NOT NULL").groupBy("s1", "s2").agg(
        F.min("id").alias("first"), F.min(F.struct("t1", "t2", "n", "sampled", "whole", "part", "bands")).alias("of"))
        .select(F.monotonically_increasing_id().alias("v"), "s1", "s2", "first", "of.*"), "vertices")
    keyed = vertices.select("v", F.explode("bands").alias("key"))
    met = frozen(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "meetings")
    members = frozen(keyed.join(met, "key"), "members")
    features = vertices.select("v", "n", "sampled", "whole", "part")
    texts = docs.select(*t, text.alias("text"))

    pairs = frozen(forest_pairs(members, features, block), "pairs")
    links = frozen(confirm(pairs, vertices, texts, words), "confirmed")
    labels = components(links)
    more = frozen(other_pairs(members, features, labels, block).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    if more.limit(1).count():
        labels = components(links.unionByName(frozen(confirm(more, vertices, texts, words), "confirmed")))
    named = vertices.select("v", "s1", "s2", "first").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component"))
    found = frozen(named.join(smallest, "label").select("s1", "s2", "component"), "components")
    joined = rows.select("id", "n", "s1", "s2").join(found, ["s1", "s2"], "left")
    component = F.when(F.col("s1").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select("id", F.col("n").alias("n_shingles"), component.alias("component"),
                         F.col("id").eqNullSafe(component).alias("kept"))
