"""Map misspelt values to a list of wanted ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from gridwash.functions.similarity import BOOST_ABOVE, PAIRS, PREFIX_LENGTH, PREFIX_WEIGHT, best_match, pair_scores
from gridwash.operators.cells import quoted
from gridwash.operators.naming import unused
from gridwash.session import frozen

# Most entries of a list sent to a task at once; a longer list goes through in slices of this size.
SLICE = 5_000
# Values whose match a task remembers from one batch to the next.
REMEMBERED = 100_000


def _matcher(entries: Sequence[str]):
    pairs = [(e, e.encode("utf-8")) for e in entries]

    @F.pandas_udf("struct<entry string, score double>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str | None, float]] = {}
        for values in batches:
            if len(known) > REMEMBERED:
                known.clear()
            known.update({v: best_match(v, pairs) for v in values.dropna().unique() if v not in known})
            found = [known.get(v, (None, None)) for v in values]
            yield pd.DataFrame(found, columns=["entry", "score"])

    return match


def fuzzy_match(df: DataFrame, column: str, entries: Sequence[str] | DataFrame, threshold: float = 0.7,
                name: str = "matched", order_by: str | None = None) -> DataFrame:
    """Closest entry by Jaro-Winkler similarity, or NULL below the threshold; the first entry wins ties.

    A list of entries goes to the rows, without a shuffle: a task scores each different value once. A vocabulary that is a
    DataFrame of one text column, in ``order_by`` order (default: by the text), may have any size and never leaves the
    cluster: see ``closest``.
    """
    if isinstance(entries, DataFrame):
        return _match_table(df, column, entries, threshold, name, order_by)
    best, new = unused([*df.columns, name], "_best", "_new")
    out = df.withColumn(best, F.lit(None).cast("struct<entry string, score double>"))
    for i in range(0, len(entries), SLICE):
        out = out.withColumn(new, _matcher(list(entries[i:i + SLICE]))(quoted(column).cast("string")))
        # A later slice wins only with a strictly higher score.
        out = out.withColumn(best, F.when(F.col(best).isNull() | (F.col(f"{new}.score") > F.col(f"{best}.score")), F.col(new))
                             .otherwise(F.col(best))).drop(new)
    return out.withColumn(name, F.when(F.col(f"{best}.score") >= threshold, F.col(f"{best}.entry"))).drop(best)


def _match_table(df: DataFrame, column: str, entries: DataFrame, threshold: float, name: str, order_by: str | None) -> DataFrame:
    text = entries.columns[0] if order_by is None else next(c for c in entries.columns if c != order_by)
    listed = entries.select(quoted(text).cast("string").alias("entry"), quoted(order_by or text).alias("place"))
    values = df.select(quoted(column).cast("string").alias("value"))
    value, entry = unused([*df.columns, name], "_value", "_entry")
    found = closest(values, listed, threshold).select(F.col("value").alias(value), F.col("entry").alias(entry))
    others = [quoted(c) for c in df.columns if c.lower() != name.lower()]
    return df.join(found, quoted(column).cast("string") == F.col(value), "left").select(*others, F.col(entry).alias(name))


# A join on similarity. The similarity of two texts of a and b bytes with m common ones is at most (m/a + m/b + 1)/3 before the
# bonus for a common beginning, so a score needs a least number of common bytes, equal bytes counted as often as they occur.
# Texts that share so many share one of their rarest bytes as well, and meet under these. All this depends on the bytes of a
# text and its beginning alone: texts that agree in both are one kind, kinds meet instead of texts, and the texts of two kinds
# are scored in packs, those of the kinds that allow the most first.

LEVELS = (0.95, 0.9, 0.83)  # scores that are looked for first: the higher, the fewer kinds can meet
OCCURRENCES = 8  # of one byte in a text that are told apart in counting how rare they are
BLOCK = 256  # kinds of values under one byte that meet entries in one piece, about
MARKS = 128  # bits that tell which bytes a kind has
PACK = 128  # texts of one kind in one row, about
ROUNDING = 1e-9


def _least_jaro(score: float, beginning: int) -> float:
    """The similarity without bonus that a score takes with so many common first bytes."""
    bonus = PREFIX_WEIGHT * beginning
    return min(score, max(BOOST_ABOVE, (score - bonus) / (1 - bonus)))


def _byte_order(entries: DataFrame) -> dict[int, int]:
    """How many entries have a byte for the n-th time: at most 256 times ``OCCURRENCES`` figures."""
    tokens = entries.select(F.explode(_tokens({})("entry")).alias("token")).filter(F.col("token") < 256 * OCCURRENCES)
    return {r["token"]: r["count"] for r in tokens.groupBy("token").count().collect()}


def _tokens(rarity: dict[int, int]):
    """The bytes of a text as numbers, each with how often it came before, rare ones first."""
    def of(text: str) -> list[int]:
        seen: dict[int, int] = {}
        out = []
        for byte in text.encode("utf-8"):
            seen[byte] = seen.get(byte, 0) + 1
            out.append(byte + 256 * (seen[byte] - 1))
        return sorted(out, key=lambda t: (rarity.get(t, 0), t))

    @F.pandas_udf("array<int>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return tokens


def _kind(text: str) -> list[Column]:
    """What a text's chances depend on: its ``tokens`` and its beginning."""
    return [F.col("tokens"), F.substring(F.col(text).cast("binary"), 1, PREFIX_LENGTH).alias("first")]


def _meeting_under(jaro: float):
    """The bytes under which a text meets those of at least this similarity, from its ``tokens``."""
    size = F.size("tokens")
    needed = F.greatest(F.lit(1), F.ceil(size * max(0.0, 3 * jaro - 2) - ROUNDING))
    return F.slice("tokens", 1, (size - needed + 1).cast("int"))


def _bound(common: Column) -> Column:
    """The highest score that lengths, common bytes and beginnings of two kinds allow."""
    a, b = F.size("value_tokens"), F.size("entry_tokens")
    jaro = (common / a + common / b + 1) / 3
    beginning = reduce(lambda x, y: x + y, [F.when(F.col(f"value_begin{n}") == F.col(f"entry_begin{n}"), 1).otherwise(0)
                                            for n in range(1, PREFIX_LENGTH + 1)])
    return F.when(jaro > BOOST_ABOVE - ROUNDING, jaro + PREFIX_WEIGHT * beginning * (1 - jaro)).otherwise(jaro)


def _least_share(score: float) -> Column:
    """What m/a + m/b must be for a score, by the common beginning of two kinds."""
    share = F.lit(3 * _least_jaro(score, 0) - 1)
    for n in range(1, PREFIX_LENGTH + 1):
        share = F.when(F.col(f"value_begin{n}") == F.col(f"entry_begin{n}"), 3 * _least_jaro(score, n) - 1).otherwise(share)
    return share


def _begin(n: int) -> Column:
    """The first bytes of a kind as a number, NULL where there are fewer."""
    return F.when(F.length("first") >= n, F.conv(F.hex(F.substring("first", 1, n)), 16, 10).cast("long"))


def _marks(word: int) -> Column:
    """One of the ``MARKS / 64`` words of a bitmap of a kind's ``tokens``; different ones may share a bit."""
    at = f"cast((t % 256 + 53 * (t div 256)) % {MARKS} - {64 * word} as int)"
    return F.expr(f"aggregate(tokens, 0L, (marks, t) -> if({at} between 0 and 63, marks | shiftleft(1L, {at}), marks))")


def _missing(of: str, other: str) -> Column:
    """How many bytes of one side the other surely does not have."""
    absent = [F.bit_count(F.col(f"{of}_marks{w}").bitwiseAND(F.bitwise_not(f"{other}_marks{w}"))) for w in range(MARKS // 64)]
    return reduce(lambda x, y: x + y, absent)


def _tasks(df: DataFrame) -> int:
    """Few short rows may stand for much work, so they are dealt out by number, not by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Join kinds of values with those of entries; what many values share is cut into parts."""
    parts = F.ceil(F.count("*") / BLOCK).alias("parts")
    many = left.groupBy(*on).agg(parts)
    left = left.join(many, on).withColumn("part", F.pmod(F.xxhash64("value_tokens", "value_first"), "parts"))
    right = right.join(many, on).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tasks = _tasks(left)
    return (left.drop("parts").repartition(tasks, *on, "part")
            .join(right.drop("parts").repartition(tasks, *on, "part"), [*on, "part"]))


def kind_pairs(values: DataFrame, entries: DataFrame, score: float) -> DataFrame:
    """Pairs of kinds that may reach a score, each once and none of them lost, with the highest score they allow (``bound``).

    Both sides are different kinds: ``tokens, first``.
    """
    def side(kinds: DataFrame, jaro: float, of: str) -> DataFrame:
        return kinds.select(F.col("tokens").alias(f"{of}_tokens"), F.col("first").alias(f"{of}_first"),
                            *(_begin(n).alias(f"{of}_begin{n}") for n in range(1, PREFIX_LENGTH + 1)),
                            *(_marks(w).alias(f"{of}_marks{w}") for w in range(MARKS // 64)),
                            F.posexplode(_meeting_under(jaro)).alias(f"{of}_at", "token"))

    a, b = F.size("value_tokens"), F.size("entry_tokens")
    begins = [f"{of}_begin{n}" for of in ("value", "entry") for n in range(1, PREFIX_LENGTH + 1)]
    met = []
    for same_first in (True, False):  # without a common first byte there is no bonus
        jaro = _least_jaro(score, PREFIX_LENGTH if same_first else 0)
        left, right = side(values, jaro, "value"), side(entries, jaro, "entry")
        if same_first:
            pairs = _meet(left.withColumn("byte", F.col("value_begin1")), right.withColumn("byte", F.col("entry_begin1")),
                          ["token", "byte"])
        else:
            others = right.groupBy("token").agg(F.min("entry_begin1").alias("least"), F.max("entry_begin1").alias("most"))
            left = left.join(others, "token").filter("value_begin1 <> least OR value_begin1 <> most").drop("least", "most")
            pairs = _meet(left, right, ["token"]).filter("value_begin1 <> entry_begin1")
        # Where the first common byte is, all others come after it on both sides.
        common = F.least(a - F.col("value_at"), b - F.col("entry_at"), a - _missing("value", "entry"), b - _missing("entry", "value"))
        met.append(pairs.filter(common * (a + b) >= a * b * _least_share(score) - ROUNDING)
                   .select("value_tokens", "value_first", "entry_tokens", "entry_first", *begins))
    # The few that numbers let pass are stored, each once, and then judged by their lists of bytes.
    pairs = frozen(met[0].unionByName(met[1]).distinct(), "met")
    bound = _bound(F.size(F.array_intersect("value_tokens", "entry_tokens"))).alias("bound")
    return (pairs.select("value_tokens", "value_first", "entry_tokens", "entry_first", bound)
            .filter(F.col("bound") >= score - ROUNDING))


def candidates(values: DataFrame, entries: DataFrame, score: float) -> DataFrame:
    """Pairs ``value, entry, place`` that lengths, common bytes and beginnings allow to reach a score, none of them lost.

    Both sides have ``tokens``, and texts that are not empty.
    """
    values, entries = values.select("value", *_kind("value")), entries.select("entry", "place", *_kind("entry"))
    pairs = kind_pairs(values.select("tokens", "first").distinct(), entries.select("tokens", "first").distinct(), score)
    values = values.withColumnsRenamed({"tokens": "value_tokens", "first": "value_first"})
    entries = entries.withColumnsRenamed({"tokens": "entry_tokens", "first": "entry_first"})
    return (pairs.join(values, ["value_tokens", "value_first"]).join(entries, ["entry_tokens", "entry_first"])
            .select("value", "entry", "place"))


def _packs(rows: DataFrame, of: str, *kept: str) -> DataFrame:
    """The texts of each kind as sorted lists of structs of the ``kept`` columns; many texts of one kind make several lists."""
    kind = ["tokens", "first"]
    many = rows.groupBy(*kind).agg(F.count("*").alias("many"))
    parted = rows.join(many, kind).withColumn("part", F.pmod(F.xxhash64(of), F.ceil(F.col("many") / PACK)))
    packs = parted.groupBy(*kind, "part").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias(f"{of}_pack"))
    return packs.select(F.col("tokens").alias(f"{of}_tokens"), F.col("first").alias(f"{of}_first"), f"{of}_pack")


@F.pandas_udf(StructType().add("at", ArrayType(IntegerType())).add("score", ArrayType(DoubleType())))
def _best_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """For each value of a list the place and score of the best entry of another list, the first on ties.

    Values whose floor, a score known to be reached, is beyond the bound of both lists get the place -1.
    """
    def scored(group: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        left = [v.encode("utf-8") for values, _, _ in group for v in values]
        right = [e.encode("utf-8") for _, entries, _ in group for e in entries]
        at_left, at_right, from_left, from_right = [], [], 0, 0
        for values, entries, asked in group:
            at_left.append(np.repeat(from_left + asked, len(entries)))
            at_right.append(np.tile(from_right + np.arange(len(entries)), len(asked)))
            from_left, from_right = from_left + len(values), from_right + len(entries)
        scores = pair_scores(left, right, np.concatenate(at_left), np.concatenate(at_right))
        out, start = [], 0
        for values, entries, asked in group:
            at, score = np.full(len(values), -1, dtype=np.int32), np.zeros(len(values))
            table = scores[start:start + len(asked) * len(entries)].reshape(len(asked), len(entries))
            start += table.size
            at[asked], score[asked] = table.argmax(axis=1), table.max(axis=1)
            out.append((at, score))
        return out

    for columns in batches:
        found, group, size = [], [], 0
        for values, entries, floors, bound in zip(*columns):
            asked = np.flatnonzero(np.asarray(floors) <= bound + ROUNDING)
            group.append((values, entries, asked))
            size += len(asked) * len(entries)
            if size >= PAIRS:
                found += scored(group)
                group, size = [], 0
        found += scored(group) if group else []
        yield pd.DataFrame({"at": [at for at, _ in found], "score": [score for _, score in found]})


def _scored(pairs: DataFrame, values: DataFrame, entries: DataFrame, level: float) -> DataFrame:
    """``value, best`` (less, place, entry) of at least a level; ``values`` and ``entries`` are packs, ``pairs`` their kinds."""
    met = (pairs.join(values, ["value_tokens", "value_first"]).join(entries, ["entry_tokens", "entry_first"])
           .filter(F.array_min("value_pack.floor") <= F.col("bound") + ROUNDING)
           .select("value_pack", "entry_pack", "bound").repartition(_tasks(pairs)))
    found = met.withColumn("found", _best_of("value_pack.value", "entry_pack.entry", "value_pack.floor", "bound"))
    one = F.transform(F.arrays_zip(F.col("value_pack.value").alias("value"), F.col("found.at").alias("at"),
                                   F.col("found.score").alias("score")),
                      lambda x: F.struct(x["value"].alias("value"), x["score"].alias("score"), F.get("entry_pack", x["at"]).alias("to")))
    best = found.select(F.explode(one).alias("one")).filter((F.col("one.to").isNotNull()) & (F.col("one.score") >= level))
    return best.groupBy("one.value").agg(
        F.min(F.struct((-F.col("one.score")).alias("less"), F.col("one.to.place").alias("place"), F.col("one.to.entry").alias("entry")))
        .alias("best"))


def _at_level(values: DataFrame, entries: DataFrame, pairs: DataFrame, level: float) -> DataFrame:
    """``value, entry, score``: the best entry of each value that reaches a level, from the ``pairs`` of kinds that may."""
    top = pairs.groupBy("value_tokens", "value_first").agg(F.max("bound").alias("top"))
    pairs = pairs.join(top, ["value_tokens", "value_first"])
    nearest = F.col("bound") >= F.col("top") - ROUNDING
    listed = _packs(entries, "entry", "place", "entry")
    asked = _packs(values.withColumn("floor", F.lit(float(level))), "value", "value", "floor")
    early = frozen(_scored(pairs.filter(nearest), asked, listed, level), "nearest")
    # Kinds that allow less are only looked at by values that have not found as much.
    floor = F.coalesce(-F.col("best.less"), F.lit(float(level)))
    again = _packs(values.join(early, "value", "left").withColumn("floor", floor).drop("best"), "value", "value", "floor")
    late = _scored(pairs.filter(~nearest), again, listed, level)
    best = early.unionByName(late).groupBy("value").agg(F.min("best").alias("best"))
    return best.select("value", "best.entry", (-F.col("best.less")).alias("score"))


def closest(values: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """``value, entry, score`` for each different value that has an entry with at least the threshold: the best one.

    ``entries`` has columns ``entry`` and ``place``; the smaller place wins ties, then the text. Equal texts are joined first.
    Values without one look for a high score, for which few kinds of texts can meet, and only those that find none go on to the
    next level, down to the threshold. Whoever finds something at a level has found the best there is, as all pairs of at least
    that score are among its candidates. NULL and empty texts match nothing; the threshold must be above 0.
    """
    if threshold <= 0:
        raise ValueError("a vocabulary in a table needs a threshold above 0")
    known = entries.filter("entry <> ''").groupBy("entry").agg(F.min("place").alias("place"))
    rarity = _byte_order(known)
    known = frozen(known.withColumn("tokens", _tokens(rarity)("entry")).select("entry", "place", *_kind("entry")), "vocabulary")
    asked = values.filter("value <> ''").distinct()
    same = known.select("entry", F.col("entry").alias("value"))
    rest = asked.join(same.select("value"), "value", "left_anti").withColumn("tokens", _tokens(rarity)("value"))
    rest = frozen(rest.select("value", *_kind("value")), "values")
    found = [asked.join(same, "value", "left_semi").select("value", F.col("value").alias("entry"), F.lit(1.0).alias("score"))]
    if threshold > 1:
        return found[0].limit(0)
    kinds = frozen(known.select("tokens", "first").distinct(), "kinds")
    for level in [*(s for s in LEVELS if s > threshold), threshold]:
        if rest.isEmpty():
            break
        asked_kinds = frozen(rest.select("tokens", "first").distinct(), "kinds")
        pairs = frozen(kind_pairs(asked_kinds, kinds, level), "pairs")
        if pairs.isEmpty():
            continue
        hits = frozen(_at_level(rest, known, pairs, level), "closest")
        found.append(hits)
        rest = frozen(rest.join(hits.select("value"), "value", "left_anti"), "values")
    return reduce(DataFrame.unionByName, found)
