"""Mix sources to target weights by Pareto order sampling. DataFrame operations only.

Every source gets a target in words. A document expects ``copies`` = target / size of its source, tilted towards longer
documents; the whole part is allocated for certain, the rest is an inclusion probability. Documents are ranked within
their source by random odds divided by inclusion odds, and the extra copies go down that ranking until the source's
target is met, so the sample has a fixed size (in words) with unequal probabilities.

At scale: texts are read once, for their length. The ranking is never sorted as a whole: ranks are binned per source, bin
sums (pre-aggregated in the map tasks) tell which bin holds the cut, and only that bin is sorted. Sums are of integers,
random numbers are hashes of the id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.llm.common import WORD, text_of
from gridwash.operators.segments import join_same, row_index
from gridwash.session import frozen

BINS = 4096  # per source; the cut's bin, about one row in so many, is sorted in one task
TILT = 0.5  # 0: equal chances within a source; 1: as unequal as the limit on copies allows
HALF_WORDS = 200  # length at which a document gets half of the preference
RANDOM_DIGITS = 13  # hex digits of the hash that make a random number: 52 bits


def source_targets(sizes: DataFrame, weights: Sequence[int], max_copies: int, total: int | None = None) -> DataFrame:
    """Targets in words: ``source, source_words, target, mean_preference`` from rows of ``source, words, preference``.

    Sources in order of code points, NULL last, take the weights in turn and share ``total`` words (all words if None).
    A target stops at ``max_copies`` times the words of its source and the excess goes to the others by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("words").alias("source_words"),
                                         F.sum(F.col("words") * F.col("preference")).alias("preferred"))
    ranked = row_index(totals, ["source"], "nth")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = frozen(ranked.withColumn("weight", weight), "mix-sources")
    level = F.lit(None).cast("double")
    capped = -1
    limit = F.col("source_words") * max_copies
    # Words for one unit of weight. More sources reach their limit in each round; the driver sees four figures a round.
    while True:
        over = F.coalesce(F.col("weight") * level > limit, F.lit(False))
        now = ranked.agg(F.sum("source_words").alias("words"), F.sum(F.when(over, 1).otherwise(0)).alias("capped"),
                         F.sum(F.when(over, limit).otherwise(0)).alias("given"),
                         F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weights")).first()
        if now.words is None or now.capped == capped:
            break
        capped = now.capped
        goal = now.words if total is None else min(int(total), now.words * max_copies)
        level = F.lit((goal - now.given) / now.weights if now.weights else float("inf"))
    target = F.least(F.col("weight") * level, limit.cast("double"))
    mean = F.when(F.col("source_words") > 0, F.col("preferred") / F.col("source_words")).otherwise(0.0)
    return frozen(ranked.select("source", "source_words", target.alias("target"), mean.alias("mean_preference")),
                  "mix-targets")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", max_copies: int = 3, tilt: float = TILT, seed: int = 1,
        total: int | None = None, keep_columns: Sequence[str] = ()) -> DataFrame:
    """How often each document enters the mix: ``id, source, words, source_words, target, copies`` (+ ``row``).

    One row per input row. ``row`` is a struct of ``keep_columns``, which may have any names. NULL and empty texts have
    no words and take nothing. A NULL source is a source of its own. Rows with equal ids share one random number, so
    repeated rows come and go together but for the one at the cut. An empty table gives an empty result.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep_columns]).alias("row")] if keep_columns else []
    base = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"),
                       F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long").alias("words"), *kept)
    base = base.withColumn("preference", F.expr(f"words * 1000 div (words + {HALF_WORDS})"))
    base = frozen(base, "mix-sizes")
    targets = source_targets(base, weights, max_copies, total)

    rate = F.when(F.col("source_words") > 0, F.col("target") / F.col("source_words")).otherwise(0.0)
    room = F.least(F.col("rate"), max_copies - F.col("rate"))
    expected = F.col("rate") + room * (tilt / 1000) * (F.col("preference") - F.col("mean_preference"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))),
                         1, RANDOM_DIGITS)
    random = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** RANDOM_DIGITS)
    rows = (join_same(base, targets, ["source"])
            .withColumn("rate", rate)
            .withColumn("expected", F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), expected)))
            .withColumn("certain", F.floor("expected"))
            .withColumn("chance", F.col("expected") - F.col("certain"))
            .withColumn("random", random)
            # Random odds over inclusion odds, brought into 0..1; documents without a chance come last of all.
            .withColumn("odds", F.when(F.col("chance") > 0, F.col("random") * (1 - F.col("chance"))
                                       / ((1 - F.col("random")) * F.col("chance"))))
            .withColumn("bin", F.when(F.col("chance") > 0,
                                      F.floor(F.col("odds") / (1 + F.col("odds")) * BINS)).otherwise(BINS)))
    cuts = _cuts(rows, targets)
    placed = join_same(rows, cuts, ["source"], "left")
    # Only the bin of the cut is sorted; a copy is taken where it brings the source nearer to its target.
    ahead = Window.partitionBy("source").orderBy("odds", "id", "words").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = placed.filter("bin = cut").withColumn("upto", F.col("before") + F.sum("words").over(ahead))
    at_cut = at_cut.withColumn("extra", F.when(F.col("upto") - F.col("words") / 2 <= F.col("rest"), 1).otherwise(0))
    others = placed.filter("cut IS NULL OR bin <> cut").withColumn(
        "extra", F.when((F.col("chance") > 0) & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), 1).otherwise(0))
    names = ["id", "source", "words", "source_words", "target",
             (F.col("certain") + F.col("extra")).cast("int").alias("copies"), *(["row"] if keep_columns else [])]
    return others.select(*names).unionByName(at_cut.select(*names))


def _cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the bin in which the words left by the certain copies run out; none where all bins fit."""
    binned = rows.groupBy("source", "bin").agg(F.sum("words").alias("words"),
                                               F.sum(F.col("certain") * F.col("words")).alias("certain_words"))
    # At most BINS + 1 rows per source.
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = (binned.withColumn("upto", F.sum("words").over(upto))
              .withColumn("certain_words", F.sum("certain_words").over(Window.partitionBy("source"))))
    left = (join_same(summed, targets.select("source", "target"), ["source"])
            .withColumn("rest", F.col("target") - F.col("certain_words")))
    first = left.filter(f"bin < {BINS} AND upto > rest").groupBy("source").agg(
        F.min(F.struct("bin", "upto", "words", "rest")).alias("c"))
    return frozen(first.select("source", F.col("c.bin").alias("cut"),
                               (F.col("c.upto") - F.col("c.words")).alias("before"), F.col("c.rest").alias("rest")),
                  "mix-cuts")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it enters the mix, with the same columns."""
    rows = mix(docs, keep_columns=docs.columns, **settings).filter("copies > 0")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
