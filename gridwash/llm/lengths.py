"""Exact histogram of encoded lengths, with suffix sums that answer every context limit.

Documents are encoded by the distinct-word encoder and counted by length in the map tasks. Lengths are summed from the long
end in two levels: within bands of lengths, and over the bands, so no task sorts all lengths. The histogram is as long as
there are different lengths; limits, quantiles and truncated totals are read off it, never off the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.llm.bpe import encoded_lengths

BAND = 1_024


def histogram(lengths: DataFrame, band: int = BAND) -> DataFrame:
    """One row per different ``n_tokens``, of rows of ``n_tokens``:

    ``docs, tokens`` of this length, ``docs_from, tokens_from`` of this length and longer, and ``truncated_tokens``, what
    stays of the whole corpus if texts are cut at this length. NULL lengths are left out; no rows give no rows.
    """
    counts = lengths.filter("n_tokens IS NOT NULL").groupBy(F.col("n_tokens").cast("long").alias("n_tokens")).agg(
        F.count(F.lit(1)).alias("docs"))
    counts = (counts.withColumn("tokens", F.col("n_tokens") * F.col("docs"))
              .withColumn("band", F.expr(f"n_tokens div {band}")))
    # One row per band, at most the longest length over ``band``.
    bands = counts.groupBy("band").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    longer = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("band", F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("d_over"),
                         F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("t_over"),
                         F.sum("t").over(Window.partitionBy(F.lit(1))).alias("all_tokens"))
    inside = Window.partitionBy("band").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.join(bands, "band").select(
        "n_tokens", "docs", "tokens", (F.col("d_over") + F.sum("docs").over(inside)).alias("docs_from"),
        (F.col("t_over") + F.sum("tokens").over(inside)).alias("tokens_from"), "all_tokens")
    kept = F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return summed.withColumn("truncated_tokens", kept).drop("all_tokens")


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``max_tokens, docs_over, tokens_over, tokens_lost, truncated_tokens`` for any context limits, seen or not.

    The suffix sums at the shortest length over the limit answer it.
    """
    total = F.coalesce(F.max("tokens_from"), F.lit(0))
    parts = []
    for limit in dict.fromkeys(int(x) for x in limits):
        over = F.min(F.when(F.col("n_tokens") > limit, F.struct("n_tokens", "docs_from", "tokens_from")))
        docs, tokens = (F.coalesce(over[c], F.lit(0)) for c in ("docs_from", "tokens_from"))
        parts.append(F.struct(F.lit(limit).cast("long").alias("max_tokens"), docs.alias("docs_over"),
                              tokens.alias("tokens_over"), (tokens - limit * docs).alias("tokens_lost"),
                              (total - tokens + limit * docs).alias("truncated_tokens")))
    return hist.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least this share of the documents do not exceed."""
    all_docs = hist.agg(F.max("docs_from").alias("n")).scalar()
    rows = hist.withColumn("all_docs", all_docs).withColumn("up_to", F.col("all_docs") - F.col("docs_from") + F.col("docs"))
    parts = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(
        F.col("up_to") >= F.greatest(F.lit(1.0), F.ceil(F.col("all_docs") * float(s))), F.col("n_tokens"))).alias("n_tokens"))
        for s in shares]
    return rows.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def length_histogram(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The histogram of the encoded lengths of all rows; NULL and empty texts have length 0, repeated rows count again."""
    return histogram(encoded_lengths(docs, ranks, pattern, id_column, text_column))
