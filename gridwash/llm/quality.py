"""Document quality by Bradley-Terry pairwise ranking.

Texts become a short row of features, once for all rows. Labelled good and bad documents form preference pairs, and a
linear score is learned by logistic loss on the differences of their features: the chance that one document is better than
another is the logistic function of the difference of their scores. Scores are then cut at a quantile, the one that leaves
as large a share of the labelled documents below as are labelled bad.

The fit uses at most ``SAMPLE`` documents per label, chosen by a hash of their features (a documented bound; the driver
gets so many short rows). The share of bad labels and the quantile cover all labelled rows, scores all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from gridwash.llm.common import bounded_batches, text_of
from gridwash.session import frozen

SAMPLE = 5_000  # labelled documents of each label that pairs are made of
PARTNERS = 8  # pairs for each document of the larger label
RIDGE = 1e-3
STEPS = 50

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".!?"
ORDINARY = bytes(range(65, 91)) + bytes(range(97, 123)) + DIGITS + b" \t\n\r\x0b\x0c.,;:'\"()-!?" + bytes(range(128, 256))
FEATURES = ("length", "word_length", "upper", "digits", "symbols", "exclamations", "bars", "stops", "commas",
            "odd_endings", "short_words", "long_words", "distinct", "most_frequent", "doubled", "repeated_threes",
            "repeated_lines", "line_words", "urls", "no_letters")


def features_of(text: str) -> list[float]:
    """Shares and logarithms that say how a text is written, not in which language or about what."""
    raw = text.encode("utf-8", "surrogatepass")
    size, words = max(1, len(raw)), text.split()
    n = max(1, len(words))

    def many(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    counts = Counter(words)
    threes = max(1, len(words) - 2)
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = list(map(len, words))
    odd = sum(w[-1] in "*%$&#|!=~^_+<>@\\/{}[]" for w in words)
    values = [
        np.log1p(len(words)) / 10, np.log1p(sum(lengths) / n), many(UPPER) / size, many(DIGITS) / size,
        len(raw.translate(None, ORDINARY)) / size, many(b"!") / size, many(b"|") / size, many(STOPS) / n, many(b",") / n, odd / n,
        sum(x <= 2 for x in lengths) / n, sum(x > 20 for x in lengths) / n, 1 - len(counts) / n,
        max(counts.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n,
        1 - min(1.0, len(set(zip(words, words[1:], words[2:]))) / threes) if len(words) > 2 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 10,
        (text.count("http") + text.count("www.")) / n, float(not any(map(str.isalpha, text)))]
    # Roots, as a small share of a text that is wrong already tells.
    return [float(v) if i in (0, 1, 17) else float(np.sqrt(v)) for i, v in enumerate(values)]


@pandas_udf(ArrayType(DoubleType()))
def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([features_of(t) for t in batch], dtype=object)


@dataclass
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float = 0.0

    def raw_score(self, column: str) -> Column:
        """The linear score of an array of features."""
        slopes = self.weights / self.spread
        return F.lit(float(-(self.mean * slopes).sum())) + sum(
            (F.col(column)[i] * float(s) for i, s in enumerate(slopes)), F.lit(0.0))


def pairs_of(good: np.ndarray, bad: np.ndarray, partners: int = PARTNERS) -> np.ndarray:
    """Feature differences of preference pairs; every document is in some, and pairs step through the other label."""
    many, few = max(len(good), len(bad)), min(len(good), len(bad))
    if not few:
        return np.empty((0, good.shape[1]))
    step = max(1, few // partners)
    first = np.repeat(np.arange(many), partners)
    other = (first + np.tile(np.arange(partners) * step, many)) % few
    return good[first] - bad[other] if len(good) >= len(bad) else good[other] - bad[first]


def fit(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE) -> Ranking:
    """Bradley-Terry weights by Newton steps on the logistic loss of pair differences; zero without any pair."""
    both = np.concatenate([good, bad])
    width = both.shape[1]
    mean = both.mean(axis=0) if len(both) else np.zeros(width)
    spread = np.maximum(both.std(axis=0), 1e-6) if len(both) else np.ones(width)
    x = pairs_of((good - mean) / spread, (bad - mean) / spread)
    w = np.zeros(width)
    for _ in range(STEPS if len(x) else 0):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))  # chance of the wrong order
        slope = x.T @ p / len(x) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 2.0 / max(1e-12, np.linalg.norm(step)))
        if np.linalg.norm(step) < 1e-9:
            break
    return Ranking(mean, spread, w)


def featured(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``features`` of every row, written once. NULL texts count as empty."""
    bounded_batches(docs.sparkSession)
    return frozen(docs.select(*[F.col(f"`{c}`") for c in keep], features(text_of(text_column)).alias("features")),
                  "features")


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Ranking:
    """A ranking from rows of ``features, label`` (1 good, 0 bad; others teach nothing)."""
    known = labelled.filter("label IN (0, 1)")

    def some(label: int) -> np.ndarray:
        # The same choice in every run: rows with equal hashes have equal features.
        rows = known.filter(F.col("label") == label).select("features").orderBy(F.xxhash64("features")).limit(sample)
        return np.array([r.features for r in rows.collect()], dtype=np.float64).reshape(-1, len(FEATURES))

    ranking = fit(some(1), some(0))
    n, bad = known.agg(F.count("label").alias("n"), F.count_if(F.col("label") == 0).alias("bad")).first()
    if 0 < bad < n:
        # Halfway between the last score of the share and the next one.
        shares = [bad / n, min(1.0, (bad + 1) / n)]
        low, high = known.agg(F.percentile_approx(ranking.raw_score("features"), shares, 100_000).alias("c")).first().c
        ranking.cut = (low + high) / 2
    return ranking


def scored(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """``rows`` with ``score``, the chance to be better than a document at the cut, and ``predicted`` (score >= 0.5)."""
    score = F.round(1 / (1 + F.exp(ranking.cut - ranking.raw_score("features"))), 9)
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("features")
