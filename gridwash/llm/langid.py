"""Language of texts by unigram piece models, summing over all segmentations of each word.

The pieces are those of a fixed public vocabulary. For every language the probabilities of its pieces are learned from
word counts by expectation-maximisation: a forward and a backward pass over each distinct word give the expected number of
uses of each piece over all segmentations. A word's probability is the sum over its segmentations (forward pass), a
text's is the product over its words. Words of any length are whole: the passes keep as many positions as the longest piece
has bytes and rescale their sums as they go, so a run of letters without spaces is one word, in time linear in its length.

Scale: training counts words in the map tasks, so the passes see each distinct word of a language once. The model is as
large as vocabulary times languages, whatever the corpus; only such sums reach the driver. Prediction needs no shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridwash.llm.common import bounded_batches, text_of
from gridwash.session import frozen

ROUNDS = 2  # of expectation-maximisation
STRETCH = 4_096  # positions of a word whose pieces are looked up at a time
RESCALE = 8  # positions after which the sums of a pass are brought back to about 1
SMOOTH = 0.01  # uses that every piece starts with
MAX_LANGUAGES = 1_000  # labels are a short list; more mean a wrong column, which is an error
REMEMBERED = 200_000  # words whose scores a task keeps
UNKNOWN = "und"


def words_of():
    import regex

    find = regex.compile(r"\p{L}+").findall
    return lambda text: find(text.lower())


def numbering() -> defaultdict:
    """A dict that gives each new key the next number."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def bytes_of(word: str) -> bytes:
    """A word with the space before it."""
    return b" " + word.encode("utf-8", "surrogatepass")


class Pieces:
    """The pieces of a vocabulary by number, and where they occur in many words at once.

    Substrings are compared by a 64-bit polynomial hash, so all of a block of words are looked up together.
    """

    BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: Iterable[bytes]):
        self.names = sorted(pieces)
        self.longest = max(map(len, self.names), default=1)
        self.bits = max(4, int(4 * len(self.names)).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, len(self.names), dtype=np.int32)
        for number, key in enumerate(map(int, (self._whole(p) for p in self.names))):
            slot = (key * int(self.SPREAD) & (1 << 64) - 1) >> 64 - self.bits
            while self.keys[slot]:
                slot = slot + 1 & (1 << self.bits) - 1
            self.keys[slot], self.values[slot] = key, number

    def __len__(self) -> int:
        return len(self.names)

    def _whole(self, piece: bytes) -> int:
        key = 0
        for byte in piece:
            key = key * int(self.BASE) + byte + 1 & (1 << 64) - 1
        return key

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """(words, positions) -> hash of all bytes up to there, for words of one length."""
        count, n = len(words), len(words[0])
        letters = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(count, n).astype(np.uint64) + np.uint64(1)
        hashes = np.zeros((count, n + 1), dtype=np.uint64)
        for i in range(n):
            hashes[:, i + 1] = hashes[:, i] * self.BASE + letters[:, i]
        return hashes

    def find(self, hashes: np.ndarray, first: int, last: int) -> np.ndarray:
        """(words, end, length - 1) -> piece that ends at ``first`` < end <= ``last``; ``len(self)`` where there is none."""
        wide = min(last, self.longest)
        powers = np.array([pow(int(self.BASE), i, 1 << 64) for i in range(wide + 1)], dtype=np.uint64)
        end, length = np.nonzero(np.arange(first + 1, last + 1)[:, None] >= np.arange(1, wide + 1)[None, :])
        end, length = end + first + 1, length + 1
        keys = hashes[:, end] - hashes[:, end - length] * powers[length]
        slots = (keys * self.SPREAD) >> np.uint64(64 - self.bits)
        held = self.keys[slots]
        numbers = np.where(held == keys, self.values[slots], len(self)).astype(np.int32)
        open_ = np.nonzero((held != keys) & (held != 0))
        at = slots[open_]
        while len(at):
            at = at + np.uint64(1) & np.uint64((1 << self.bits) - 1)
            held, wanted = self.keys[at], keys[open_]
            hit = held == wanted
            numbers[open_[0][hit], open_[1][hit]] = self.values[at[hit]]
            more = ~hit & (held != 0)
            open_, at = (open_[0][more], open_[1][more]), at[more]
        out = np.full((len(hashes), last - first, wide), len(self), dtype=np.int32)
        out[:, end - first - 1, length - 1] = numbers
        return out


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log share of each language
    pieces: Pieces
    table: np.ndarray  # probabilities of pieces x languages, with a last row of zeros


def _by_length(words: list[bytes], longest: int, most: int = 128_000) -> Iterator[np.ndarray]:
    """Indexes of words of equal length, in blocks of bounded size."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    for where in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(where):
            n = int(lengths[where[0]])
            step = max(1, most // (n * min(n, longest)))
            for at in range(0, len(where), step):
                yield where[at:at + step]


def forward(words: list[bytes], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of each word, for words of one length; ``table`` has a last row of zeros.

    Sums of the last positions only are held, divided by the newest one every ``RESCALE`` positions.
    """
    n, hashes = len(words[0]), pieces.hashes(words)
    back = min(n, pieces.longest)
    logs = np.zeros((len(words), *table.shape[1:]))
    sums = np.zeros((len(words), back + min(n, STRETCH), *table.shape[1:]))  # ``back`` positions before a stretch, then its own
    sums[:, back - 1] = 1.0
    for first in range(0, n, STRETCH):
        last = min(n, first + STRETCH)
        ids = pieces.find(hashes, first, last)
        for i in range(last - first):
            wide = min(first + i + 1, ids.shape[2])
            at = back + i
            sums[:, at] = np.einsum("cw...,cw...->c...", sums[:, at - wide:at][:, ::-1], table[ids[:, i, :wide]])
            if (first + i + 1) % RESCALE == 0:
                newest = np.where(sums[:, at] > 1e-250, sums[:, at], 1.0)
                sums[:, at + 1 - back:at + 1] /= newest[:, None]
                logs += np.log(newest)
        if last < n:
            sums[:, :back] = sums[:, last - first:last - first + back].copy()
    return logs + np.log(np.maximum(sums[:, back + last - first - 1], 1e-300))


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    whole = [bytes_of(w) for w in words]
    out = np.zeros((len(words), table.shape[1]))
    for where in _by_length(whole, pieces.longest):
        out[where] = forward([whole[i] for i in where], pieces, table)
    return out


def _pass(p, words: int, n: int, longest: int) -> np.ndarray:
    """(words, positions) log sums over all segmentations up to each position.

    ``p(i, wide)`` gives (words, length - 1) probabilities of pieces of up to ``wide`` bytes that end at position ``i``.
    """
    sums, logs = np.zeros((words, n + 1)), np.zeros((words, n + 1))
    sums[:, 0] = 1.0
    scale = np.zeros(words)
    for i in range(1, n + 1):
        wide = min(i, longest)
        sums[:, i] = np.einsum("cw,cw->c", sums[:, i - wide:i][:, ::-1], p(i, wide))
        logs[:, i] = scale
        if i % RESCALE == 0:
            newest = np.where(sums[:, i] > 1e-250, sums[:, i], 1.0)
            near = slice(max(0, i + 1 - longest), i + 1)
            sums[:, near] /= newest[:, None]
            scale = scale + np.log(newest)
            logs[:, near] = scale[:, None]
    with np.errstate(divide="ignore"):
        return np.log(sums) + logs


def segment_uses(words: list[bytes], pieces: Pieces, column: np.ndarray, table: np.ndarray) -> Iterator[tuple]:
    """``word, piece, share`` arrays: the posterior of each use of a piece, for words of one length in one language each."""
    n, hashes = len(words[0]), pieces.hashes(words)
    held: dict[int, tuple] = {}

    def stretch(i: int) -> tuple[int, np.ndarray]:
        """The stretch that ends at position ``i`` lie in, with its pieces; the two last used ones are kept."""
        first = (i - 1) // STRETCH * STRETCH
        if first not in held:
            while len(held) > 1:
                held.pop(next(iter(held)))
            held[first] = pieces.find(hashes, first, min(n, first + STRETCH))
        return first, held[first]

    def before(i: int, wide: int) -> np.ndarray:
        first, ids = stretch(i)
        return table[ids[:, i - first - 1, :wide], column[:, None]]

    def after(i: int, wide: int) -> np.ndarray:
        """Pieces that start at ``n - i``: that of k bytes ends k further on."""
        ids = np.empty((len(words), wide), dtype=np.int32)
        k = 1
        while k <= wide:  # ends in one stretch, then those in the next
            first, found = stretch(n - i + k)
            upto = min(wide, first + STRETCH - (n - i))
            ks = np.arange(k, upto + 1)
            ids[:, k - 1:upto] = found[:, n - i + ks - first - 1, ks - 1]
            k = upto + 1
        return table[ids, column[:, None]]

    ahead = _pass(before, len(words), n, pieces.longest)
    behind = _pass(after, len(words), n, pieces.longest)[:, ::-1]
    for first in range(0, n, STRETCH):
        first, ids = stretch(first + 1)
        word, end, length = np.nonzero(ids < len(pieces))
        piece = ids[word, end, length]
        end = end + first + 1
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.exp(ahead[word, end - length - 1] + np.log(table[piece, column[word]]) + behind[word, end] - ahead[word, n])
        yield word, piece, np.nan_to_num(share, nan=0.0)


def count_words(labelled: DataFrame) -> DataFrame:
    """``lang, word, n`` from rows of ``lang, text``, summed in the map tasks first; an empty word counts the texts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = words_of()
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                counts = Counter({"": len(texts)})
                for text in texts:
                    counts.update(find(text))
                yield pd.DataFrame({"lang": lang, "word": list(counts), "n": list(counts.values())})

    found = labelled.mapInPandas(count, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(counts: DataFrame, languages: list[str], pieces: Pieces, probabilities: np.ndarray) -> DataFrame:
    """``nth, piece, uses``: how often each language uses each piece, over all segmentations of its words."""
    sent = counts.sparkSession.sparkContext.broadcast((pieces, probabilities))
    place = {lang: i for i, lang in enumerate(languages)}

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table = sent.value
        uses = np.zeros(table.shape)
        for batch in batches:
            words = [bytes_of(w) for w in batch["word"]]
            column = np.array([place[lang] for lang in batch["lang"]], dtype=np.int64)
            times = batch["n"].to_numpy(np.float64)
            for where in _by_length(words, known.longest):
                for word, piece, share in segment_uses([words[i] for i in where], known, column[where], table):
                    np.add.at(uses, (piece, column[where][word]), share * times[where][word])
        piece, nth = np.nonzero(uses[:-1])
        yield pd.DataFrame({"nth": nth.astype(np.int32), "piece": piece.astype(np.int32), "uses": uses[piece, nth]})

    found = counts.mapInPandas(expect, "nth int, piece int, uses double")
    return found.groupBy("nth", "piece").agg(F.sum("uses").alias("uses"))


def train(labelled: DataFrame, pieces: Iterable[bytes], rounds: int = ROUNDS) -> Model:
    """Learn from all rows of ``lang, text``; rows with a NULL language teach nothing."""
    bounded_batches(labelled.sparkSession, rows=20_000)
    counts = frozen(count_words(labelled.filter("lang IS NOT NULL")), "word-counts")
    texts = {r.lang: r.n for r in counts.filter("word = ''").limit(MAX_LANGUAGES + 1).collect()}
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(texts)
    numbered = Pieces(pieces)
    size = len(numbered)
    probabilities = np.full((size + 1, len(languages)), 1.0 / max(1, size))
    probabilities[size] = 0.0
    words = counts.filter("word <> ''")
    for _ in range(rounds if languages else 0):
        uses = np.full(probabilities.shape, SMOOTH)
        # At most one row per piece and language.
        for r in expected_uses(words, languages, numbered, probabilities).toLocalIterator():
            uses[r.piece, r.nth] += r.uses
        uses[size] = 0.0
        # Rounded, as sums over tasks may differ in the last digits between runs.
        probabilities = np.exp(np.round(np.log(np.maximum(uses / uses.sum(axis=0), 1e-300)), 6))
        probabilities[size] = 0.0
    prior = np.log(np.array([texts[lang] for lang in languages], dtype=np.float64) / max(1, sum(texts.values())))
    return Model(languages, prior, numbered, probabilities)


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``lang_pred`` and its posterior ``score``.

    A NULL text or one without letters is ``und`` with score 0, and so is all if the model knows no language. Ties go to
    the first language by name.
    """
    bounded_batches(docs.sparkSession, rows=20_000)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType.fromDDL("lang_pred string, score double")

    @F.pandas_udf(out)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, find = sent.value, words_of()
        known, scores = numbering(), np.empty((0, len(m.languages)))
        for batch in batches:
            names, values = [], []
            if len(known) > REMEMBERED:
                known, scores = numbering(), scores[:0]
            # A text is kept as numbers of words, which take a fraction of the words' memory.
            found = [np.fromiter(map(known.__getitem__, find(t)), dtype=np.int32) for t in batch]
            new = list(islice(known, len(scores), None))
            scores = np.concatenate([scores, word_scores(new, m.pieces, m.table)])
            for numbers in found:
                if not len(numbers) or not m.languages:
                    names.append(UNKNOWN)
                    values.append(0.0)
                    continue
                total = m.prior + scores[numbers].sum(axis=0)
                best = int(np.argmax(total))
                names.append(m.languages[best])
                values.append(round(float(1.0 / np.exp(total - total[best]).sum()), 6))
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(values, dtype=float)})

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return (docs.select(kept, text_of(text_column).alias("t")).withColumn("j", judged("t"))
            .select("row", F.col("j.lang_pred").alias("lang_pred"), F.col("j.score").alias("score")))


def labelled_rows(docs: DataFrame, teaches: Column, text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """``lang, text`` of the rows that may be learned from."""
    return docs.filter(teaches).select(F.col(f"`{label_column}`").cast("string").alias("lang"),
                                       text_of(text_column).alias("text"))
