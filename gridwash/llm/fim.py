"""Fill-in-middle: documents cut at two token borders and put together in another order, with memoised chunks.

1. A rolling hash of the last 32 bytes cuts a text into chunks where its leading bits are zero, so a passage that many
   documents share is cut into the same chunks wherever it stands.
2. Each task keeps a bounded memory from the bytes of a chunk to its summary: code points, token ends inside, whether it starts
   with white space and whether it ends inside a word. A chunk is only taken as known when its bytes are equal.
3. Summaries add up: a token that ends where two chunks meet shows from the end of one and the start of the other. Running sums
   give the number of tokens, and lead to the one chunk in which a cut lies; only there the place is looked up.

A token is a run of other characters with the ASCII white space before it, or white space at the end of the text. The memory
changes nothing but the time; Python returns three numbers per text, texts are cut and joined by Spark.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from gridwash.llm.common import bounded_batches, text_of

SEED = 42
RATE = 50  # of 100 documents so many are transformed
SUFFIX_FIRST = 80  # of 100 transformed ones so many start with the suffix
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BITS = 9  # chunks of 512 bytes on average
CHUNK_MOST = 8_192
MEMORY = 64 << 20  # bytes of chunks that a task remembers
SPAN = 4 << 20  # bytes that are hashed at once


class Summary(NamedTuple):
    points: int  # code points that start here
    starts_white: bool
    ends_in_word: bool
    ends: np.ndarray  # places inside the chunk where a token ends and white space follows


def _mixed_bytes() -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(bytes([b]), SEED) for b in range(256)], dtype=np.uint32)


def rolling_hash(data: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """For each byte a hash of the 32 bytes that end there; sums of 1, 2, 4 ... bytes are put together from two halves."""
    h = mixed[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def chunk_borders(data: np.ndarray, mixed: np.ndarray) -> list[int]:
    """Ends of the chunks, the last one being the end of the data."""
    size, marks = len(data), []
    for low in range(0, size, SPAN):  # each span sees the 31 bytes before it, so spans change no border
        before = min(low, 31)
        h = rolling_hash(data[low - before:low + SPAN], mixed)[before:]
        marks.append(np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + low + 1)
    borders, last = [], 0
    for mark in [*np.concatenate(marks).tolist(), size] if size else []:
        while mark - last > CHUNK_MOST:
            last += CHUNK_MOST
            borders.append(last)
        if mark > last:
            borders.append(mark)
            last = mark
    return borders


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, dtype=np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return Summary(int(((data & 0xC0) != 0x80).sum()), bool(white[0]), not white[-1], ends.astype(np.uint16))


class Chunks:
    """Summaries of the chunks seen last, by content."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.known = memory, 0, OrderedDict()
        self.mixed = _mixed_bytes()
        self.asked = self.found = 0

    def summary(self, chunk: bytes) -> Summary:
        self.asked += 1
        got = self.known.get(chunk)  # equal bytes, not only an equal hash
        if got is not None:
            self.found += 1
            self.known.move_to_end(chunk)
            return got
        got = self.known[chunk] = summary(chunk)
        self.held += 2 * len(chunk) + 500
        while self.held > self.memory and len(self.known) > 1:
            self.held -= 2 * len(self.known.popitem(last=False)[0]) + 500
        return got

    def cut(self, text: str, first: int, second: int) -> tuple[int, int, int]:
        """Number of tokens, and the code points before the smaller and the larger of two cuts; a cut lies after
        ``first`` (``second``) modulo the number of tokens plus one."""
        raw = text.encode("utf-8", "surrogatepass")
        borders = chunk_borders(np.frombuffer(raw, dtype=np.uint8), self.mixed)
        starts = [0, *borders[:-1]]
        parts = [self.summary(raw[a:b]) for a, b in zip(starts, borders)]
        # Tokens and code points before each chunk. Where a word ends with its chunk, or the text ends, a token does.
        tokens, points = [0], [0]
        for part, after in zip(parts, [*parts[1:], None]):
            closes = after is None or (part.ends_in_word and after.starts_white)
            tokens.append(tokens[-1] + len(part.ends) + closes)
            points.append(points[-1] + part.points)
        n = tokens[-1]
        cuts = []
        for units in sorted((first % (n + 1), second % (n + 1))):
            at = int(np.searchsorted(tokens, units))  # the first border with so many tokens before it
            if at and units - tokens[at - 1] <= len(parts[at - 1].ends):
                start = starts[at - 1]
                inside = raw[start:start + int(parts[at - 1].ends[units - tokens[at - 1] - 1])]
                cuts.append(points[at - 1] + sum(1 for b in inside if b & 0xC0 != 0x80))
            else:
                cuts.append(points[at])
        return n, cuts[0], cuts[1]


@pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    chunks = Chunks()
    for texts, first, second in batches:
        yield pd.DataFrame([chunks.cut(*row) for row in zip(texts, first.tolist(), second.tolist())],
                           columns=["n", "first", "second"], dtype="int64")


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED,
                   rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   keep_columns: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row (+ ``row``, a struct of ``keep_columns``).

    ``n`` counts tokens. ``form`` is ``plain`` (the text as it is), ``spm`` (suffix, prefix, middle) or ``psm``. Both cuts
    and the form follow from the SHA-256 of seed and id alone, so repeated rows get the same result, and rows with a NULL id
    share one draw (the id counts as empty). NULL texts count as empty; those and texts that hold a marker stay plain.
    An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    h = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep_columns]).alias("row")] if keep_columns else []
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text_of(text_column).alias("text"),
                       *[h[i].alias(f"h{i + 1}") for i in range(4)], *kept)
    cut = rows.withColumn("cut", _cuts("text", "h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = (F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain")
            .when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substring("text", F.lit(1), first)
    middle = F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.length("text") - second)
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        "id", F.col("cut.n").alias("n"), "form", F.when(moved, F.col("cut.first")).alias("prefix_chars"),
        F.when(moved, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"),
        *(["row"] if keep_columns else []))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from an output and its form alone. No marker is in a text, and none can arise where two parts meet."""
    out = F.col(f"`{output}`")
    body, middle = F.substring_index(out, MIDDLE, 1), F.substring_index(out, MIDDLE, -1)
    inner = F.substring(body, F.lit(len(PREFIX) + 1), F.length(body))

    def parts(marker: str) -> tuple[Column, Column]:
        return F.substring_index(inner, marker, 1), F.substring_index(inner, marker, -1)

    prefix, suffix = parts(SUFFIX)
    late_suffix, late_prefix = parts(PREFIX)
    return (F.when(F.col(f"`{form}`") == "plain", out).when(F.col(f"`{form}`") == "psm", F.concat(prefix, middle, suffix))
            .otherwise(F.concat(late_prefix, middle, late_suffix)))
