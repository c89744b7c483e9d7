"""Byte-level BPE encoding and decoding that handles each distinct word of the corpus once.

1. Texts are split into pre-tokens with positions. A row for every pre-token would be a few hundred times the rows of the
   corpus, so a task packs what it explodes: positions become numbers of words in a word list per chunk of texts, and the
   distinct words of a chunk leave the task dealt into buckets by their hash, one compressed row per bucket.
2. Equal words meet in one bucket over the whole corpus, where each distinct one is encoded once.
3. The ids of the words go back to their chunk, and every text is reassembled by its positions. Positions and words leave
   a task in one exchange, which both the encoding and the reassembling read.
4. Decoding looks every id up in the token-byte table. The table is as large as the vocabulary file, so every task has it,
   like the small side of a broadcast join, and positions never leave their row.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from gridwash.llm.common import bounded_batches, text_of

CHUNK_CHARS = 4_000_000  # texts of so many characters share a word list; a longer text is a chunk of its own
BUCKETS_PER_PARTITION = 2  # buckets of words for each partition that the session shuffles to


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 and rank per line. Bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str):
    """A function that cuts a text into pre-tokens. White space is Unicode's, as the pattern's own engine has it."""
    import regex

    space = r"\p{White_Space}"
    inside = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return regex.compile(inside).findall


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equals, until no pair is a token; n log n in the bytes."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not middle or middle >= n or not end[middle] or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[start], end[middle] = stop, 0
        if stop < n:
            before[stop] = start
            if (r := ranks.get(word[start:end[stop]])) is not None:
                heapq.heappush(heap, (r, start, end[stop]))
        left = before[start]
        if left >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at:end[at]]])
        at = end[at]
    return ids


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart and compressed."""
    import zstandard

    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings as their lengths and their bytes, compressed."""
    import zstandard

    lengths = pack(np.array([len(w) for w in words], dtype=np.uint32))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), 3)


def unpack_words(packed: bytes) -> list[bytes]:
    import zstandard

    middle = 4 + int.from_bytes(packed[:4], "little")
    ends = np.cumsum(unpack(packed[4:middle]).astype(np.int64)).tolist()
    whole = zstandard.decompress(packed[middle:])
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def word_lists(docs: DataFrame, pattern: str, buckets: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``chunk, bucket, id, numbers, words`` from rows of ``id string, text``.

    For each bucket of a chunk its words and their numbers; under bucket -1 the numbers of the words of all texts by
    position, and how many each text has; and a row for the ``id`` of each text, bucket -2 for the first, -3 for the
    second ... A word's bucket depends on its bytes alone.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, first = splitter(pattern), TaskContext.get().partitionId() << 32

        def chunk(nth: int, ids: list, texts: list) -> pa.RecordBatch:
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            positions = [np.fromiter(map(numbers.__getitem__, cut(t)), dtype=np.uint32) for t in texts]
            # Frequent words get small numbers, which pack better.
            times = np.zeros(len(numbers), dtype=np.int64)
            for p in positions:
                times += np.bincount(p, minlength=len(numbers))
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            names = [w.encode() for w in numbers]
            dealt = np.fromiter((zlib.crc32(w) % buckets for w in names), dtype=np.int64, count=len(names))[order]
            at = [int(b) for b in np.unique(dealt)]
            lists = [np.flatnonzero(dealt == b) for b in at]
            whole = place[np.concatenate([np.empty(0, dtype=np.uint32), *positions])]
            counts = np.array([len(p) for p in positions], dtype=np.uint32)
            none = [None] * len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + nth] * (len(ids) + 1 + len(at)), pa.int64()),
                 pa.array([-2 - i for i in range(len(ids))] + [-1] + at, pa.int32()),
                 pa.array(ids + [None] * (1 + len(at)), pa.string()),
                 pa.array(none + [pack(whole)] + [pack(np.diff(x, prepend=0)) for x in lists], pa.binary()),
                 pa.array(none + [pack(counts)] + [pack_words([names[i] for i in order[x]]) for x in lists], pa.binary())],
                names=["chunk", "bucket", "id", "numbers", "words"])

        nth, ids, texts, chars = 0, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(text)
                chars += len(text)
                if chars >= chunk_chars:
                    yield chunk(nth, ids, texts)
                    nth, ids, texts, chars = nth + 1, [], [], 0
        if ids:
            yield chunk(nth, ids, texts)

    return docs.mapInArrow(split, "chunk long, bucket int, id string, numbers binary, words binary")


def encode_words(lists: DataFrame, ranks: dict[bytes, int], count_only: bool = False) -> DataFrame:
    """``of, part, lengths, ids``: the token ids of the words of every chunk ``of`` and bucket ``part``, or their numbers.

    Rows of a bucket come one after the other, so each of its distinct words is encoded once, whatever chunks it is in.
    """
    known = lists.sparkSession.sparkContext.broadcast(ranks)

    def only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(pa.compute.greater_equal(batch.column("bucket"), 0))
            yield held.select(["chunk", "bucket", "words"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket, done = known.value, None, {}
        for batch in batches:
            lengths, ids = [], []
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if b != bucket:
                    bucket, done = b, {}
                found = []
                for word in unpack_words(packed):
                    coded = done.get(word)
                    if coded is None:
                        coded = done[word] = encode_word(word, table)
                    found.append(coded)
                lengths.append(pack(np.array([len(c) for c in found], dtype=np.uint32)))
                ids.append(None if count_only else pack(np.fromiter((i for c in found for i in c), dtype=np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(lengths, pa.binary()),
                                              pa.array(ids, pa.binary())], names=["of", "part", "lengths", "ids"])

    words = lists.mapInArrow(only_words, "chunk long, bucket int, words binary")
    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        encode, "of long, part int, lengths binary, ids binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text",
           chunk_chars: int = CHUNK_CHARS, count_only: bool = False, decoded: bool = False) -> DataFrame:
    """``id, ids`` for every row: the token ids of the whole text, or with ``count_only`` just their number, ``n_tokens``.

    With ``decoded`` the ids are decoded again where they are, into ``decoded``, as ``decode`` does it for ids that lie
    in a table.

    NULL and empty texts have no ids. Repeated rows and NULL ids stay as they are; other columns, whatever their names,
    are not read. An empty table gives an empty result. A text is held by one task, however long.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # Ids travel as texts, which keeps NULLs and large numbers as they are on the way through Python.
    slim = docs.select(F.col(f"`{id_column}`").cast("string").alias("id"), text_of(text_column).alias("text"))
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = word_lists(slim, pattern, buckets, chunk_chars).repartition("chunk")
    coded = encode_words(lists, ranks, count_only)
    result = StructField("n_tokens", LongType()) if count_only else StructField("ids", ArrayType(IntegerType()))
    schema = StructType([StructField("id", StringType()), result, *[StructField("decoded", BinaryType())] * decoded])
    table = spark.sparkContext.broadcast(token_bytes(ranks) if decoded else {})

    def reassemble(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        by_bucket = dict(zip(words["part"], zip(words["lengths"], words["ids"])))
        lists = texts[texts["bucket"] >= 0]
        numbers = [np.cumsum(unpack(n).astype(np.int64)) for n in lists["numbers"]]
        size = 1 + max((int(n[-1]) for n in numbers), default=-1)
        lengths, starts, flat, at = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), [], 0
        for bucket, places in zip(lists["bucket"], numbers):
            counts = unpack(by_bucket[bucket][0]).astype(np.int64)
            lengths[places] = counts
            starts[places] = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            if not count_only:
                flat.append(unpack(by_bucket[bucket][1]).astype(np.int32))
        ids, out = np.concatenate([np.empty(0, dtype=np.int32), *flat]), []
        packed = texts[texts["bucket"] == -1].iloc[0]
        whole, at = unpack(packed["numbers"]), 0
        texts = texts[texts["bucket"] < -1].sort_values("bucket", ascending=False)
        for many in unpack(packed["words"]).tolist():
            places = whole[at:at + many]
            at += many
            counts = lengths[places]
            if count_only:
                out.append(int(counts.sum()))
                continue
            ends = np.cumsum(counts)
            steps = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - (ends - counts), counts)
            out.append(ids[steps])
        rows = pd.DataFrame({"id": texts["id"], result.name: pd.Series(out, index=texts.index, dtype=object)})
        if decoded:
            rows["decoded"] = pd.Series([bytes_of(i, table.value) for i in out], index=texts.index, dtype=object)
        return rows

    # Both sides of a chunk are bounded by its characters; chunks are many more than tasks.
    found = lists.groupBy("chunk").cogroup(coded.groupBy("of")).applyInPandas(reassemble, schema)
    return found.withColumn("id", F.col("id").cast(docs.schema[id_column].dataType))


def token_bytes(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """The token-byte table."""
    return {token: piece for piece, token in ranks.items()}


def bytes_of(ids: np.ndarray, table: dict[int, bytes]) -> bytes:
    """The bytes of token ids, in order."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def encoded_lengths(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``id, n_tokens`` for every row: the number of tokens of the whole text."""
    return encode(docs, ranks, pattern, id_column, text_column, count_only=True)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of an array of token ids; NULL ids give no bytes, and an unknown id is an error."""
    bounded_batches(encoded.sparkSession)
    known = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([b"" if ids is None else bytes_of(ids, known.value) for ids in batch], dtype=object)

    return encoded.withColumn(name, joined(F.col(f"`{ids_column}`")))


def ids_digest(ids: Sequence[int] | str = "ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
