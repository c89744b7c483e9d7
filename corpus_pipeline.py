"""From documents to token ids: language, near-duplicates, personal data, mix of sources, encoding.

Each stage gets what its predecessor kept, as Parquet, and all but the last return the columns of ``documents``. NULL and
empty texts have no language and go in the first stage, so later ones see texts with letters; repeated rows become one in
the second. A table without rows stays empty throughout.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from gridwash.llm.bpe import encode, load_ranks  # noqa: E402
from gridwash.llm.common import crc_fold  # noqa: E402
from gridwash.llm.langid import UNKNOWN, labelled_rows, predict, train  # noqa: E402
from gridwash.llm.mixing import mixed  # noqa: E402
from gridwash.llm.pii import mask_pii  # noqa: E402
from gridwash.llm.simhash import DISTANCE, SHINGLE, without_near_duplicates  # noqa: E402
from gridwash.session import configure, frozen  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SURE = 0.5  # posterior of the best language below which a document belongs to none


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that one of the learned languages explains; NULL texts and texts without letters go.

    Without any labelled document no language can be learned, and nothing but texts without letters goes.
    """
    model = train(labelled_rows(docs, crc_fold("doc_id", 4) != 2), load_ranks(VOCABULARY))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = predict(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts whose SimHash fingerprints are linked."""
    return without_near_duplicates(docs, words=SHINGLE, distance=DISTANCE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; every document stays, with its number of characters kept true."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as it enters the mix, 0 to 3."""
    return mixed(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and the text the ids decode to, one row per copy of the mix."""
    coded = encode(docs, load_ranks(VOCABULARY), PATTERN, decoded=True)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.col("decoded").cast("string").alias("decoded"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mix_sources", mix_sources), ("byte_pairs", byte_pairs)]

# Language models, fingerprints and encoding are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = frozen(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
