"""op9: language of all documents. SQL cannot express it: tested by brute force over segmentations and held-out rows."""

from pyspark.sql import functions as F

from gridwash.llm.bpe import load_ranks
from gridwash.llm.common import crc_fold
from gridwash.llm.langid import labelled_rows, predict, train
from gridwash.llm.queries import query

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op9_langid")
def op9_langid(t):
    import public_tokenizers

    docs = t.documents
    held_out = crc_fold("doc_id", 4) == 2
    model = train(labelled_rows(docs, ~held_out), load_ranks(public_tokenizers.path(VOCABULARY)))
    judged = predict(docs.select("doc_id", "text"), model)
    return judged.select(F.col("row.doc_id").alias("doc_id"), (F.coalesce(F.crc32(
        F.col("row.doc_id").cast("string").cast("binary")) % 4, F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
