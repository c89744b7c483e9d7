"""op7: all documents encoded and decoded. SQL cannot express it: tested against the tokenizer library."""

from pyspark.sql import functions as F

from gridwash.llm.bpe import encode, ids_digest, load_ranks
from gridwash.llm.queries import query

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op7_bpe")
def op7_bpe(t):
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path(VOCABULARY))
    coded = encode(t.documents, ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                        ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
