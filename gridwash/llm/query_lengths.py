"""op3: histogram of the encoded lengths of all documents. SQL cannot encode: tested against the tokenizer library."""

from gridwash.llm.bpe import load_ranks
from gridwash.llm.lengths import length_histogram
from gridwash.llm.queries import query

VOCABULARY = "byte_bpe_50k.tiktoken"


@query("op3_lengths")
def op3_lengths(t):
    import public_tokenizers

    return length_histogram(t.documents, load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
