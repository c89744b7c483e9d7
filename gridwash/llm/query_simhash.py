"""op4: near-duplicate components of all documents. SQL has no XXH64 with a seed: tested against brute force."""

from pyspark.sql import functions as F

from gridwash.llm.queries import query
from gridwash.llm.simhash import near_duplicates


@query("op4_simhash")
def op4_simhash(t):
    return near_duplicates(t.documents).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
