"""op5: ten nearest neighbours of every hundredth embedding. Approximate: recall is tested against brute force."""

from pyspark.sql import functions as F

from gridwash.llm.ann import nearest
from gridwash.llm.queries import query


@query("op5_ann")
def op5_ann(t):
    return nearest(t.embeddings, F.col("vec_id") % 100 == 0, 10)
