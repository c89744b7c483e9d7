"""op6: quality of all documents, learned from the labels of two folds of three. Tested by held-out accuracy."""

from pyspark.sql import functions as F

from gridwash.llm.common import crc_fold
from gridwash.llm.quality import featured, learn, scored
from gridwash.llm.queries import query


@query("op6_quality")
def op6_quality(t):
    rows = featured(t.documents).withColumn("held_out", crc_fold("doc_id", 3) == 1)
    # A document takes part once per label row; the labels of repeated rows count as often as they stand there.
    labels = t.labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    ranking = learn(rows.filter("NOT held_out").join(labels, "doc_id").select("features", "label"))
    return scored(rows, ranking).select("doc_id", "held_out", "score", "predicted")
