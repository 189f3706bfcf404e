from pyspark.sql import functions as F

from veritrail.llm.common import held_out, table
from veritrail.llm.mil import score, train

THRESHOLD = 0.3


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = train(docs, labels, "doc_id", "text", "quality")
    found = score(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLE_SQL = {}
