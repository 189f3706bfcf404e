from pyspark.sql import functions as F

from veritrail.llm.common import held_out, table
from veritrail.llm.langid import predict, train


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL = {}
