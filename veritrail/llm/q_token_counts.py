from pyspark.sql import functions as F

from veritrail.llm.common import table
from veritrail.llm.token_counts import token_counts


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id", "text", rule="start")
    return found.select("doc_id", "section_no", "first_char", "end_char", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL = {}
