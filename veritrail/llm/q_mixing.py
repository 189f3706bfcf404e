from veritrail.llm.common import table
from veritrail.llm.mixing import mixed


def op8_mixing(spark, sf_dir):
    found = mixed(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return found.select(found["id"].alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL = {}
