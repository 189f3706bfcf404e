from veritrail.llm.common import table
from veritrail.llm.simhash import hex_of, near_duplicates


def op10_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, max_bits=4)
    return found.select("doc_id", hex_of(found["fp"]).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLE_SQL = {}
