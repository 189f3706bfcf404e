from pyspark.sql import functions as F

from veritrail.llm.common import table
from veritrail.llm.topk import top_k


def op4_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, id_col="vec_id", vector_col="embedding", scale=256.0)


ORACLE_SQL = {
    "op4_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) WHERE rank <= 5
"""
}
QUERIES = {"op4_exact_topk": op4_exact_topk}
