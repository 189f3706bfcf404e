from pyspark.sql import functions as F

from veritrail.llm.common import table
from veritrail.llm.recompression import without_repeats


def op13_substring_dedup(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op13_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY x) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM r, range(13) AS o(k)),
e AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
}
QUERIES = {"op13_substring_dedup": op13_substring_dedup}
