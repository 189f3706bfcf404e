from pyspark.sql import functions as F

from veritrail.llm.common import table
from veritrail.llm.fim import RATE, SPM_RATE, fill_in_middle, restored


def op12_fill_in_middle(spark, sf_dir):
    found = fill_in_middle(table(spark, sf_dir, "documents"), "doc_id", "text")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_DRAW = ", ".join(f"('0x' || substr(s, {8 * k + 1}, 8))::UBIGINT AS h{k + 1}" for k in range(4))
_PART = "array_to_string(units[{}:{}], '')"
ORACLE_SQL = {
    "op12_fill_in_middle": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, {_DRAW} FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS j FROM u),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
    {_PART.format(1, 'i')} AS p, {_PART.format('i + 1', 'j')} AS m, {_PART.format('j + 1', 'n')} AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM f
"""
}
QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
